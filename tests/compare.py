"""Results of Spark against those of DuckDB."""

SF = "/root/testdata/sf0.001"


def plain(value):
    """Values of Spark and DuckDB in one form."""
    if value is None or isinstance(value, float) and value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def same(df, con, text):
    """Rows of both, sorted, columns by name."""
    found = con.execute(text)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert ours == theirs
