"""Predicates and rule lists over Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import blank


def in_range_ids(ids: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Ids that lie inside one of several ranges; repeats stay."""
    return F.filter(ids, lambda i: any_of([i.between(low, high) for low, high in ranges]))


def any_of(conditions: Sequence[Column]) -> Column:
    """True if one of the conditions is; false for none."""
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def record_to_rows(df: DataFrame, ids: str, low: int, high: int, excluded: Column | None = None) -> DataFrame:
    """One row for each id of ``ids`` in range (repeats kept); records without ids or of an excluded set are dropped."""
    rows = df if excluded is None else df.where(~F.coalesce(excluded, F.lit(False)))
    return rows.withColumn("species", F.explode(in_range_ids(F.col(ids), [(low, high)])))


def category(value: Column, spellings: Sequence[str]) -> Column:
    """Whether a category has one of its spellings."""
    return F.coalesce(value.isin(*spellings), F.lit(False))


def denied(value: Column, deny: Sequence[str]) -> Column:
    """Whether a value is on a deny-list, case-sensitively; null isn't."""
    return F.coalesce(value.isin(*deny), F.lit(False))


def safe_id(value: Column) -> Column:
    """Letters, digits, dots and hyphens, and not dots alone."""
    return value.rlike(r"^[A-Za-z0-9.-]+$") & ~value.rlike(r"^\.+$")


def violated(rules: Mapping[str, Column]) -> Column:
    """Names of the rules whose condition doesn't hold (null counts as not), in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def first_failing(rules: Mapping[str, Column]) -> Column:
    """Name of the first rule that doesn't hold, else null."""
    return F.try_element_at(violated(rules), F.lit(1))


def image_rules(content_type: Column, size: Column, width: Column, height: Column) -> dict[str, Column]:
    """Rules of an image file: type, least bytes, least size, ratio."""
    return {
        "type": content_type.isin("image/jpeg", "image/png", "image/webp"),
        "bytes": size >= 2000,
        "dimensions": (width >= 200) & (height >= 280),
        "ratio": (width / height).between(0.63, 0.80),
    }


def card_shaped(width: Column, height: Column, low: float = 0.6, high: float = 0.85) -> Column:
    """Ratio test in which unknown dimensions pass."""
    return F.coalesce(F.try_divide(width, height).between(low, high), F.lit(True))


def has_no_image(*fields: Column) -> Column:
    """All image fields null or empty."""
    return F.coalesce(*[blank(f) for f in fields]).isNull()


def language_tier(language: Column, covered: Sequence[str], western: Sequence[str]) -> Column:
    """covered or live, and the root folder: ``covered/western``."""
    return F.concat_ws("/", F.when(language.isin(*covered), "covered").otherwise("live"), F.when(language.isin(*western), "western").otherwise("asian"))


def is_external_url(url: Column, own_host: str) -> Column:
    """Whether the host differs from our own; false if it can't be parsed."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")) != own_host, F.lit(False))


def identity(*parts: Column) -> Column:
    """``language/set/id``."""
    return F.concat_ws("/", *parts)


def trainer_gallery(set_id: Column) -> Column:
    """Set ids of the gallery subsets end in lower-case ``tg``."""
    return F.coalesce(set_id.endswith("tg"), F.lit(False))
