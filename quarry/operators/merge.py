"""Keyed merges with guards: enrichment, back-fill, supplements, and what came of each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import blank
from quarry.operators.keyed import first_wins


def missing_value(value: Column, placeholders: Sequence[str] = ("Unknown", "None")) -> Column:
    """Null, empty or a placeholder."""
    return F.coalesce(blank(value).isNull() | value.isin(*placeholders), F.lit(True))


def enrich_left(df: DataFrame, other: DataFrame, keys: Sequence[str], fields: Sequence[str], placeholders: Sequence[str] = ("Unknown", "None")) -> DataFrame:
    """``fields`` of ``df``, filled from ``other`` by key where they are missing. ``other`` has one row a key."""
    filling = other.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    out = df.join(filling, list(keys), "left")
    for f in fields:
        kind = dict(df.dtypes)[f]
        gone = missing_value(F.col(f), placeholders) if kind == "string" else F.col(f).isNull()
        out = out.withColumn(f, F.when(gone, F.coalesce(F.col(f"_{f}"), F.col(f))).otherwise(F.col(f))).drop(f"_{f}")
    return out.select(*df.columns)


def same_print_fill(target: DataFrame, source: DataFrame, key: str, field: str, order: Sequence[str]) -> DataFrame:
    """``target`` with ``field`` filled by key, and ``outcome``: had, filled, missing.

    The source's first row of a key counts, even if it has no value: then nothing is filled.
    """
    first = first_wins(source, [key], *order).select(key, F.col(field).alias("_fill"))
    out = target.join(first, key, "left")
    outcome = F.when(F.col(field).isNotNull(), "had").when(F.col("_fill").isNotNull(), "filled").otherwise("missing")
    return out.withColumn("outcome", outcome).withColumn(field, F.coalesce(field, "_fill")).drop("_fill")


def merge_supplemental(existing: DataFrame, batch: DataFrame, key: str, grain: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose key is new, first of each grain; with ``outcome`` added, overlap or repeated."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    marked = batch.join(known, key, "left")
    place = F.row_number().over(Window.partitionBy(*grain).orderBy(*order))
    return marked.withColumn("outcome", F.when(F.col("_known"), "overlap").when(place > 1, "repeated").otherwise("added")).drop("_known")


def overlap_guard(existing: DataFrame, batch: DataFrame, group: str, key: str, supplement: bool) -> DataFrame:
    """Per group: rows of the batch, how many overlap, and whether it is refused.

    A supplement is refused if it overlaps too little (under 10 % and under 50 rows), a new set if it overlaps too much
    (over 50 % and over 5 rows).
    """
    known = existing.select(key).distinct().withColumn("_known", F.lit(1))
    counts = batch.join(known, key, "left").groupBy(group).agg(F.count("*").alias("n_rows"), F.count("_known").alias("n_overlap"))
    share = F.col("n_overlap") / F.col("n_rows")
    refused = (share < 0.1) & (F.col("n_overlap") < 50) if supplement else (share > 0.5) & (F.col("n_overlap") > 5)
    return counts.withColumn("refused", refused)


def merge_new_sets(existing: DataFrame, batch: DataFrame, group: str, key: str, order: Sequence[str], excluded: Sequence = ()) -> DataFrame:
    """Rows of ``batch`` with ``outcome``: excluded, refused (its set overlaps too much), overlap, repeated or added."""
    gate = overlap_guard(existing, batch, group, key, supplement=False).select(group, "refused")
    rows = merge_supplemental(existing, batch, key, [key], order).join(gate, group)
    return rows.withColumn("outcome", F.when(F.col(group).isin(*excluded), "excluded").when(F.col("refused"), "refused").otherwise(F.col("outcome"))).drop("refused")


def apply_enrichment(df: DataFrame, fills: DataFrame, key: str, if_missing: str, always: str) -> DataFrame:
    """``if_missing`` is filled where it is blank or unknown, ``always`` overwritten where a fill has it; by key."""
    f = fills.select(F.col(key).alias("_key"), F.col(if_missing).alias("_a"), F.col(always).alias("_b"))
    out = df.join(f, df[key] == f["_key"], "left")
    value = F.when(missing_value(F.col(if_missing), ("Unknown",)), F.coalesce(blank(F.col("_a")), F.col(if_missing))).otherwise(F.col(if_missing))
    return out.withColumn(if_missing, value).withColumn(always, F.coalesce(blank(F.col("_b")), F.col(always))).withColumn("touched", F.col("_key").isNotNull()).drop("_key", "_a", "_b")


def merge_images(existing: DataFrame, harvested: DataFrame, key: str, image: str) -> DataFrame:
    """Each harvested row's status, first that holds: not-found, already-had, not-resolved, filled."""
    held = existing.select(key, blank(F.col(image)).alias("_held"), F.lit(True).alias("_there"))
    out = harvested.join(held, key, "left")
    status = F.when(F.col("_there").isNull(), "not-found").when(F.col("_held").isNotNull(), "already-had").when(blank(F.col(image)).isNull(), "not-resolved").otherwise("filled")
    return out.withColumn("status", status).drop("_held", "_there")


def preserve_referenced(refreshed: DataFrame, previous: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """``refreshed`` plus rows of ``previous`` that it lost although something refers to them."""
    lost = previous.join(references.select(key).distinct(), key, "left_semi").join(refreshed.select(key), key, "left_anti")
    return refreshed.unionByName(lost)


def merge_by_id(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """Union by id: the right side's values win, the left side's positions stay; new ids follow in the right side's order."""
    values = [c for c in left.columns if c not in (key, position)]
    both = left.select(key, F.col(position).alias("_p"), F.struct(*values).alias("_l")).join(right.select(key, F.col(position).alias("_q"), F.struct(*values).alias("_r")), key, "full")
    return both.select(key, F.col("_p").isNull().alias("is_new"), F.coalesce("_p", "_q").alias(position), F.coalesce("_r", "_l").alias("_v")).select(key, "is_new", position, "_v.*")


def missing_not_held(wanted: DataFrame, held: DataFrame, name: str) -> DataFrame:
    """Wanted names that aren't held, whatever their case."""
    have = held.select(F.lower(name).alias("_name")).distinct()
    return wanted.join(have, F.lower(wanted[name]) == have["_name"], "left_anti")


def covered_first(primary: DataFrame, secondary: DataFrame, covered: DataFrame, group: str) -> DataFrame:
    """Groups that are covered answer from ``primary``, even with nothing; the others from ``secondary``."""
    own = covered.select(group).distinct()
    return primary.join(own, group, "left_semi").unionByName(secondary.join(own, group, "left_anti"))


def outcome_counts(df: DataFrame, column: str = "outcome", values: Sequence[str] = ()) -> DataFrame:
    """One row of counters, one for each outcome."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(v.replace("-", "_")) for v in values])
