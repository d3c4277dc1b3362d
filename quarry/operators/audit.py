"""Audits and reports: vocabulary, coverage, agreement, duplicates, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import blank


def vocabulary(*columns: tuple[DataFrame, str]) -> DataFrame:
    """Distinct non-null values of several columns, sorted."""
    out = None
    for df, column in columns:
        one = df.select(F.col(column).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.where("value is not null").distinct().orderBy("value")


def change_report(df: DataFrame, raw: str, mapped: str, by: Sequence[str] = ()) -> DataFrame:
    """How often a raw value became another one; blank shows as ``(empty)``; most frequent first."""
    changed = df.where(~F.coalesce(F.col(raw) == F.col(mapped), F.lit(False)))
    counts = changed.groupBy(*by, F.coalesce(blank(F.col(raw)), F.lit("(empty)")).alias("raw"), F.col(mapped).alias("mapped")).agg(F.count("*").alias("n"))
    return counts.withColumn("unmapped", F.col("mapped") == "Unknown").orderBy(F.desc("n"), "raw")


def purge_report(df: DataFrame, group: str, purged: Column) -> DataFrame:
    """Rows before, removed and left by group."""
    counts = df.groupBy(group).agg(F.count("*").alias("n_before"), F.count_if(F.coalesce(purged, F.lit(False))).alias("n_removed"))
    return counts.withColumn("n_after", F.col("n_before") - F.col("n_removed"))


def build_stats(df: DataFrame, group: str, key: str, low: int, high: int) -> DataFrame:
    """Rows, distinct keys and their share of a range by group."""
    stats = df.groupBy(group).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.countDistinct(F.when(F.col(key).between(low, high), F.col(key))).alias("n_in_range"))
    return stats.withColumn("coverage", F.round(F.col("n_in_range") / (high - low + 1), 6))


def required_fields(df: DataFrame, group: str, id_col: str, fields: Sequence[str], examples: int = 5) -> DataFrame:
    """Per group and field: rows whose field is null or blank, and the smallest ids of some."""
    long = df.select(group, id_col, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("f")).select(group, id_col, "f.*")
    bad = long.where(blank(F.trim("value")).isNull())
    ranked = bad.withColumn("_n", F.row_number().over(Window.partitionBy(group, "field").orderBy(id_col)))
    counts = bad.groupBy(group, "field").agg(F.count("*").alias("n_missing"))
    few = ranked.where(F.col("_n") <= examples).groupBy(group, "field").agg(F.array_sort(F.collect_list(id_col)).alias("examples"))
    return counts.join(few, [group, "field"])


def coverage(built: DataFrame, raw: DataFrame, group: str, key: str) -> DataFrame:
    """Keys missing from the built table and keys that only it has, by group."""
    b = built.select(group, key).distinct().withColumn("_b", F.lit(1))
    r = raw.select(group, key).distinct().withColumn("_r", F.lit(1))
    return b.join(r, [group, key], "full").groupBy(group).agg(F.count_if(F.col("_b").isNull()).alias("n_missing"), F.count_if(F.col("_r").isNull()).alias("n_extra"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with the side they are on."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def status_counts(df: DataFrame, by: str, status: str, values: Sequence[str]) -> DataFrame:
    """One column for each status, one row for each group."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col(status) == v).alias(v.replace("-", "_")) for v in values])


def name_agreement(ours: Column, theirs: Column, label: Column) -> Column:
    """exact, variant (one holds the other, or ours holds the species), mismatch; unknown without a second name."""
    a, b = F.lower(F.trim(ours)), F.lower(F.trim(theirs))
    return F.when(blank(b).isNull(), "unknown").when(a == b, "exact").when(F.contains(a, b) | F.contains(b, a) | F.contains(a, F.lower(label)) & F.contains(b, F.lower(label)), "variant").otherwise("mismatch")


def label_pairs(df: DataFrame, ours: str, theirs: str) -> DataFrame:
    """How often two sources' labels meet, most frequent first."""
    return df.groupBy(ours, theirs).agg(F.count("*").alias("n")).orderBy(F.desc("n"), ours, theirs)


def external_hosts(df: DataFrame, fields: Sequence[str], language: str, own_host: str) -> DataFrame:
    """Per host and language: URLs of foreign hosts over all fields, and distinct URLs."""
    urls = df.select(language, F.explode(F.array(*fields)).alias("url")).withColumn("host", F.try_parse_url("url", F.lit("HOST")))
    return urls.where(F.col("host").isNotNull() & (F.col("host") != own_host)).groupBy("host", language).agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"))


def duplicate_groups(df: DataFrame, within: Sequence[str], content: str) -> DataFrame:
    """Rows whose content another row of the same group has too, with the group's size; rows without content are skipped."""
    rows = df.where(F.col(content).isNotNull()).withColumn("_hash", F.sha2(F.col(content), 256))
    sizes = rows.groupBy(*within, "_hash").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return rows.join(sizes, [*within, "_hash"]).withColumnRenamed("_hash", "hash")


def clear_duplicates(df: DataFrame, members: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``df`` with the fields of every member nulled, and what stood there before."""
    hit = members.select(key, F.lit(True).alias("_hit"))
    out = df.join(hit, key, "left")
    for f in fields:
        out = out.withColumn(f"previous_{f}", F.when(F.col("_hit"), F.col(f))).withColumn(f, F.when(F.col("_hit").isNull(), F.col(f)))
    return out.drop("_hit")


def first_release(df: DataFrame, name: str, date: Column) -> DataFrame:
    """Earliest date of each name; names without one come last."""
    return df.groupBy(name).agg(F.coalesce(F.date_format(F.min(date), "yyyy-MM-dd"), F.lit("9999-99-99")).alias("first_date")).orderBy("first_date", name)


def match_rate(held: DataFrame, parsed: DataFrame, group: str, key: str, threshold: float = 0.3) -> DataFrame:
    """Share of held rows with a key that the parsed list has, by group, and whether that passes."""
    there = parsed.select(group, key).distinct().withColumn("_hit", F.lit(1))
    rate = held.where(F.col(key).isNotNull()).join(there, [group, key], "left").groupBy(group).agg(F.round(F.count("_hit") / F.count("*"), 6).alias("rate"))
    return rate.withColumn("passes", F.col("rate") >= threshold)


def availability_buckets(wanted: DataFrame, held: DataFrame, group: str, in_language: Column) -> DataFrame:
    """Each wanted set: wiki-needed if unknown, not-printed if nothing is in the language, else sourced."""
    counts = held.groupBy(group).agg(F.count("*").alias("_n"), F.count_if(in_language).alias("n_in_language"))
    out = wanted.join(counts, group, "left")
    return out.select(group, F.coalesce("n_in_language", F.lit(0)).alias("n_in_language"), F.when(F.col("_n").isNull(), "wiki-needed").when(F.col("n_in_language") == 0, "not-printed").otherwise("sourced").alias("bucket"))


def fill_summary(df: DataFrame, first: str, second: str, filled: Column) -> DataFrame:
    """Candidates, filled and still missing by two levels, with subtotals and a total (null levels)."""
    return df.rollup(first, second).agg(F.count("*").alias("n_candidates"), F.count_if(filled).alias("n_filled"), F.count_if(~filled).alias("n_missing"))


def manifest(df: DataFrame, group: str, key: str, form: str, usual: str) -> DataFrame:
    """Sorted list of keys, and a map of those in an unusual format."""
    odd = F.collect_list(F.when(F.col(form) != usual, F.struct(key, form)))
    return df.groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("keys"), F.map_from_entries(F.array_sort(odd)).alias("formats"))


def group_membership(values: DataFrame, bridge: DataFrame, value: str) -> DataFrame:
    """Each value's first group by the groups' order, else ``unassigned``."""
    first = bridge.groupBy(value).agg(F.min_by("group_id", "pos").alias("group_id"))
    return values.select(value).distinct().join(first, value, "left").withColumn("group_id", F.coalesce("group_id", F.lit("unassigned")))


def newest(df: DataFrame, group: str, name: str, position: str) -> DataFrame:
    """Last name of each group by position."""
    return df.groupBy(group).agg(F.max_by(name, position).alias("newest"))


def version_label(names: DataFrame, group: str, newest_name: str, covered: DataFrame, version: DataFrame) -> DataFrame:
    """Each group's label: the date of the catalog's version for covered groups, else its newest name; null if there is none.

    ``version``: one row at most, with ``version`` as ISO time; any text that is no date gives none.
    """
    stamp = version.agg(F.max(F.to_date(F.try_to_timestamp(F.substring("version", 1, 10)))).alias("_date"))
    known = covered.select(group).distinct().withColumn("_covered", F.lit(True))
    label = F.when(F.col("_covered"), F.date_format("_date", "yyyy-MM-dd")).otherwise(F.col(newest_name))
    return names.join(known, group, "left").crossJoin(F.broadcast(stamp)).select(group, label.alias("label"))  # one row


def cross_check_outcomes(checked: DataFrame, by: str, kind: str, agreement: Column, ours: Column, theirs: Column) -> DataFrame:
    """What a source says of sampled rows, per ``by``: sampled, matched, via_fallback, conflict, ambiguous, no_match, and of
    the matched ones variant and mismatch (of names), label_differences (both have a label), label_absent, and clean: the
    names agree, and so do the labels where the source has any.
    """
    k, matched = F.col(kind), F.col(kind).isin("primary", "fallback-species")
    same = F.coalesce(F.lower(F.trim(ours)) == F.lower(F.trim(theirs)), F.lit(False))
    counts = {
        "matched": matched, "via_fallback": k == "fallback-species", "conflict": k == "species-conflict", "ambiguous": k == "ambiguous", "no_match": k == "none",
        "variant": matched & (agreement == "variant"), "mismatch": matched & (agreement == "mismatch"), "label_differences": matched & theirs.isNotNull() & ~same,
        "label_absent": matched & theirs.isNull(), "clean": matched & (agreement != "mismatch") & same,
    }
    return checked.groupBy(by).agg(F.count("*").alias("sampled"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def has_value(df: DataFrame, column: str, value) -> DataFrame:
    """One row: whether any row has the value; reads no further than the first."""
    return df.where(F.col(column) == value).limit(1).agg((F.count("*") > 0).alias("present"))
