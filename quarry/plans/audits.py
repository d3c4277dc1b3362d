"""Queries for audits and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import audit as A
from quarry.plans.tables import query
from quarry.sources import catalog as S
from quarry.sources.folders import scratch

MAPPED = "SELECT id, set_id, rarity AS raw, CASE rarity WHEN 'ECONOMY' THEN 'Common' WHEN 'SMALL' THEN 'Common' WHEN '' THEN 'Unknown' WHEN 'MEDIUM' THEN 'Unknown' ELSE rarity END AS mapped FROM {cards}"


@query("SELECT p_type AS value FROM part UNION SELECT c_mktsegment FROM customer")
def a6_rarity_vocabulary(t):
    return A.vocabulary((t("part"), "p_type"), (t("customer"), "c_mktsegment"))


@query(f"SELECT set_id, CASE raw WHEN '' THEN '(empty)' ELSE raw END AS raw, mapped, count(*) AS n, mapped = 'Unknown' AS unmapped FROM ({MAPPED}) WHERE raw <> mapped GROUP BY 1, 2, 3")
def a7_rarity_change_report(t):
    return A.change_report(t(MAPPED), "raw", "mapped", ["set_id"])


@query("SELECT p_brand, count(*) AS n_before, count(CASE WHEN p_type = 'PROMO' THEN 1 END) AS n_removed, count(CASE WHEN p_type <> 'PROMO' THEN 1 END) AS n_after FROM part GROUP BY p_brand")
def a8_purge_report(t):
    return A.purge_report(t("part"), "p_brand", F.col("p_type") == "PROMO")


@query("SELECT p_brand, count(*) AS n_rows, count(DISTINCT p_size) AS n_keys, count(DISTINCT CASE WHEN p_size BETWEEN 1 AND 30 THEN p_size END) AS n_in_range, round(count(DISTINCT CASE WHEN p_size BETWEEN 1 AND 30 THEN p_size END) / 30.0, 6) AS coverage FROM part GROUP BY p_brand")
def a9_build_stats(t):
    return A.build_stats(t("part"), "p_brand", "p_size", 1, 30)


@query("""WITH m AS (SELECT set_id, id, unnest(['rarity', 'image']) AS field, unnest([rarity, image]) AS value FROM {cards}), b AS (SELECT * FROM m WHERE value IS NULL OR trim(value) = '')
  SELECT set_id, field, count(*) AS n_missing, (SELECT string_agg(CAST(id AS STRING), ',' ORDER BY id) FROM (SELECT id FROM b x WHERE x.set_id = b.set_id AND x.field = b.field ORDER BY id LIMIT 5)) AS examples FROM b GROUP BY set_id, field""")
def a10_required_fields(t):
    return A.required_fields(t("cards"), "set_id", "id", ["rarity", "image", "name"]).withColumn("examples", F.concat_ws(",", F.transform("examples", lambda i: i.cast("string"))))


@query("WITH b AS (SELECT DISTINCT set_id, species FROM {cards} WHERE id % 3 <> 0), r AS (SELECT DISTINCT set_id, species FROM {source}) SELECT set_id, count(CASE WHEN b.species IS NULL THEN 1 END) AS n_missing, count(CASE WHEN r.species IS NULL THEN 1 END) AS n_extra FROM b FULL JOIN r USING (set_id, species) GROUP BY set_id")
def a10_coverage(t):
    return A.coverage(t("cards").where("id % 3 <> 0"), t("source"), "set_id", "species")


PAIRS = "SELECT c.id, c.set_id, c.name AS ours, CASE WHEN c.id % 8 = 0 THEN '' ELSE s.name END AS theirs, 'bolt' AS label, c.rarity AS our_rarity, s.rarity AS their_rarity FROM {cards} c JOIN {source} s ON s.source_id = c.id * 10"
AGREED = f"SELECT *, CASE WHEN trim(theirs) = '' THEN 'unknown' WHEN lower(ours) = lower(theirs) THEN 'exact' WHEN contains(lower(ours), lower(theirs)) OR contains(lower(theirs), lower(ours)) OR contains(lower(ours), 'bolt') AND contains(lower(theirs), 'bolt') THEN 'variant' ELSE 'mismatch' END AS agreement FROM ({PAIRS})"


def _agreed(t):
    return t(PAIRS).withColumn("agreement", A.name_agreement(F.col("ours"), F.col("theirs"), F.col("label")))


@query(f"SELECT set_id, count(*) AS n, count(CASE WHEN agreement = 'exact' THEN 1 END) AS exact, count(CASE WHEN agreement = 'variant' THEN 1 END) AS variant, count(CASE WHEN agreement = 'mismatch' THEN 1 END) AS mismatch, count(CASE WHEN agreement = 'unknown' THEN 1 END) AS unknown FROM ({AGREED}) GROUP BY set_id")
def a11_cross_check_report(t):
    return A.status_counts(_agreed(t), "set_id", "agreement", ["exact", "variant", "mismatch", "unknown"])


@query(f"SELECT id, agreement FROM ({AGREED})")
def a12_name_agreement(t):
    return _agreed(t).select("id", "agreement")


@query(f"SELECT our_rarity, their_rarity, count(*) AS n FROM ({PAIRS}) GROUP BY 1, 2")
def a13_label_pair_counts(t):
    return A.label_pairs(t(PAIRS), "our_rarity", "their_rarity")


@query("SELECT regexp_extract(u, '^https?://([^/?#]+)', 1) AS host, lang, count(*) AS n, count(DISTINCT u) AS n_urls FROM (SELECT CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS lang, unnest([url, url]) AS u FROM pages) WHERE regexp_extract(u, '^https?://([^/?#]+)', 1) <> 'therhe.example.org' GROUP BY 1, 2")
def a14_external_image_scan(t):
    pages = t("pages").select(F.when(F.col("page_id") % 2 == 0, "a").otherwise("b").alias("lang"), "url", F.col("url").alias("full"))
    return A.external_hosts(pages, ["url", "full"], "lang", "therhe.example.org")


DUPLICATES = "SELECT doc_id, source, sha256(text) AS hash, count(*) OVER (PARTITION BY source, sha256(text)) AS group_size FROM documents QUALIFY count(*) OVER (PARTITION BY source, sha256(text)) > 1"


@query(DUPLICATES)
def a15_duplicate_groups(t):
    return A.duplicate_groups(t("documents").select("doc_id", "source", "text"), ["source"], "text").drop("text")


@query(f"SELECT d.doc_id, CASE WHEN u.doc_id IS NULL THEN lang END AS lang, CASE WHEN u.doc_id IS NOT NULL THEN lang END AS previous_lang FROM documents d LEFT JOIN ({DUPLICATES}) u USING (doc_id)")
def a16_clear_duplicates(t):
    docs = t("documents")
    members = A.duplicate_groups(docs.select("doc_id", "source", "text"), ["source"], "text")
    return A.clear_duplicates(docs.select("doc_id", "lang"), members.select("doc_id"), "doc_id", ["lang"])


@query("SELECT p_name, coalesce(strftime(min(o_orderdate), '%Y-%m-%d'), '9999-99-99') AS first_date FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY p_name")
def a17_first_release_order(t):
    rows = t("part").join(t("lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return A.first_release(rows, "p_name", F.col("o_orderdate"))


@query("SELECT set_id, round(count(s.k) * 1.0 / count(*), 6) AS rate, round(count(s.k) * 1.0 / count(*), 6) >= 0.5 AS passes FROM {cards} LEFT JOIN (SELECT DISTINCT set_id, local_id AS k FROM {source}) s USING (set_id) WHERE false GROUP BY set_id UNION ALL SELECT c.set_id, round(count(s.k) * 1.0 / count(*), 6), round(count(s.k) * 1.0 / count(*), 6) >= 0.5 FROM {cards} c LEFT JOIN (SELECT DISTINCT set_id, '0' || local_id AS k FROM {source}) s ON s.set_id = c.set_id AND s.k = c.local_id GROUP BY c.set_id")
def a18_match_rate_gate(t):
    parsed = t("source").select("set_id", F.concat(F.lit("0"), "local_id").alias("local_id"))
    return A.match_rate(t("cards"), parsed, "set_id", "local_id", 0.5)


@query("SELECT w.p_brand, coalesce(n, 0) AS n_in_language, CASE WHEN h.p_brand IS NULL THEN 'wiki-needed' WHEN n = 0 THEN 'not-printed' ELSE 'sourced' END AS bucket FROM (SELECT DISTINCT p_brand FROM part) w LEFT JOIN (SELECT p_brand, count(CASE WHEN p_type = 'PROMO' AND p_size < 4 THEN 1 END) AS n FROM part WHERE p_partkey % 25 <> 3 AND p_brand <> 'Brand#7' GROUP BY p_brand) h USING (p_brand)")
def a19_availability_buckets(t):
    held = t("part").where("p_partkey % 25 <> 3 and p_brand <> 'Brand#7'")
    return A.availability_buckets(t("part").select("p_brand").distinct(), held, "p_brand", (F.col("p_type") == "PROMO") & (F.col("p_size") < 4))


@query("SELECT lang, count(*) AS scanned, count(CASE WHEN n_chars >= 500 THEN 1 END) AS written, count(DISTINCT CASE WHEN n_chars >= 500 THEN source END) AS n_sources FROM documents GROUP BY lang")
def a20_ingest_stats(t):
    ok = F.col("n_chars") >= 500
    return t("documents").groupBy("lang").agg(F.count("*").alias("scanned"), F.count_if(ok).alias("written"), F.countDistinct(F.when(ok, F.col("source"))).alias("n_sources"))


@query("SELECT p_brand, p_type, count(*) AS n_candidates, count(CASE WHEN p_size > 20 THEN 1 END) AS n_filled, count(CASE WHEN p_size <= 20 THEN 1 END) AS n_missing FROM part GROUP BY ROLLUP (p_brand, p_type)")
def a22_fill_summary(t):
    return A.fill_summary(t("part"), "p_brand", "p_type", F.col("p_size") > 20)


@query("SELECT l_returnflag, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS done, count(CASE WHEN l_linestatus <> 'F' THEN 1 END) AS remaining, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem GROUP BY l_returnflag")
def a23_mirror_summary(t):
    done = F.col("l_linestatus") == "F"
    return t("lineitem").groupBy("l_returnflag").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("remaining"), F.sum("l_quantity").cast("long").alias("bytes"))


@query("SELECT p_brand, string_agg(CAST(p_partkey AS STRING), ',' ORDER BY p_partkey) AS keys, coalesce(string_agg(CASE WHEN p_type = 'PROMO' THEN CAST(p_partkey AS STRING) || '=' || p_type END, ',' ORDER BY p_partkey), '') AS formats FROM part WHERE p_type IN ('SMALL', 'PROMO') GROUP BY p_brand")
def a24_sprite_manifest(t):
    rows = A.manifest(t("part").where("p_type in ('SMALL', 'PROMO')"), "p_brand", "p_partkey", "p_type", "SMALL")
    formats = F.transform(F.array_sort(F.map_entries("formats")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]))
    return rows.select("p_brand", F.concat_ws(",", F.transform("keys", lambda k: k.cast("string"))).alias("keys"), F.concat_ws(",", formats).alias("formats"))


@query("SELECT p_type, CASE p_type WHEN 'PROMO' THEN 'full' WHEN 'LARGE' THEN 'full' WHEN 'SMALL' THEN 'alt' ELSE 'unassigned' END AS group_id FROM (SELECT DISTINCT p_type FROM part)")
def a25_group_membership(t):
    bridge = t("SELECT * FROM VALUES ('full', 'PROMO', 0), ('full', 'LARGE', 0), ('alt', 'LARGE', 1), ('alt', 'SMALL', 1) AS v(group_id, p_type, pos)")
    return A.group_membership(t("part"), bridge, "p_type")


@query("SELECT p_brand, arg_max(p_name, p_partkey) AS newest FROM part GROUP BY p_brand")
def a26_newest_set(t):
    return A.newest(t("part"), "p_brand", "p_name", "p_partkey")


@query("SELECT p_brand, CASE WHEN p_brand LIKE '%2' THEN '2026-01-31' ELSE arg_max(p_name, p_partkey) END AS label FROM part GROUP BY p_brand")
def a26_version_label(t):
    names = A.newest(t("part"), "p_brand", "p_name", "p_partkey")
    version = t("SELECT '2026-01-31T10:00:00Z' AS version")
    return A.version_label(names, "p_brand", "newest", t("part").where(F.col("p_brand").endswith("2")), version)


@query("SELECT DISTINCT p_brand, p_type FROM part WHERE p_brand IN ('Brand#1', 'Brand#9')")
def a27_purge_partitions(t):
    deny = t("SELECT * FROM VALUES ('Brand#1'), ('Brand#9') AS v(p_brand)")
    return t("part").select("p_brand", "p_type").distinct().join(F.broadcast(deny), "p_brand", "left_semi").orderBy("p_type", "p_brand")


@query("SELECT count(*) > 0 AS present FROM documents WHERE lang = 'es'")
def a28_has_language(t):
    return A.has_value(t("documents"), "lang", "es")


GENERATIONS = "SELECT id, name, set_id, pos, CASE WHEN id % 10 = 3 THEN 'ja' ELSE 'en' END AS language, id % 3 + 1 AS generation FROM {cards} UNION ALL SELECT id - 1, name, set_id, pos, 'en', id % 3 + 1 FROM {cards} WHERE id % 4 = 1"


@query(f"SELECT id, name, generation FROM ({GENERATIONS}) WHERE language = 'en' AND contains(name, 'VMAX') QUALIFY row_number() OVER (PARTITION BY id ORDER BY generation DESC) = 1")
def a29_id_index(t):
    """VMAX cards of all written generations of a language; of an id that several have, the last generation's."""
    cards = t(GENERATIONS)
    path = scratch(cards.sparkSession, "generations")
    S.write_catalog(cards, path)
    rows = S.collect_by_pattern(cards.sparkSession, path, "en", "VMAX", ["id", "name"])
    return S.id_index(rows, "id").select("id", "name", F.col("generation").cast("long").alias("generation"))


@query("SELECT set_id, species, 'left' AS side FROM (SELECT set_id, species FROM {cards} EXCEPT SELECT set_id, species FROM {source}) UNION ALL SELECT set_id, species, 'right' FROM (SELECT set_id, species FROM {source} EXCEPT SELECT set_id, species FROM {cards})")
def u2_coverage_difference(t):
    return A.difference(t("cards").select("set_id", "species"), t("source").select("set_id", "species"))
