"""Queries for keyed choices (W1-W3, W9-W14, W17) and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import keyed as K
from quarry.operators import match as X
from quarry.operators import merge as M
from quarry.plans.tables import query


@query("SELECT p_brand, p_size, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) = 1")
def w1_first_wins(t):
    return K.first_wins(t("part").select("p_brand", "p_size", "p_partkey", "p_retailprice"), ["p_brand", "p_size"], F.desc("p_retailprice"), "p_partkey").drop("p_retailprice")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w2_latest_wins(t):
    return K.latest_wins(t("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT p_partkey, 20000 + row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS number FROM part")
def w3_assign_surrogate(t):
    return K.assign_surrogate(t("part"), "p_brand", 20000, "p_size", "p_partkey").select("p_partkey", F.col("number").cast("long"))


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 25 AS chunk FROM orders")
def w9_chunk_queue(t):
    return K.chunk_queue(t("orders"), 25, "o_orderstatus", "o_orderkey").select("o_orderkey", F.col("chunk").cast("long"))


@query("SELECT id, species FROM {cards} WHERE coalesce(image, '') = ''")
def w10_image_queue(t):
    return t("cards").where(M.missing_value(F.col("image"), ("Unknown",))).orderBy("species", "pos").select("id", "species")


@query("SELECT set_id, string_agg(local_id, ',' ORDER BY CAST(local_id AS INT), local_id, id) AS queue FROM {cards} WHERE coalesce(image, '') = '' GROUP BY set_id")
def w11_image_jobs(t):
    rows = t("cards").where(M.missing_value(F.col("image"))).groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct(F.col("local_id").cast("int").alias("n"), "local_id", "id"))).alias("q"))
    return rows.select("set_id", F.concat_ws(",", F.transform("q", lambda s: s["local_id"])).alias("queue"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name DESC, p_partkey DESC")
def w12_sort_rows(t):
    return K.sort_rows(t("part").select("p_partkey", "p_name"), F.col("p_name"), "p_partkey", descending=True)


@query("SELECT p_name, count(*) AS n, min(p_partkey) AS first_position FROM part GROUP BY p_name ORDER BY n DESC, first_position LIMIT 8")
def w13_top_k_counts(t):
    return K.top_k_counts(t("part"), "p_name", "p_partkey")


@query("SELECT p_size, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY md5('s1:' || CAST(p_size AS STRING) || ':' || CAST(p_partkey AS STRING)), p_partkey) = 1")
def w14_reproducible_sample(t):
    return K.reproducible_sample(t("part"), "p_size", "p_partkey", "s1").select("p_size", "p_partkey")


@query("""WITH f AS (SELECT p_size, p_partkey, p_partkey // 16 AS unit FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) = 1),
  u AS (SELECT unit, sum(count(*)) OVER (ORDER BY unit) - count(*) AS before FROM f GROUP BY unit)
  SELECT p_size, p_partkey FROM f JOIN u USING (unit) WHERE before < 30""")
def w17_limit_distinct(t):
    rows = t("part").select("p_size", "p_partkey", F.floor(F.col("p_partkey") / 16).alias("unit"))
    return K.limit_distinct(rows, "p_size", 30, "unit", "p_partkey").select("p_size", "p_partkey")


@query("SELECT c.id, CASE WHEN coalesce(c.image, '') = '' THEN coalesce(s.image, c.image) ELSE c.image END AS image, CASE WHEN c.rarity IN ('', 'Unknown') THEN coalesce(s.rarity, c.rarity) ELSE c.rarity END AS rarity FROM {cards} c LEFT JOIN {source} s ON s.source_id = c.id * 10")
def j1_enrich_left(t):
    other = t("source").select((F.col("source_id") / 10).cast("long").alias("id"), "image", "rarity")
    return M.enrich_left(t("cards").select("id", "image", "rarity"), other, ["id"], ["image", "rarity"])


@query("""WITH s AS (SELECT p_name AS k, p_retailprice AS fill FROM part WHERE p_partkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1)
  SELECT p_partkey, coalesce(price, CASE WHEN CAST(floor(fill) AS INT) % 2 = 0 THEN fill END) AS price, CASE WHEN price IS NOT NULL THEN 'had' WHEN CAST(floor(fill) AS INT) % 2 = 0 THEN 'filled' ELSE 'missing' END AS outcome
  FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS price FROM part) LEFT JOIN s ON k = p_name""")
def j5_same_print_fill(t):
    target = t("part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("price"))
    source = t("part").where("p_partkey % 3 = 0").select("p_name", "p_partkey", F.expr("if(cast(floor(p_retailprice) as int) % 2 = 0, p_retailprice, null)").alias("price"))
    return M.same_print_fill(target, source, "p_name", "price", ["p_partkey"]).select("p_partkey", "price", "outcome")


HALVES = "SELECT p_partkey, p_brand, p_size, p_brand || '/' || CAST(p_size AS STRING) AS k FROM part WHERE p_partkey % 3 {0} 0"


@query(f"""SELECT b.p_partkey, CASE WHEN e.k IS NOT NULL THEN 'overlap' WHEN row_number() OVER (PARTITION BY b.k, b.p_size ORDER BY b.p_partkey) > 1 THEN 'repeated' ELSE 'added' END AS outcome
  FROM ({HALVES.format('<>')}) b LEFT JOIN (SELECT DISTINCT k FROM ({HALVES.format('=')})) e ON e.k = b.k""")
def j6_merge_supplemental(t):
    rows = t("part").select("p_partkey", "p_brand", "p_size", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("k"))
    return M.merge_supplemental(rows.where("p_partkey % 3 = 0"), rows.where("p_partkey % 3 <> 0"), "k", ["k", "p_size"], ["p_partkey"]).select("p_partkey", "outcome")


@query(f"""SELECT b.p_brand, count(*) AS n_rows, count(e.k) AS n_overlap, count(e.k) * 1.0 / count(*) > 0.5 AND count(e.k) > 5 AS refused
  FROM ({HALVES.format('<>')}) b LEFT JOIN (SELECT DISTINCT k FROM ({HALVES.format('=')})) e ON e.k = b.k GROUP BY b.p_brand""")
def j7_overlap_guard(t):
    rows = t("part").select("p_partkey", "p_brand", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("k"))
    return M.overlap_guard(rows.where("p_partkey % 3 = 0"), rows.where("p_partkey % 3 <> 0"), "p_brand", "k", supplement=False)


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 25 THEN 2 ELSE 3 END AS generation FROM part WHERE p_size <= 40")
def j8_range_join(t):
    bands = F.broadcast(t("SELECT * FROM VALUES (1, 1, 10), (2, 11, 25), (3, 26, 40) AS v(generation, low, high)"))
    return t("part").join(bands, F.col("p_size").between(F.col("low"), F.col("high"))).select("p_partkey", "generation")


@query(f"""WITH b AS ({HALVES.format('<>')}), e AS (SELECT DISTINCT k FROM ({HALVES.format('=')})),
  g AS (SELECT b.p_brand, count(e.k) * 1.0 / count(*) > 0.5 AND count(e.k) > 5 AS refused FROM b LEFT JOIN e ON e.k = b.k GROUP BY b.p_brand),
  m AS (SELECT b.*, CASE WHEN b.p_brand IN ('Brand#3') THEN 'excluded' WHEN refused THEN 'refused' WHEN e.k IS NOT NULL THEN 'overlap' WHEN row_number() OVER (PARTITION BY b.k ORDER BY b.p_partkey) > 1 THEN 'repeated' ELSE 'added' END AS outcome FROM b JOIN g USING (p_brand) LEFT JOIN e ON e.k = b.k)
  SELECT p_partkey, outcome FROM m""")
def j9_merge_new_sets(t):
    rows = t("part").select("p_partkey", "p_brand", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("k"))
    return M.merge_new_sets(rows.where("p_partkey % 3 = 0"), rows.where("p_partkey % 3 <> 0"), "p_brand", "k", ["p_partkey"], ["Brand#3"]).select("p_partkey", "outcome")


@query("SELECT c.id, CASE WHEN c.rarity IN ('', 'Unknown') THEN coalesce(s.rarity, c.rarity) ELSE c.rarity END AS rarity, coalesce(s.name, c.set_id) AS set_id, s.source_id IS NOT NULL AS touched FROM {cards} c LEFT JOIN {source} s ON s.source_id = c.id * 10")
def j10_apply_enrichment(t):
    fills = t("source").select((F.col("source_id") / 10).cast("long").alias("id"), "rarity", F.col("name").alias("set_id"))
    return M.apply_enrichment(t("cards").select("id", "rarity", "set_id"), fills, "id", "rarity", "set_id")


MERGED = """SELECT h.id, CASE WHEN c.id IS NULL THEN 'not-found' WHEN coalesce(c.image, '') <> '' THEN 'already-had' WHEN coalesce(h.image, '') = '' THEN 'not-resolved' ELSE 'filled' END AS status
  FROM (SELECT source_id * 10 AS id, CASE WHEN source_id % 8 = 0 THEN '' ELSE image END AS image FROM (SELECT CAST(source_id / 100 AS BIGINT) AS source_id, image FROM {source} WHERE source_id % 100 = 0) UNION ALL SELECT -1, 'x') h LEFT JOIN {cards} c ON c.id = h.id"""


def _merged(t):
    harvested = t("SELECT source_id * 10 AS id, CASE WHEN source_id % 8 = 0 THEN '' ELSE image END AS image FROM (SELECT CAST(source_id / 100 AS BIGINT) AS source_id, image FROM {source} WHERE source_id % 100 = 0) UNION ALL SELECT -1, 'x'")
    return M.merge_images(t("cards").select("id", "image"), harvested, "id", "image")


@query(MERGED)
def j11_merge_images(t):
    return _merged(t).select("id", "status")


@query(f"SELECT count(*) FILTER (status = 'filled') AS filled, count(*) FILTER (status = 'already-had') AS already_had, count(*) FILTER (status = 'not-found') AS not_found, count(*) FILTER (status = 'not-resolved') AS not_resolved FROM ({MERGED})")
def a21_merge_outcome(t):
    return M.outcome_counts(_merged(t), "status", ["filled", "already-had", "not-found", "not-resolved"])


@query("SELECT id FROM {cards} WHERE id % 4 <> 0 UNION ALL SELECT id FROM {cards} WHERE id % 4 = 0 AND id IN (SELECT card_id FROM {owned})")
def j22_preserve_referenced(t):
    cards = t("cards").select("id")
    return M.preserve_referenced(cards.where("id % 4 <> 0"), cards, t("owned").select(F.col("card_id").alias("id")), "id")


@query("SELECT c.id AS card_id, nullif(s.rarity, 'PROMO') AS rarity FROM {cards} c JOIN (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY set_id, CAST(local_id AS INT) ORDER BY source_id) = 1) s ON s.set_id = c.set_id AND CAST(s.local_id AS INT) = CAST(c.local_id AS INT) WHERE s.rarity <> 'PROMO'")
def j25_enrichment_fills(t):
    key = F.concat_ws("/", "set_id", F.col("local_id").cast("int").cast("string")).alias("k")
    held = t("cards").select(F.col("id").alias("card_id"), key)
    parsed = t("source").select(key, "source_id", F.when(F.col("rarity") == "PROMO", "").otherwise(F.col("rarity")).alias("rarity"))
    return X.enrichment_fills(held, parsed, "k", ["source_id"], ["rarity"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_brand END AS set_name FROM part")
def j27_backfill_name(t):
    from quarry.functions.text import article_title, set_name_of_title

    names = t("source").select((F.col("source_id") / 10).cast("long").alias("p_partkey"), F.upper("name").alias("local_name"))
    title = set_name_of_title(article_title(F.col("p_brand"), F.lit("en")))
    return t("part").join(names, "p_partkey", "left").select("p_partkey", F.coalesce("local_name", title).alias("set_name"))


@query("SELECT DISTINCT p_brand FROM part WHERE lower(p_brand) NOT IN (SELECT DISTINCT lower(p_brand) FROM part WHERE p_size < 2 AND p_type = 'PROMO')")
def j28_missing_sets_not_held(t):
    held = t("part").where("p_size < 2 and p_type = 'PROMO'").select(F.upper("p_brand").alias("p_brand"))
    return M.missing_not_held(t("part").select("p_brand").distinct(), held, "p_brand")


@query("SELECT coalesce(a.id, b.id) AS id, a.id IS NULL AS is_new, coalesce(a.pos, b.pos) AS pos, coalesce(b.name, a.name) AS name FROM (SELECT id, pos, name FROM {cards} WHERE id % 3 <> 0) a FULL JOIN (SELECT id, pos + 1000000 AS pos, upper(name) AS name FROM {cards} WHERE id % 2 = 0) b ON a.id = b.id")
def j29_merge_by_id(t):
    cards = t("cards").select("id", "pos", "name")
    return M.merge_by_id(cards.where("id % 3 <> 0"), cards.where("id % 2 = 0").select("id", (F.col("pos") + 1000000).alias("pos"), F.upper("name").alias("name")), "id", "pos")


@query("""SELECT o_orderkey, coalesce(list_filter(ids, lambda i: i BETWEEN 3 AND 6)[1], 0) AS species, n FROM (SELECT l_orderkey AS o_orderkey, list(l_linenumber ORDER BY l_linenumber) AS ids, count(*) AS n FROM lineitem GROUP BY 1) WHERE len(list_filter(ids, lambda i: i BETWEEN 3 AND 6)) > 0""")
def j30_backfill(t):
    from quarry.functions.predicates import in_range_ids

    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"), F.count("*").alias("n"))
    first = F.try_element_at(in_range_ids(F.col("ids"), [(3, 6)]), F.lit(1))
    return rows.withColumn("species", first).where("species is not null").select("o_orderkey", "species", "n")


@query("SELECT s_suppkey, 'primary' AS via FROM supplier WHERE s_nationkey < 10 AND s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'secondary' FROM supplier WHERE s_nationkey >= 10")
def j31_prints_static_first(t):
    s = t("supplier").select("s_suppkey", "s_nationkey")
    covered = t("nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("s_nationkey"))
    return M.covered_first(s.where("s_suppkey % 2 = 0").withColumn("via", F.lit("primary")), s.withColumn("via", F.lit("secondary")), covered, "s_nationkey").select("s_suppkey", "via")
