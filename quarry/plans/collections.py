"""Queries for collection analytics and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import collection as L
from quarry.plans.tables import query
from quarry.sources.folders import scratch
from quarry.streaming.state import collection_sink, latest_sink
from quarry.streaming.store import Keyed, VersionedStore

GROUPS = "SELECT * FROM VALUES ('full', 'PROMO', 0), ('full', 'LARGE', 0), ('alt', 'LARGE', 1), ('alt', 'SMALL', 1), ('off', 'ECONOMY', 2) AS v(group_id, rarity, pos)"
OVER = "SELECT id AS card_id, CASE WHEN id % 2 = 0 THEN 'off' ELSE 'alt' END AS group_id FROM {cards} WHERE id % 13 = 0"
MEGA = "regexp_matches(name, '^M[- ][A-Za-z].*[- ]EX$|^Mega[ -][A-Za-z].*\\b(ex|GX)$')"
AVAILABLE = f"SELECT c.* FROM {{cards}} c LEFT JOIN ({OVER}) o ON o.card_id = c.id WHERE CASE WHEN o.group_id IS NOT NULL THEN o.group_id = 'alt' WHEN set_id LIKE '%2' THEN true ELSE rarity IN ('PROMO', 'LARGE', 'SMALL') END OR {MEGA}"
SPECIES = "SELECT DISTINCT p_size AS species, CASE WHEN p_size <= 20 THEN 'one' ELSE 'two' END AS generation FROM {part}"


def _available(t):
    return L.available_cards(t("cards"), t(GROUPS), ["full", "alt", "mega"], t(OVER), F.when(F.col("set_id").endswith("2"), "alt"))


@query(f"WITH a AS ({AVAILABLE}), s AS ({SPECIES}), o AS (SELECT DISTINCT species FROM {{owned}}) SELECT generation, count(*) AS total, count(o.species) AS owned, count(CASE WHEN o.species IS NOT NULL OR s.species IN (SELECT species FROM a) THEN 1 END) AS possible, count(CASE WHEN o.species IS NOT NULL OR s.species IN (SELECT species FROM a) THEN 1 END) - count(o.species) AS missing FROM s LEFT JOIN o USING (species) GROUP BY generation")
def a1_collection_stats(t):
    return L.collection_stats(t(SPECIES), t("owned"), _available(t), "species", "generation")


@query("SELECT c_nationkey, count(*) AS n_rows, least(100.0, coalesce(round(count(*) * 100.0 / nullif(count(DISTINCT species), 0)), 0.0)) AS percent FROM {owned} JOIN customer ON c_custkey = owner GROUP BY c_nationkey")
def a2_completion_summary(t):
    rows = t("owned").join(t("customer"), F.col("c_custkey") == F.col("owner")).groupBy("c_nationkey")
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("species").alias("n")).select("c_nationkey", "n_rows", L.percent(F.col("n_rows"), F.col("n")).alias("percent"))


@query("SELECT owner, round(count(*) * 100.0 / 50, 6) AS percent FROM {owned} GROUP BY owner")
def a3_completion_percent(t):
    return t("owned").groupBy("owner").agg(F.round(F.coalesce(F.try_divide(F.count("*") * 100.0, F.lit(50)), F.lit(0.0)), 6).alias("percent"))


@query(f"SELECT species, count(*) AS n_available FROM ({AVAILABLE}) GROUP BY species")
def a4_available_cards(t):
    return _available(t).groupBy("species").agg(F.count("*").alias("n_available"))


@query(f"WITH a AS (SELECT species, count(*) AS n FROM ({AVAILABLE}) GROUP BY species) SELECT s.species, CASE WHEN s.species IN (SELECT species FROM {{owned}}) THEN 'owned' WHEN coalesce(n, 0) = 0 THEN 'unavailable' ELSE 'available' END AS state FROM ({SPECIES}) s LEFT JOIN a USING (species)")
def a5_tile_state(t):
    counts = _available(t).groupBy("species").agg(F.count("*").alias("n"))
    own = t("owned").select("species").distinct().withColumn("own", F.lit(True))
    rows = t(SPECIES).join(counts, "species", "left").join(own, "species", "left")
    return rows.select("species", L.tile_state(F.col("own").isNotNull(), F.coalesce("n", F.lit(0))).alias("state"))


ROWS = "SELECT owner, card_id, o.species, coalesce(s.species_name, '#' || CAST(o.species AS STRING)) AS species_name, c.card_name FROM {owned} o LEFT JOIN (SELECT p_size AS species, min(p_name) AS species_name FROM part WHERE p_size % 3 <> 0 GROUP BY p_size) s ON s.species = o.species LEFT JOIN (SELECT p_partkey, p_brand AS card_name FROM part WHERE p_partkey % 2 = 0) c ON c.p_partkey = card_id"


def _rows(t):
    species = t("part").where("p_size % 3 <> 0").groupBy(F.col("p_size").alias("species")).agg(F.min("p_name").alias("species_name"))
    cards = t("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("card_id"), F.col("p_brand").alias("card_name"))
    return L.collection_rows(t("owned"), species, cards, "species", "card_id")


@query(ROWS.replace("c.card_name FROM", "c.card_name, o.since FROM"))
def j2_collection_rows(t):
    return _rows(t).select("owner", "card_id", "species", "species_name", "card_name", "since")


@query(ROWS)
def j3_wishlist_rows(t):
    return _rows(t).select("owner", "card_id", "species", "species_name", "card_name")


@query("SELECT o.owner, o.species, c.name FROM {owned} o JOIN {cards} c ON c.id = o.card_id JOIN {source} s ON s.source_id = c.id * 10 WHERE o.species <= 25")
def j4_owned_card_by_slot(t):
    slots = t("part").where("p_size <= 25").select(F.col("p_size").alias("species")).distinct()
    images = t("source").select((F.col("source_id") / 10).cast("long").alias("id"))
    cards = t("cards").select("id", "name").join(images, "id", "left_semi")
    return t("owned").select("owner", "species", F.col("card_id").alias("id")).join(slots, "species").join(cards, "id").select("owner", "species", "name")


@query("SELECT p_partkey, i // 12 AS page, (i % 12) % 3 AS row, (i % 12) // 3 AS col FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part) WHERE i < 12 * 5")
def w4_binder_slots(t):
    from pyspark.sql import Window

    rows = t("part").select("p_partkey", (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("i"))
    return L.binder_slots(rows, "i", 3, 4, 5, by_column=True).drop("i")


@query("SELECT p_brand, (page + 1) // 2 AS spread, string_agg(CAST(page AS STRING), ',' ORDER BY page) AS pages FROM (SELECT DISTINCT p_brand, p_size // 4 AS page FROM part) GROUP BY 1, 2")
def w5_binder_spreads(t):
    pages = t("part").select("p_brand", F.floor(F.col("p_size") / 4).cast("int").alias("page")).distinct()
    return L.binder_spreads(pages, "page", ["p_brand"]).select("p_brand", "spread", F.concat_ws(",", F.transform("pages", lambda p: p.cast("string"))).alias("pages"))


@query("SELECT s_suppkey AS binder, 0 AS pos, s_nationkey AS species FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY n_nationkey) - 1, n_nationkey FROM supplier CROSS JOIN nation WHERE s_suppkey % 2 <> 0")
def w6_sequence(t):
    binders = t("supplier").select(F.col("s_suppkey").alias("binder"), F.when(F.col("s_suppkey") % 2 == 0, F.array("s_nationkey")).alias("custom"))
    return L.sequence_of(binders, "custom", t("nation").select(F.col("n_nationkey").alias("species")), "species")


ACTIONS = "SELECT user_id AS user, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'own' WHEN 'error' THEN 'unown' WHEN 'click' THEN 'wish' WHEN 'signup' THEN 'unwish' ELSE 'wish' END AS action, event_id % 5 AS species, CAST(event_id % 3 AS STRING) AS card_id FROM {events}"


#: The fold in SQL: a list of each user's and species' events in order, reduced from the empty state.
FOLD = f"""SELECT user, species, list_reduce(list_prepend({{'a': '', 'c': NULL, 'o': NULL, 'w': NULL}}, list({{'a': action, 'c': card_id, 'o': NULL, 'w': NULL}} ORDER BY seq)), lambda s, e: {{'a': '', 'c': NULL,
  'o': CASE e.a WHEN 'own' THEN e.c WHEN 'unown' THEN NULL ELSE s.o END, 'w': CASE e.a WHEN 'own' THEN NULL WHEN 'unwish' THEN NULL WHEN 'wish' THEN CASE WHEN s.w IS NULL THEN e.c WHEN s.w = e.c THEN NULL ELSE s.w END ELSE s.w END}}) AS s
  FROM ({ACTIONS}) GROUP BY user, species"""


@query(f"SELECT user, kind, species, card_id FROM (SELECT user, 'owned' AS kind, species, s.o AS card_id FROM ({FOLD}) UNION ALL SELECT user, 'wish', species, s.w FROM ({FOLD})) WHERE card_id IS NOT NULL")
def t1_collection_state(t):
    return L.collection_state(t(ACTIONS))


def _in_files(df, order, n, folder):
    """A stream over ``df``, a file for each of ``n`` ranges of ``order``; their times are their order."""
    spark, top = df.sparkSession, (df.agg(F.max(order)).first()[0] or 0) + 1
    for k in range(n):
        df.where(F.floor(F.col(order) * n / top) == k).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


@query(f"SELECT user, species, s.o AS owned, s.w AS wish FROM ({FOLD}) WHERE s.o IS NOT NULL OR s.w IS NOT NULL")
def t1_collection_stream(t):
    """The events as a stream of three files; each micro-batch is folded on from the store's state."""
    events = t(ACTIONS)
    spark, folder = events.sparkSession, scratch(events.sparkSession, "collection")
    store = VersionedStore(spark, f"{folder}/store", {"state": Keyed("user long, species long, owned string, wish string, seq long", ["user", "species"], ["seq"])}, buckets=4)
    collection_sink(_in_files(events, "seq", 3, f"{folder}/events"), store, "state", f"{folder}/checkpoint").awaitTermination()
    return store.read("state").where("owned is not null or wish is not null").drop("seq")


@query(f"SELECT user, arg_max(action, seq) AS action, max(seq) AS seq FROM ({ACTIONS}) GROUP BY user")
def w2_latest_stream(t):
    """The last event of each user, kept up to date by a stream of three files."""
    events = t(ACTIONS).select("user", "action", "seq")
    spark, folder = events.sparkSession, scratch(events.sparkSession, "latest")
    store = VersionedStore(spark, f"{folder}/store", {"last": Keyed("user long, action string, seq long", ["user"], ["seq"])}, buckets=4)
    latest_sink(_in_files(events, "seq", 3, f"{folder}/events"), store, "last", f"{folder}/checkpoint").awaitTermination()
    return store.read("last")


@query(f"SELECT user, species, card_id FROM (SELECT user, species, action, card_id FROM ({ACTIONS}) WHERE action IN ('own', 'unown') QUALIFY row_number() OVER (PARTITION BY user, species ORDER BY seq DESC) = 1) WHERE action = 'own'")
def t1_owned_state(t):
    return L.collection_state(t(ACTIONS)).where("kind = 'owned'").select("user", "species", "card_id")
