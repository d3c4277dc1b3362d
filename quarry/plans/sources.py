"""Queries for sources, sinks and extraction.

Those that write use the shared folder and read back what they wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.match import match_prefix
from quarry.plans.tables import query
from quarry.sources import catalog as S
from quarry.sources import extract as E
from quarry.sources import snapshots as N
from quarry.sources.folders import scratch


@query("SELECT CAST(p_size AS STRING) AS key, p_partkey AS id, p_name AS name FROM part")
def s1_read_catalog(t):
    """A catalog file for each thousand parts, and one that is broken; files grow in number, not in length."""
    item = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    lists = t("part").groupBy(F.floor(F.col("p_partkey") / 1000).alias("file"), F.col("p_size").cast("string").alias("key")).agg(F.collect_list(item).alias("items"))
    texts = lists.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "items")))).alias("value"))
    broken = t("SELECT -1L AS file, '{\"1\": [' AS value")
    path = scratch(texts.sparkSession, "catalog")
    texts.unionByName(broken).repartition("file").write.partitionBy("file").text(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    return S.read_catalog(texts.sparkSession, path, schema, "*.txt").drop("pos")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997")
def s2_read_catalog_partition(t):
    orders = t("orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"), "o_orderstatus")
    path = scratch(orders.sparkSession, "by-year")
    S.write_catalog(orders, path, ["y"])
    return S.read_catalog_partition(orders.sparkSession, path, y=1997).select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS name, s_suppkey % 7 = 0 AS broken FROM supplier")
def s3_read_record_tree(t):
    """A folder with one record for each supplier, on one of 128 shelves; every seventh record is cut off.

    A shelf is written by one task, moved as one folder when the job commits, and listed by one task.
    """
    record = F.to_json(F.struct(F.col("s_name").alias("name")))
    value = F.when(F.col("s_suppkey") % 7 == 0, F.substring(record, 1, 6)).otherwise(record).alias("value")
    texts = t("supplier").select("s_suppkey", value, F.pmod(F.xxhash64("s_suppkey"), F.lit(128)).alias("shelf"))
    path = scratch(texts.sparkSession, "records")
    texts.repartition(128, "shelf").write.partitionBy("shelf", "s_suppkey").text(path)
    read = S.read_record_tree(texts.sparkSession, path, T.StructType([T.StructField("name", T.StringType())]), "*.txt")
    key = F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long")
    return read.select(key.alias("s_suppkey"), F.when(~F.col("broken"), F.col("record.name")).alias("name"), "broken")


@query("SELECT max(p_brand) AS latest FROM part WHERE p_brand LIKE 'Brand#1%'")
def s4_latest_snapshot(t):
    return S.latest(t("part"), "p_brand", "Brand#1")


@query("SELECT page_id, split_part(split_part(split_part(url, '/', 4), '?', 1), '#', 1) AS language FROM pages")
def s5_language_from_path(t):
    return t("pages").select("page_id", S.language_from_path(F.regexp_replace("url", "^https?://[^/]+|[?#].*$", "")).alias("language"))


@query("SELECT source, lang AS language, n AS name FROM (SELECT source, lang, CASE WHEN lang = 'de' THEN '' ELSE CAST(min(doc_id) AS STRING) END AS n FROM documents GROUP BY source, lang) WHERE n <> ''")
def s6_explode_languages(t):
    rows = t("documents").groupBy("source", "lang").agg(F.when(F.col("lang") == "de", "").otherwise(F.min("doc_id").cast("string")).alias("n"))
    maps = rows.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("names"))
    return S.explode_languages(maps, "names")


@query("SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_type = p.p_type AND q.p_partkey % 9 = 0) THEN 'img/' || p_brand || '/' || p_type END AS url FROM part p")
def s7_availability(t):
    index = t("part").where("p_partkey % 9 = 0")
    return S.availability(t("part").select("p_partkey", "p_brand", "p_type"), index, ["p_brand", "p_type"], "img").select("p_partkey", "url")


@query("SELECT o + 1 AS first, nxt - 1 AS last FROM (SELECT o_orderkey AS o, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS nxt FROM orders WHERE o_orderkey % 10 <> 3 AND o_orderkey % 17 > 1) WHERE nxt > o + 1")
def s8_dimension_gaps(t):
    return S.gaps(t("orders").where("o_orderkey % 10 <> 3 and o_orderkey % 17 > 1"), "o_orderkey")


@query("SELECT CAST(p_partkey + 1 AS INTEGER) AS species_id, p_name || '''' AS name FROM part")
def s8_read_species(t):
    # two languages; the numbers of one must have no gap
    part = t("part").select(F.expr("p_partkey + 1").alias("species_id"), F.concat("p_name", F.lit("’")).alias("name"))
    rows = part.select("species_id", F.lit("9").alias("language_id"), "name").unionByName(part.select("species_id", F.lit("1").alias("language_id"), F.upper("name").alias("name")))
    path = scratch(part.sparkSession, "species")
    rows.write.option("header", True).csv(path)
    return S.require_gapless(S.read_species(part.sparkSession, path, "9"), "species_id", part.count())


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 4 = 1 THEN lower(n_name) END AS other_name, CASE WHEN n_nationkey % 4 = 1 THEN 'renamed' ELSE 'missing' END AS issue FROM nation WHERE n_nationkey % 4 < 2")
def s9_dimension_diff(t):
    other = t("nation").where("n_nationkey % 4 <> 0").select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 1, F.lower("n_name")).otherwise(F.col("n_name")).alias("n_name"))
    return S.dimension_diff(t("nation"), other, "n_nationkey", "n_name")


@query("SELECT doc_id, i AS species FROM (SELECT doc_id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[0-9]+'), lambda d: length(d) < 10), lambda d: CAST(d AS BIGINT)))) AS i FROM documents WHERE lang = 'en') WHERE i BETWEEN 1 AND 999")
def s10_read_supplemental(t):
    docs = t("documents").withColumn("url", F.concat(F.lit("x/"), F.col("doc_id").cast("string")))
    return S.read_supplemental(docs, "lang", ["text"], "en", "text", "url", 1, 999).select("doc_id", "species")


@query("SELECT p_brand, p_type, count(*) AS n_cards, count(DISTINCT p_size) AS n_species FROM part GROUP BY p_brand, p_type")
def s11_write_catalog(t):
    part = t("part")
    path = scratch(part.sparkSession, "catalog-parts")
    S.write_catalog(part, path, ["p_brand", "p_type"])
    return S.catalog_stats(part.sparkSession.read.parquet(path), ["p_brand", "p_type"], "p_size")


@query("SELECT p_brand, count(*) AS n_cards, count(DISTINCT p_size) AS n_species, true AS stamped FROM part GROUP BY p_brand")
def s12_version_stamp(t):
    part = t("part")
    path = scratch(part.sparkSession, "stamped")
    S.write_catalog(part, f"{path}/cards", ["p_brand"])
    version = S.write_version(part.sparkSession, f"{path}/version")  # after the cards
    stats = S.catalog_stats(part.sparkSession.read.parquet(f"{path}/cards"), ["p_brand"], "p_size")
    return stats.crossJoin(version.select(F.col("version").isNotNull().alias("stamped")))  # one row


@query("""SELECT regexp_extract(url, '://([^/]+)', 1) AS host, count(CASE WHEN NOT contains(url, '?') AND page_id % 7 <> 0 THEN 1 END) AS records, count(CASE WHEN NOT contains(url, '?') AND page_id % 7 = 0 THEN 1 END) AS failures,
  count(CASE WHEN contains(url, '?') THEN 1 END) AS skipped, string_agg(CASE WHEN NOT contains(url, '?') AND page_id % 7 = 0 THEN CAST(page_id AS STRING) END, ',' ORDER BY CAST(page_id AS STRING)) AS failed FROM pages GROUP BY 1""")
def s13_publish_snapshot(t):
    """Two snapshots; the second one's manifest, held against the records that readers see, and its failures."""
    pages = t("pages").select("page_id", "url", F.regexp_extract("url", "://([^/]+)", 1).alias("host"))
    path = scratch(pages.sparkSession, "snapshots")
    for rows in (pages.where("page_id % 2 = 0"), pages):
        N.publish(rows, path, "host", F.when(F.col("page_id") % 7 == 0, "no image"), F.contains("url", F.lit("?")))
    seen = N.read_snapshot(pages.sparkSession, path).groupBy("host").agg(F.count("*").alias("seen"))
    failed = N.read_snapshot(pages.sparkSession, path, "failures").groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(F.col("page_id").cast("string"))), ",").alias("failed"))
    out = N.read_snapshot(pages.sparkSession, path, "manifest").join(seen, "host", "left").join(failed, "host", "left")
    return out.select("host", F.when(F.coalesce("seen", F.lit(0)) == F.col("records"), F.col("records")).alias("records"), "failures", "skipped", "failed")


@query("SELECT event_id, event_id % 3 <> 0 AS valid, CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 7 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END END AS k, CASE WHEN event_id % 3 <> 0 THEN event_type END AS kind FROM events")
def s14_export_import(t):
    rows = t("events").withColumn("k", F.when(F.col("event_id") % 2 != 0, F.get_json_object("props", "$.k").cast("long")))
    exported = S.export_collection(rows, "event_id", ["k", F.col("event_type").alias("kind")])
    payload = F.when(F.col("event_id") % 3 == 0, F.replace("payload", F.lit('"version":1'), F.lit('"version":9'))).otherwise(F.col("payload"))
    schema = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("k", T.LongType()), T.StructField("kind", T.StringType())])
    return S.import_collection(exported.withColumn("payload", payload), "payload", schema, 1, {"k": F.lit(7).cast("long")}).drop("payload")


@query("SELECT regexp_extract(url, '://([^/]+)', 1) AS set_id, min(url) AS path FROM pages WHERE len(string_split(url, '/')) = 5 GROUP BY 1")
def s16_set_index(t):
    return S.set_index(t("pages").select("url"), "url", 5, F.regexp_extract("url", "://([^/]+)", 1)).select("set_id", "path")


@query("SELECT split_part(rtrim(url, '/'), '/', -2) AS set_slug, split_part(rtrim(url, '/'), '/', -1) AS card_slug FROM pages")
def s17_slug_index(t):
    return S.slug_index(t("pages"), "url")


@query("SELECT 'type' AS field, p_type AS source, min(p_brand) AS target FROM part GROUP BY p_type")
def s17_read_translation(t):
    """A dictionary as it was written; that of an absent file adds nothing."""
    rows = t("part").groupBy(F.col("p_type").alias("source")).agg(F.min("p_brand").alias("target")).select(F.lit("type").alias("field"), "source", "target")
    path = scratch(rows.sparkSession, "dictionary")
    rows.write.json(path)
    return S.read_translation(rows.sparkSession, path).unionByName(S.read_translation(rows.sparkSession, None))


@query("SELECT CASE WHEN k % 2 = 0 THEN 'english' ELSE 'japanese' END AS source, source_id, set_id AS set_slug, 'c' || CAST(source_id AS STRING) AS card_slug FROM (SELECT *, source_id // 20 AS k FROM {source}) WHERE k % 3 <> 0")
def s17_load_match_sources(t):
    """Two sources, each with an old snapshot of other rows and a later one."""
    rows = t("source").select("source_id", F.concat(F.lit("en/"), "set_id", F.lit("/c"), F.col("source_id").cast("string"), F.lit("/")).alias("place"), F.floor(F.col("source_id") / 20).alias("k"))
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "sources")
    for when, part in (("2025-01-01", rows.where("k % 3 = 0")), ("2026-01-01", rows.where("k % 3 <> 0"))):
        for side, prefix in enumerate(("english-", "japanese-")):
            N.publish(part.where(F.col("k") % 2 == side), path, "k", snapshot=f"{prefix}{when}")
    found = N.load_match_sources(spark, path, {"english": "english-", "japanese": "japanese-"}, "place")
    tagged = [df.select(F.lit(source).alias("source"), "source_id", "set_slug", "card_slug") for source, df in found.items()]
    return tagged[0].unionByName(tagged[1])


#: Parts on a page of a brand's list, and the page of a part.
PAGE = "p_brand || CASE WHEN p_partkey // 1000 > 0 THEN ' ' || CAST(p_partkey // 1000 AS STRING) ELSE '' END"


def _wiki(t):
    """Wikitext pages made from parts: the set list of each brand, a page for each thousand part keys."""
    number = F.floor(F.col("p_partkey") / 1000)
    title = F.concat("p_brand", F.when(number > 0, F.concat(F.lit(" "), number.cast("string"))).otherwise(""))
    line = F.concat(F.lit("{{list/entry|"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("|[["), "p_name", F.lit(" ("), "p_brand", F.lit(" "), F.col("p_size").cast("string"), F.lit(")]]|"), "p_type", F.lit("|Rare|}}"))
    head = F.concat(F.lit("{{Set Infobox|name="), "title", F.lit("|code=[[CS"), F.min("p_size").cast("string"), F.lit("|x]]}}\n== Cards ==\n"))
    body = F.concat_ws("\n", F.array_sort(F.collect_list(line)))
    return t("part").withColumn("title", title).groupBy("title").agg(F.concat(head, body, F.lit("\n=== More ===\n{{list/entry|broken\n== Rest ==\nend")).alias("wikitext"))


@query(f"SELECT {PAGE} AS title, lpad(CAST(p_partkey AS STRING), 5, '0') AS number, p_name AS name, p_name || ' (' || p_brand || ' ' || CAST(p_size AS STRING) || ')' AS article, p_type AS type, 'Rare' AS rarity FROM part")
def x1_extract_setlist_rows(t):
    return E.setlist_rows(_wiki(t)).select("title", "number", "name", "article", "type", "rarity")


@query(f"SELECT {PAGE} AS title, {PAGE} AS name, '[[CS' || CAST(min(p_size) AS STRING) || '|x]]' AS code FROM part GROUP BY {PAGE}")
def x2_extract_infobox(t):
    boxes = E.infobox(_wiki(t))
    return boxes.select("title", E.first_field(F.col("fields"), "title", "name").alias("name"), F.element_at("fields", F.lit("code")).alias("code"))


@query(f"SELECT {PAGE} AS title, count(*) + 2 AS n_lines FROM part GROUP BY {PAGE}")
def x3_extract_section(t):
    cut = _wiki(t).select("title", E.section(F.col("wikitext"), F.lit("Cards")).alias("text"))
    return cut.select("title", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def _element(start: str) -> str:
    """SQL of the text of the first element that begins so and holds no other."""
    text = f"regexp_extract(html, '{start}([^<]*)<', 1)"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    return f"CASE WHEN regexp_matches(html, '{start}') THEN trim(regexp_replace({text}, '\\s+', ' ', 'g')) END"


@query(f"""SELECT page_id, {_element("<title>")} AS title, {_element("<h1>")} AS heading, {_element('<div class="ad">')} AS ad, nullif(regexp_extract(html, '<img[^>]*src="([^"]*)"', 1), '') AS image FROM pages""")
def x4_extract_card_pages(t):
    return E.card_pages(t("pages"), "html", {"title": ("title", None), "heading": ("h1", None), "ad": ("div", "ad")}, ["page_id"])


@query("SELECT page_id, href FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1))) AS href FROM pages)")
def x5_extract_links(t):
    return E.links(t("pages"), "page_id", "html", r"/[^\"]*").select("page_id", "href")


@query(f"SELECT p_type AS job, count(*) AS n_rows, count(CASE WHEN p_name NOT LIKE 'red%' THEN 1 END) AS n_matched, string_agg(DISTINCT {PAGE}, ' / ' ORDER BY {PAGE}) AS set_names FROM part GROUP BY p_type")
def x6_harvest_pages(t):
    """Rows of the pages of each job, matched to species by the beginning of their names."""
    rows = E.setlist_rows(_wiki(t)).select(F.col("type").alias("job"), F.col("title").alias("set_name"), F.col("title").alias("page_pos"), "name", F.concat_ws("#", "title", "pos").alias("row"))
    species = t("SELECT split_part(p_name, ' ', 1) AS name, min(p_partkey) AS pos FROM {part} WHERE p_name NOT LIKE 'red%' GROUP BY split_part(p_name, ' ', 1)")
    return E.harvest_pages(match_prefix(rows, "row", "name", species, "name", "pos"), "job", "set_name", "matched")


@query("SELECT p_partkey FROM part WHERE p_size > 40 OR p_name LIKE '%bolt%'")
def x7_matcher_plug_in(t):
    matchers = [lambda: F.col("p_size") > 40, lambda: F.contains("p_name", F.lit("bolt"))]
    from quarry.functions.predicates import any_of

    return t("part").where(any_of([m() for m in matchers])).select("p_partkey")
