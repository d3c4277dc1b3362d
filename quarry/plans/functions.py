"""Queries for predicates (F), scalar functions and classification (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import classify as C
from quarry.functions import predicates as P
from quarry.functions import text as T
from quarry.plans.tables import query

CARD = "{cards}"
TYPES = ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")


@query("SELECT l_orderkey, n AS species FROM (SELECT l_orderkey, l_linenumber AS n FROM lineitem) WHERE n BETWEEN 2 AND 5")
def f1_record_to_rows(t):
    orders = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("ids"))
    return P.record_to_rows(orders, "ids", 2, 5).select("l_orderkey", "species")


@query("SELECT p_partkey, array_to_string(list_filter([p_size, p_size + 10, p_size], lambda x: x BETWEEN 1 AND 5 OR x BETWEEN 20 AND 30), ',') AS ids FROM part")
def f2_in_range_ids(t):
    ids = P.in_range_ids(F.array("p_size", F.col("p_size") + 10, "p_size"), [(1, 5), (20, 30)])
    return t("part").select("p_partkey", F.concat_ws(",", F.transform(ids, lambda i: i.cast("string"))).alias("ids"))


@query("SELECT c_custkey, coalesce(c_mktsegment IN ('BUILDING', 'Building'), false) AS is_category FROM customer")
def f3_category_filter(t):
    return t("customer").select("c_custkey", P.category(F.col("c_mktsegment"), ["BUILDING", "Building"]).alias("is_category"))


@query("SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#12', 'brand#3')")
def f4_exclude_sets(t):
    return t("part").where(~P.denied(F.col("p_brand"), ["Brand#1", "Brand#12", "brand#3"])).select("p_partkey")


@query("SELECT page_id FROM pages WHERE NOT contains(url, '/de/')")
def f5_exclude_by_url_marker(t):
    return t("pages").where(~F.contains("url", F.lit("/de/"))).select("page_id")


@query("SELECT id, regexp_matches(c, '^[A-Za-z0-9.-]+$') AND NOT regexp_matches(c, '^\\.+$') AS safe FROM (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '..' WHEN 2 THEN 'a.b-' || CAST(c_custkey AS STRING) ELSE '' END AS c FROM customer)")
def f6_safe_id(t):
    rows = t("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '..' WHEN 2 THEN 'a.b-' || CAST(c_custkey AS STRING) ELSE '' END AS c FROM {customer}")
    return rows.select("id", P.safe_id(F.col("c")).alias("safe"))


@query("SELECT s_suppkey, concat_ws(',', CASE WHEN NOT regexp_matches(s_name, '^Supplier#[0-9]+$') THEN 'name' END, CASE WHEN NOT s_acctbal >= 0 THEN 'balance' END, CASE WHEN NOT s_nationkey < 20 THEN 'nation' END) AS violated FROM supplier")
def f7_validate_source(t):
    rules = {"name": F.col("s_name").rlike("^Supplier#[0-9]+$"), "balance": F.col("s_acctbal") >= 0, "nation": F.col("s_nationkey") < 20}
    return t("supplier").select("s_suppkey", F.concat_ws(",", P.violated(rules)).alias("violated"))


@query("SELECT page_id, concat_ws(',', CASE WHEN NOT starts_with(url, 'https://') THEN 'https' END, CASE WHEN NOT length(html) > 1000 THEN 'length' END, CASE WHEN NOT contains(html, '<h1>') THEN 'title' END) AS violated FROM pages")
def f8_validate_detail(t):
    rules = {"https": F.try_parse_url("url", F.lit("PROTOCOL")) == "https", "length": F.length("html") > 1000, "title": F.contains("html", F.lit("<h1>"))}
    return t("pages").select("page_id", F.concat_ws(",", P.violated(rules)).alias("violated"))


IMAGES = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'image/gif' ELSE 'image/png' END AS kind, n_chars AS size, 100 + doc_id % 300 AS w, 300 + doc_id % 200 AS h FROM {documents}"


@query(f"SELECT doc_id, CASE WHEN kind = 'image/gif' THEN 'type' WHEN size < 2000 THEN 'bytes' WHEN w < 200 OR h < 280 THEN 'dimensions' WHEN w * 1.0 / h < 0.63 OR w * 1.0 / h > 0.8 THEN 'ratio' END AS failing FROM ({IMAGES})")
def f9_validate_image(t):
    rules = P.image_rules(F.col("kind"), F.col("size"), F.col("w"), F.col("h"))
    return t(IMAGES).select("doc_id", P.first_failing(rules).alias("failing"))


@query("SELECT l_orderkey, l_linenumber, coalesce(l_quantity / nullif(l_discount * 500, 0) BETWEEN 0.6 AND 0.85, true) AS shaped FROM lineitem")
def f10_card_shaped(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", P.card_shaped(F.col("l_quantity"), F.col("l_discount") * 500).alias("shaped"))


@query("SELECT id FROM {cards} WHERE coalesce(nullif(image, ''), nullif('', '')) IS NULL")
def f11_has_no_image(t):
    return t("cards").where(P.has_no_image(F.col("image"), F.lit(""))).select("id")


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'covered' ELSE 'live' END || '/' || CASE WHEN lang IN ('en', 'fr', 'de') THEN 'western' ELSE 'asian' END AS tier FROM documents")
def f12_language_tier(t):
    return t("documents").select("doc_id", P.language_tier(F.col("lang"), ["en", "fr"], ["en", "fr", "de"]).alias("tier"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) <> 'therhe.example.org' AS is_external FROM pages")
def f13_is_external_url(t):
    return t("pages").select("page_id", P.is_external_url(F.col("url"), "therhe.example.org").alias("is_external"))


@query("SELECT p_partkey, p_brand LIKE '%2' AS gallery FROM part")
def f14_trainer_gallery(t):
    return t("part").select("p_partkey", P.trainer_gallery(F.regexp_replace("p_brand", "2$", "tg")).alias("gallery"))


@query("SELECT id, 'en/' || set_id || '/' || CAST(id AS STRING) AS identity FROM {cards}")
def f15_card_identity(t):
    return t("cards").select("id", P.identity(F.lit("en"), F.col("set_id"), F.col("id").cast("string")).alias("identity"))


ALIASES = "SELECT * FROM VALUES ('ECONOMY', 'Common'), ('SMALL', 'Common'), ('PROMO', 'Promo'), ('LARGE', 'Rare') AS a(raw, canonical)"


@query("SELECT id, CASE trim(rarity) WHEN 'ECONOMY' THEN 'Common' WHEN 'SMALL' THEN 'Common' WHEN 'PROMO' THEN 'Promo' WHEN 'LARGE' THEN 'Rare' WHEN 'STANDARD' THEN 'STANDARD' ELSE 'Unknown' END AS canonical FROM {cards}")
def c1_normalize_rarity(t):
    return C.normalize_rarity(t("cards"), "rarity", t(ALIASES), ["STANDARD", "Unknown"]).select("id", "canonical")


DICTIONARY = "SELECT CAST(substr(p_brand, 7) AS INT) AS language_pos, min(p_partkey) AS pos, p_type AS canonical, substr(p_name, 1, 3) AS localized FROM {part} GROUP BY p_brand, p_type, substr(p_name, 1, 3)"


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY localized ORDER BY language_pos, pos) AS n FROM ({DICTIONARY}) WHERE canonical IN ('ECONOMY', 'SMALL', 'PROMO') AND localized <> 'new')
  SELECT a.localized AS raw, a.canonical, count(CASE WHEN b.canonical <> a.canonical THEN 1 END) AS n_conflicts FROM d a JOIN d b ON a.localized = b.localized WHERE a.n = 1 GROUP BY 1, 2""")
def c2_derive_aliases(t):
    return C.derive_aliases(t(DICTIONARY).where("localized <> 'new'"), ["ECONOMY", "SMALL", "PROMO", "new"])


@query("SELECT id, regexp_matches(name, '^M[- ][A-Za-z].*[- ]EX$|^Mega[ -][A-Za-z].*\\b(ex|GX)$') AS is_mega FROM {cards}")
def c3_is_mega_name(t):
    return t("cards").select("id", C.is_mega_name(F.col("name")).alias("is_mega"))


@query("SELECT id, name LIKE '% VMAX' AS is_vmax FROM {cards}")
def c4_is_vmax_name(t):
    return t("cards").select("id", C.is_vmax_name(F.col("name")).alias("is_vmax"))


@query("SELECT id, CASE WHEN name LIKE '% X %' THEN 'X' WHEN name LIKE '%Yex' THEN 'Y' END AS variant FROM {cards}")
def c5_variant_token(t):
    return t("cards").select("id", C.variant_token(F.col("name")).alias("variant"))


OVERRIDES = "SELECT upper(p_brand) || '::' || CAST(p_partkey % 60 AS STRING) AS print_key, CASE WHEN min(p_partkey) % 2 = 0 THEN 'X' ELSE 'Y' END AS variant FROM {part} WHERE p_partkey % 50 = 0 GROUP BY 1"


@query(f"SELECT c.id, coalesce(o.variant, CASE WHEN name LIKE '% X %' THEN 'X' WHEN name LIKE '%Yex' THEN 'Y' END) AS variant FROM {{cards}} c LEFT JOIN ({OVERRIDES}) o ON o.print_key = upper(c.set_id) || '::' || CAST(CAST(c.local_id AS INT) AS STRING)")
def c6_variant_override(t):
    rows = t("cards").withColumn("print_key", T.print_key(F.col("set_id"), F.col("local_id"))).join(t(OVERRIDES), "print_key", "left")
    return rows.select("id", F.coalesce("variant", C.variant_token(F.col("name"))).alias("variant"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'the ha') OR contains(text, 'the st')")
def c7_regional_marker(t):
    labels = t("SELECT * FROM VALUES ('ha', 'the {}'), ('st', 'the {}') AS v(label, template)")
    patterns = labels.select(C.regional_pattern(F.col("template"), F.col("label")).alias("p"))
    return t("documents").join(F.broadcast(patterns), F.rlike("text", F.col("p"))).select("doc_id").distinct()


@query("SELECT id, CASE rarity WHEN 'PROMO' THEN 'ultra' WHEN 'ECONOMY' THEN 'none' WHEN 'LARGE' THEN 'holo' ELSE 'sheen' END AS tier FROM {cards}")
def c8_foil_tier(t):
    named = F.when(F.col("rarity") == "PROMO", " Ultra Rare").when(F.col("rarity") == "ECONOMY", "COMMON").when(F.col("rarity") == "LARGE", "Rare Holo").otherwise(F.col("rarity"))
    return t("cards").select("id", C.foil_tier(named).alias("tier"))


@query("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'exact' WHEN p_brand LIKE 'Brand#1%' THEN 'classic' WHEN p_brand LIKE 'Brand#2%' THEN 'transitional' ELSE 'modern' END AS era FROM part")
def c9_card_era(t):
    era = C.era(F.col("p_brand"), [("brand#1", "classic"), ("brand#2", "transitional")], {"brand#1": "exact", "brand#2": "exact"}, r"^20\d\d(xy|sm)$", r"^tk-([a-z]+)-", "modern")
    return t("part").select("p_partkey", era.alias("era"))


@query("SELECT id, upper(set_id) || '::' || regexp_replace(local_id, '^0+([0-9])', '\\1') AS print_key FROM {cards}")
def c11_print_key(t):
    return t("cards").select("id", T.print_key(F.col("set_id"), F.col("local_id")).alias("print_key"))


@query("SELECT p_partkey, p_brand AS code FROM part")
def c12_normalize_set_code(t):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_brand", F.lit(".PNG"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", F.lit(" F"))).otherwise(F.col("p_brand"))
    return t("part").select("p_partkey", T.normalize_set_code(raw).alias("code"))


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS ascii FROM documents")
def c13_normalize_ascii(t):
    return t("documents").select("doc_id", T.normalize_ascii(F.col("text")).alias("ascii"))


@query()
def c14_normalize_native(t):
    return t("documents").select("doc_id", T.normalize_native("text").alias("native"))


@query("SELECT id, regexp_replace(local_id, '^0+([0-9])', '\\1') || 'A' AS local_part FROM {cards}")
def c15_normalize_local_id(t):
    return t("cards").select("id", T.local_part(F.concat(F.lit(" "), "local_id", F.lit("a /60"))).alias("local_part"))


@query("SELECT id, regexp_replace(local_id, '^0+([0-9])', '\\1') || 'a' AS numerator FROM {cards}")
def c16_numerator(t):
    return t("cards").select("id", T.numerator(F.concat("local_id", F.lit("a/102"))).alias("numerator"))


@query("SELECT c_custkey, 'CUSTOMER' || CAST(c_custkey AS STRING) AS code FROM customer")
def c17_normalize_card_code(t):
    return t("customer").select("c_custkey", T.normalize_card_code(F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit("")), F.lit("/9"))).alias("code"))


@query("SELECT c_custkey, c_custkey % 3 <> 2 AS same FROM customer")
def c18_card_codes_match(t):
    other = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("SM0"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    name = F.when(F.col("c_custkey") % 3 == 1, "SM Promos").otherwise("XY Promos")
    return t("customer").select("c_custkey", T.card_codes_match(F.concat(F.lit("sm"), F.col("c_custkey").cast("string")), other, name).alias("same"))


#: Cards and the records that share their set and number.
NAMES = "SELECT c.id, s.source_id, c.name AS ours, s.name AS theirs FROM {cards} c JOIN {source} s ON s.set_id = c.set_id AND s.local_id = substr(c.local_id, 2, 2)"


@query(f"""SELECT id, source_id, round(len(list_intersect(x, y)) * 1.0 / len(x), 6) AS overlap FROM (SELECT id, source_id,
  list_distinct(list_filter(regexp_split_to_array(lower(ours), '[^a-z0-9]+'), lambda w: w <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(theirs), '[^a-z0-9]+'), lambda w: w <> '')) AS y FROM ({NAMES}))""")
def c19_token_overlap(t):
    """All pairs of rows are wanted; two names of a place are compared once, however many rows have them."""
    held = t("cards").select("set_id", F.substring("local_id", 2, 2).alias("no"), T.tokens(F.col("name"), plural=False).alias("own"), "id")
    other = t("source").select("set_id", F.col("local_id").alias("no"), T.tokens(F.col("name"), plural=False).alias("other"), "source_id")
    held = held.groupBy("set_id", "no", "own").agg(F.collect_list("id").alias("ids"))
    other = other.groupBy("set_id", "no", "other").agg(F.collect_list("source_id").alias("source_ids"))
    compared = held.join(other, ["set_id", "no"]).select("ids", "source_ids", F.round(T.tokens_shared(F.col("own"), F.col("other")), 6).alias("overlap"))
    return compared.select(F.explode("ids").alias("id"), "source_ids", "overlap").select("id", F.explode("source_ids").alias("source_id"), "overlap")


@query("SELECT p_partkey, replace(p_name, ' ', '-') AS slug FROM part")
def c20_slugify(t):
    return t("part").select("p_partkey", T.slugify(F.concat(F.initcap("p_name"), F.lit(" (1st)")), "-").alias("slug"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(replace(p_brand, '#', '')) ELSE replace(p_name, ' ', '') END AS set_id, p_partkey % 2 = 0 AS mismatched FROM part")
def c21_proposed_set_id(t):
    code = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("/x")))
    proposed = T.proposed_set_id(code, F.col("p_name"))
    return t("part").select("p_partkey", proposed.alias("set_id"), (proposed != F.replace(F.col("p_name"), F.lit(" "), F.lit(""))).alias("mismatched"))


@query("SELECT doc_id, source || CASE WHEN lang = 'de' THEN ' (ATCG)' ELSE ' (TCG)' END AS title, source AS back FROM documents")
def c22_article_title(t):
    title = T.article_title(F.concat("source", F.lit(" (old)")), F.col("lang"), ("de",))
    return t("documents").select("doc_id", title.alias("title"), T.set_name_of_title(title).alias("back"))


@query("""SELECT DISTINCT p_name, v FROM (SELECT p_name, unnest(['Deja ' || p_name || ' & a (TCG)', 'Déjà ' || p_name || ' & a (ATCG)', 'Deja ' || p_name || ' and a (ATCG)', 'Déjà ' || p_name || ' & a (TCG)', 'Déjà ' || p_name || ' and a (ATCG)', 'Deja ' || p_name || ' and a (TCG)']) AS v FROM part)""")
def c23_title_variants(t):
    title = F.concat(F.lit("Deja "), "p_name", F.lit(" & a (ATCG)"))
    return t("part").select("p_name").distinct().select("p_name", F.explode(T.title_variants(title)).alias("v"))


@query("SELECT id, set_id FROM {cards}")
def c24_derive_set_id(t):
    return t("cards").select("id", T.derive_set_id(F.concat_ws("-", "set_id", "local_id"), F.col("local_id")).alias("set_id"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'long' WHEN 2 THEN 'english' ELSE 'first' END AS text FROM orders")
def c25_resolve_language_text(t):
    k = F.col("o_orderkey") % 4
    texts = F.create_map(F.lit("ja"), F.lit("first"), F.when(k == 0, "pt").otherwise("x0"), F.col("o_orderpriority"), F.when(k == 1, "pt-br").otherwise("x1"), F.lit("long"), F.when(k == 2, "en").otherwise("x2"), F.lit("english"))
    return t("orders").select("o_orderkey", T.resolve_language_text(texts, F.lit("pt")).alias("text"))


@query("SELECT id, CASE rarity WHEN 'PROMO' THEN 'Promo' WHEN 'LARGE' THEN 'Rare' ELSE rarity END AS rarity FROM {cards}")
def c26_translate_field(t):
    words = t("SELECT * FROM VALUES ('rarity', 'PROMO', 'Promo'), ('rarity', 'LARGE', 'Rare'), ('category', 'SMALL', 'x') AS v(field, source, target)")
    return C.translate_field(t("cards"), "rarity", words, "rarity").select("id", "rarity")


@query("SELECT id, 'a.' || local_id AS local_id FROM {cards}")
def c27_local_id_from_file(t):
    return t("cards").select("id", T.local_id_from_file(F.concat(F.lit("a."), "local_id", F.lit(".ts"))).alias("local_id"))


@query("SELECT id, 'https://x/' || set_id || '/' || local_id AS asset, 'img' || CAST(id AS STRING) || '/high.png' AS image FROM {cards}")
def c28_asset_urls(t):
    return t("cards").select("id", T.asset_url("https://x", F.col("set_id"), F.col("local_id")).alias("asset"), T.image_url(F.concat(F.lit("img"), F.col("id").cast("string")), "high", "png").alias("image"))


@query("SELECT p_partkey, 'https://m/s?q=' || replace(p_name, ' ', '%20') || '%20(' || replace(p_brand, '#', '%23') || ')%2F%26' AS url FROM part")
def c29_marketplace_url(t):
    return t("part").select("p_partkey", T.search_url("https://m/s", F.col("p_name"), F.concat(F.lit("("), "p_brand", F.lit(")/&"))).alias("url"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' ELSE 'webp' END AS extension FROM part")
def c30_extension_for_type(t):
    k = F.col("p_partkey") % 3
    return t("part").select("p_partkey", T.extension_for_type(F.when(k == 0, "image/jpeg").when(k == 1, "IMAGE/PNG; q=1").otherwise("image/webp")).alias("extension"))


@query("""SELECT id, unnest([c || 'Promo' || n || '.jpg', c || 'Promo' || n || '.png', c || s || n || '.jpg', c || s || n || '.png']) AS file, unnest([0, 1, 2, 3]) AS rank FROM
  (SELECT id, regexp_replace(name, '[^A-Za-z0-9]', '', 'g') AS c, replace(set_id, '#', '') AS s, regexp_replace(local_id, '^0+([0-9])', '\\1') AS n FROM {cards})""")
def c31_guess_filename(t):
    files = T.guess_filenames(F.col("name"), [F.lit("Promo"), F.col("set_id")], F.concat("local_id", F.lit("/60")))
    return t("cards").select("id", F.posexplode(files).alias("rank", "file"))


TITLES = "SELECT p_partkey AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN ' (' || p_brand || ' SM' || CAST(p_partkey AS STRING) || ')' WHEN 1 THEN ' (' || p_brand || ')' WHEN 2 THEN ' (' || CAST(p_partkey AS STRING) || ')' ELSE '' END AS title, p_name, p_brand FROM {part}"


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 2 THEN p_name END AS name, CASE WHEN p_partkey % 4 < 2 THEN p_brand END AS set_name, CASE WHEN p_partkey % 4 = 0 THEN 'SM' || CAST(p_partkey AS STRING) END AS number FROM part")
def c32_print_disambiguator(t):
    return t(TITLES).select("id", T.print_disambiguator(F.col("title")).alias("d")).select("id", "d.name", "d.set_name", "d.number")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 >= 2 THEN 'no disambiguator' WHEN p_partkey % 5 = 0 THEN 'name' WHEN p_partkey % 4 = 1 THEN 'ok' WHEN p_partkey % 3 = 0 THEN 'number' ELSE 'ok' END AS reason FROM part""")
def c33_article_matches_print(t):
    rows = t(TITLES).withColumn("held", F.when(F.col("id") % 5 == 0, "other").otherwise(F.upper("p_name"))).withColumn("code", F.when(F.col("id") % 3 == 0, "SM9x").otherwise(F.concat(F.lit("sm0"), F.col("id").cast("string"))))
    return rows.select("id", T.match_print(F.col("title"), F.col("held"), F.col("p_brand"), F.col("code")).alias("reason"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'one' WHEN p_size <= 20 THEN 'two' WHEN p_size BETWEEN 26 AND 50 THEN 'three' END AS generation, p_size >= 40 AS synthetic FROM part")
def c34_generation_of(t):
    bands = [(1, 10, "one"), (11, 20, "two"), (26, 50, "three")]
    return t("part").select("p_partkey", C.generation_of(F.col("p_size"), bands).alias("generation"), C.is_synthetic(F.col("p_size"), 40).alias("synthetic"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'CS' || CAST(p_size AS STRING) || 'a' END AS code FROM part")
def c35_infobox_code(t):
    fields = F.create_map(F.lit("name"), F.col("p_name"), F.lit("set"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("code CS"), F.col("p_size").cast("string"), F.lit("a."))).otherwise("none"))
    return t("part").select("p_partkey", T.infobox_code(fields).alias("code"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'リング' ELSE p_name END AS name FROM part")
def c36_rename_if_latin(t):
    native = F.when(F.col("p_partkey") % 3 == 0, "リング").when(F.col("p_partkey") % 3 == 1, "Ring リ")
    return t("part").select("p_partkey", T.rename_if_latin(F.col("p_name"), native).alias("name"))
