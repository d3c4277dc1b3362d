"""Queries for entity resolution (J12-J16, J23-J26, J33-J34, W15-W19) and forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.classify import is_mega_name
from quarry.operators import forms as O
from quarry.operators import match as X
from quarry.plans.tables import query

FRAGMENTS = "SELECT DISTINCT substr(p_name, 1 + CAST(p_partkey % 4 AS INT), 4 + CAST(p_partkey % 6 AS INT)) AS frag FROM {part} WHERE p_partkey % 7 = 0"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), f AS ({FRAGMENTS}),
  c AS (SELECT name, count(*) AS n, min(frag) AS one FROM n JOIN f ON length(name) >= 3 AND length(frag) >= 3 AND (contains(name, frag) OR contains(frag, name)) GROUP BY name)
  SELECT n.name, CASE WHEN e.frag IS NOT NULL THEN e.frag WHEN c.n = 1 THEN one END AS target, CASE WHEN e.frag IS NOT NULL THEN 'exact' WHEN c.n = 1 THEN 'contained' WHEN c.n > 1 THEN 'ambiguous' ELSE 'none' END AS how
  FROM n LEFT JOIN f e ON e.frag = n.name LEFT JOIN c ON c.name = n.name""")
def j12_fuzzy_set_match(t):
    return X.fuzzy_set_match(t("part"), t(FRAGMENTS), "p_name", "frag")


#: Cards, and a source that names some sets longer (one match) and some in two ways (ambiguous), lacks numbers and species.
OURS = "SELECT id AS card_id, lower(set_id) AS set_key, CAST(CAST(local_id AS INT) AS STRING) AS local_key, lower(name) AS name_key, species, set_id, image FROM {cards}"
THEIRS = """SELECT source_id, CASE WHEN set_id LIKE '%3' THEN lower(set_id) || ' deluxe' WHEN set_id LIKE '%5' THEN lower(set_id) || CASE WHEN species % 2 = 0 THEN ' one' ELSE ' two' END ELSE lower(set_id) END AS set_key,
  CASE WHEN source_id % 70 = 0 THEN NULL ELSE CAST(CAST(local_id AS INT) % 20 AS STRING) END AS local_key, lower(name) AS name_key, species, image, split_part(lower(name), ' ', 2) AS kind FROM {source}"""
#: The source's set that each set of ours stands for: the equal one, else the only one that contains it or lies in it.
RESOLVED = f"""SELECT c.set_key, CASE WHEN count(CASE WHEN s.set_key = c.set_key THEN 1 END) > 0 THEN c.set_key WHEN count(*) = 1 THEN min(s.set_key) END AS target
  FROM (SELECT DISTINCT set_key FROM ({OURS})) c JOIN (SELECT DISTINCT set_key FROM ({THEIRS})) s
  ON s.set_key = c.set_key OR length(c.set_key) >= 3 AND length(s.set_key) >= 3 AND (contains(s.set_key, c.set_key) OR contains(c.set_key, s.set_key)) GROUP BY c.set_key"""
ENGLISH = f"""SELECT card_id, CASE WHEN n = 0 THEN 'none' WHEN n = 1 OR m = 1 THEN 'primary' ELSE 'ambiguous' END AS kind, CASE WHEN n = 1 THEN single WHEN m = 1 THEN one END AS source_id FROM (
  SELECT card_id, count(source_id) AS n, min(source_id) AS single, count(CASE WHEN ok THEN source_id END) AS m, min(CASE WHEN ok THEN source_id END) AS one FROM (
    SELECT c.card_id, s.source_id, s.name_key = c.name_key OR contains(s.name_key, c.name_key) OR contains(c.name_key, s.name_key) OR contains(c.name_key, s.kind) OR contains(s.kind, c.name_key) AS ok
    FROM ({OURS}) c LEFT JOIN ({RESOLVED}) r ON r.set_key = c.set_key LEFT JOIN ({THEIRS}) s ON s.set_key = r.target AND s.local_key = c.local_key) GROUP BY card_id)"""


def _english(t):
    return X.match_english(t(OURS).select("card_id", "set_key", "local_key", "name_key"), t(THEIRS).withColumn("species_keys", F.array("kind")))


@query(ENGLISH)
def j13_match_english(t):
    return _english(t)


NATIVE = f"""WITH c AS (SELECT x.*, r.target FROM ({OURS}) x LEFT JOIN ({RESOLVED}) r ON r.set_key = x.set_key), s AS ({THEIRS}),
  p AS (SELECT c.card_id, c.target, c.species, count(s.source_id) AS n, min(s.source_id) AS single, bool_and(s.species % 5 = 0 OR s.species = c.species) AS fits FROM c LEFT JOIN s ON s.set_key = c.target AND s.local_key = c.local_key GROUP BY 1, 2, 3),
  f AS (SELECT p.card_id, count(*) AS m, min(s.source_id) AS other FROM p JOIN s ON p.n = 0 AND s.set_key = p.target AND s.species % 5 <> 0 AND s.species = p.species GROUP BY 1),
  k AS (SELECT p.*, other, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 AND fits THEN 'primary' WHEN n = 1 THEN 'species-conflict' WHEN m = 1 THEN 'fallback-species' WHEN m > 1 THEN 'ambiguous' ELSE 'none' END AS kind FROM p LEFT JOIN f ON f.card_id = p.card_id)
  SELECT card_id, kind, CASE kind WHEN 'primary' THEN single WHEN 'species-conflict' THEN single WHEN 'fallback-species' THEN other END AS source_id FROM k"""


def _japanese(t):
    species = F.when(F.col("species") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("species").cast("int")))
    return X.match_japanese(t(OURS).select("card_id", "set_key", "local_key", F.col("species").cast("int").alias("species")), t(THEIRS).withColumn("species", species))


@query(NATIVE)
def j14_match_japanese(t):
    return _japanese(t)


@query(f"""SELECT c.id AS card_id, CASE WHEN coalesce(c.image, '') <> '' THEN 'own' WHEN e.kind = 'primary' THEN 'english' WHEN j.kind IN ('primary', 'fallback-species') THEN 'japanese' ELSE 'none' END AS how,
  CASE WHEN coalesce(c.image, '') <> '' THEN c.image WHEN e.kind = 'primary' THEN 'src/' || CAST(e.source_id // 10 AS STRING) WHEN j.kind IN ('primary', 'fallback-species') THEN 'src/' || CAST(j.source_id // 10 AS STRING) END AS image
  FROM {{cards}} c JOIN ({ENGLISH}) e ON e.card_id = c.id JOIN ({NATIVE}) j ON j.card_id = c.id""")
def j15_resolve_assets(t):
    image = t("source").select("source_id", "image")

    def lent(matches, name):
        return matches.where(X.usable(F.col("kind"))).join(image.withColumnRenamed("image", name), "source_id").select("card_id", name)

    rows = t(OURS).select("card_id", "image").join(lent(_english(t), "en"), "card_id", "left").join(lent(_japanese(t), "ja"), "card_id", "left")
    return rows.select("card_id", X.asset_ladder(("own", F.col("image")), ("english", F.col("en")), ("japanese", F.col("ja"))).alias("a")).select("card_id", "a.how", F.col("a.value").alias("image"))


COUNTS = "count(*) AS sampled, count(CASE WHEN kind IN ('primary', 'fallback-species') THEN 1 END) AS matched, count(CASE WHEN kind = 'fallback-species' THEN 1 END) AS via_fallback, count(CASE WHEN kind = 'species-conflict' THEN 1 END) AS conflict, count(CASE WHEN kind = 'ambiguous' THEN 1 END) AS ambiguous, count(CASE WHEN kind = 'none' THEN 1 END) AS no_match"


@query(f"SELECT source, {COUNTS} FROM (SELECT 'english' AS source, kind FROM ({ENGLISH}) UNION ALL SELECT 'japanese', kind FROM ({NATIVE})) GROUP BY source", "a11_cross_check_counts")
def a11_cross_check_counts(t):
    return X.cross_check(_english(t).withColumn("source", F.lit("english")).unionByName(_japanese(t).withColumn("source", F.lit("japanese"))), "source")


SAMPLED = f"""SELECT x.card_id, x.species, m.kind, m.source_id, c.name AS ours, s.name AS theirs, c.rarity AS our_label, CASE WHEN s.source_id % 40 <> 0 THEN s.rarity END AS their_label FROM (
  SELECT card_id, species FROM ({OURS}) QUALIFY row_number() OVER (PARTITION BY species ORDER BY md5('en-sample:' || CAST(species AS STRING) || ':' || CAST(card_id AS STRING)), card_id) = 1) x
  JOIN ({ENGLISH}) m ON m.card_id = x.card_id JOIN {{cards}} c ON c.id = x.card_id LEFT JOIN {{source}} s ON s.source_id = m.source_id"""


@query(f"""WITH a AS (SELECT *, kind = 'primary' AS hit, CASE WHEN lower(ours) = lower(theirs) THEN 'exact' WHEN contains(lower(ours), lower(theirs)) OR contains(lower(theirs), lower(ours)) OR contains(lower(ours), 'bolt') AND contains(lower(theirs), 'bolt') THEN 'variant' ELSE 'mismatch' END AS g,
    coalesce(lower(trim(our_label)) = lower(trim(their_label)), false) AS same FROM ({SAMPLED}))
  SELECT 'english' AS source, count(*) AS sampled, count(CASE WHEN hit THEN 1 END) AS matched, 0 AS via_fallback, 0 AS conflict, count(CASE WHEN kind = 'ambiguous' THEN 1 END) AS ambiguous, count(CASE WHEN kind = 'none' THEN 1 END) AS no_match,
    count(CASE WHEN hit AND g = 'variant' THEN 1 END) AS variant, count(CASE WHEN hit AND g = 'mismatch' THEN 1 END) AS mismatch, count(CASE WHEN hit AND their_label IS NOT NULL AND NOT same THEN 1 END) AS label_differences,
    count(CASE WHEN hit AND their_label IS NULL THEN 1 END) AS label_absent, count(CASE WHEN hit AND g <> 'mismatch' AND same THEN 1 END) AS clean FROM a""")
def a11_cross_check_sample(t):
    """One card of each species, held against the source that matches it."""
    from quarry.operators.audit import cross_check_outcomes, name_agreement
    from quarry.operators.keyed import reproducible_sample

    sampled = reproducible_sample(t(OURS).select("card_id", "species"), "species", "card_id", "en-sample")
    cards = t("cards").select(F.col("id").alias("card_id"), F.col("name").alias("ours"), F.col("rarity").alias("our_label"))
    records = t("source").select("source_id", F.col("name").alias("theirs"), F.when(F.col("source_id") % 40 != 0, F.col("rarity")).alias("their_label"))
    rows = sampled.join(_english(t), "card_id").join(cards, "card_id").join(records, "source_id", "left").withColumn("source", F.lit("english"))
    agreement = name_agreement(F.col("ours"), F.col("theirs"), F.lit("bolt"))
    return cross_check_outcomes(rows, "source", "kind", agreement, F.col("our_label"), F.col("their_label"))


WORDS = "SELECT word, min(pos) AS pos FROM (SELECT lower(substr(text, 1, 2 + CAST(item_id % 5 AS INT))) AS word, item_id AS pos FROM {benchmark} UNION ALL SELECT 'the', 100000 UNION ALL SELECT 'the ha', 100001) AS w WHERE word NOT LIKE '% ' GROUP BY word"


@query(f"""SELECT doc_id, word AS matched FROM documents LEFT JOIN ({WORDS}) ON starts_with(lower(text), word) AND (length(text) = length(word) OR substr(text, length(word) + 1, 1) IN (' ', '-'))
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(word) DESC, pos) = 1""")
def j16_match_species_prefix(t):
    return X.match_prefix(t("documents").select("doc_id", "text"), "doc_id", "text", t(WORDS), "word", "pos").select("doc_id", "matched")


FORMS = "SELECT 20000 + p_size * 10 + v AS number, p_size AS base_number, CASE v WHEN 0 THEN 'a-mega-x' WHEN 1 THEN 'a-mega-y' ELSE 'a-mega' END AS slug, CASE v WHEN 0 THEN 'Ring (bolt Style)' WHEN 1 THEN 'Gear (gear)' ELSE 'One' END AS label, CASE v WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'mega' END AS family FROM (SELECT DISTINCT p_size FROM {part}) AS p, (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2) AS w WHERE v < 2 OR p_size % 2 = 0"
REFERENCE = "SELECT species, trim(name) AS reference FROM {cards} WHERE name NOT LIKE '%&%' AND NOT regexp_matches(name, '^M[- ][A-Za-z].*[- ]EX$|^Mega[ -][A-Za-z].*\\b(ex|GX)$') QUALIFY row_number() OVER (PARTITION BY species ORDER BY length(name), pos) = 1"


@query(f"""WITH m AS (SELECT c.*, r.reference, o.variant AS over, CASE WHEN name LIKE '% X %' THEN 'X' WHEN name LIKE '%Yex' THEN 'Y' END AS letter,
    CASE WHEN name LIKE '%&%' THEN lower(trim(regexp_extract(split_part(name, '&', 1), '^(?:Mega|M)[- ](.+)$', 1))) END AS token
    FROM {{cards}} c LEFT JOIN ({REFERENCE}) r USING (species) LEFT JOIN (SELECT upper(p_brand) || '::' || CAST(p_partkey % 60 AS STRING) AS k, CASE WHEN min(p_partkey) % 2 = 0 THEN 'X' ELSE 'Y' END AS variant FROM part WHERE p_partkey % 50 = 0 GROUP BY 1) o
    ON o.k = upper(set_id) || '::' || CAST(CAST(local_id AS INT) AS STRING) WHERE regexp_matches(name, '^M[- ][A-Za-z].*[- ]EX$|^Mega[ -][A-Za-z].*\\b(ex|GX)$'))
  SELECT number, id FROM m JOIN ({FORMS}) f ON f.base_number = m.species WHERE (token IS NULL OR reference IS NULL OR token = lower(reference)) AND
    CASE WHEN species NOT IN (6, 8, 9) THEN true WHEN over IS NOT NULL THEN coalesce(upper(nullif(regexp_extract(slug, '-mega-([xyz])$', 1), '')) = over, false)
    WHEN slug = 'a-mega' THEN letter IS NULL WHEN letter IS NULL THEN species IN (6) ELSE letter = upper(regexp_extract(slug, '-mega-([xyz])$', 1)) END""")
def j17_mega_members(t):
    over = t("SELECT upper(p_brand) || '::' || CAST(p_partkey % 60 AS STRING) AS print_key, CASE WHEN min(p_partkey) % 2 = 0 THEN 'X' ELSE 'Y' END AS variant FROM {part} WHERE p_partkey % 50 = 0 GROUP BY 1")
    return O.mega_members(t("cards"), t(FORMS), over, [6, 8, 9], [6])


@query(f"""SELECT number, id FROM {{cards}} c JOIN (SELECT *, count(*) OVER (PARTITION BY base_number) AS n FROM ({FORMS}) WHERE base_number % 3 <> 0 OR slug = 'a-mega') f ON f.base_number = c.species
  WHERE name LIKE '% VMAX' AND (n = 1 OR label = 'One' OR contains(lower(name), CASE label WHEN 'Ring (bolt Style)' THEN 'bolt' ELSE 'gear' END))""")
def j18_vmax_members(t):
    return O.vmax_members(t("cards"), t(FORMS).where("base_number % 3 <> 0 or slug = 'a-mega'"))


TEMPLATES = "SELECT * FROM VALUES ('north', '^{}[ -]'), ('north', 'hot.{}'), ('south', '{}$') AS v(family, template)"
REGIONAL = f"SELECT DISTINCT number, id FROM {{cards}} c JOIN (SELECT number, base_number, CASE family WHEN 'north' THEN 'red' ELSE 'bolt' END AS word, family FROM ({FORMS}) WHERE family <> 'mega') f ON f.base_number = c.species WHERE CASE family WHEN 'north' THEN name LIKE word || ' %' OR name LIKE '%hot_' || word || '%' ELSE name LIKE '%' || word END"


def _regional(t):
    own = t(FORMS).where("family <> 'mega'").withColumn("label", F.when(F.col("family") == "north", "red").otherwise("bolt"))
    return O.regional_members(t("cards"), own, t(TEMPLATES.replace("{}", "@")).withColumn("template", F.replace("template", F.lit("@"), F.lit("{}"))))


@query(REGIONAL)
def j19_regional_members(t):
    return _regional(t)


@query(f"SELECT id FROM {{cards}} WHERE id NOT IN (SELECT id FROM ({REGIONAL}))")
def j20_exclude_regional(t):
    return O.exclude_regional(t("cards").select("id"), _regional(t))


@query(f"SELECT number, id FROM ({FORMS}) JOIN {{cards}} ON species = base_number WHERE (family = 'mega' AND regexp_matches(name, '^M[- ][A-Za-z].*[- ]EX$|^Mega[ -][A-Za-z].*\\b(ex|GX)$')) OR (family = 'north' AND name LIKE '%red%')")
def j21_synthetic_form_view(t):
    matchers = {"mega": lambda: is_mega_name(F.col("name")), "north": lambda: F.contains("name", F.lit("red"))}
    return O.synthetic_form_view(t(FORMS), t("cards"), matchers).select("number", "id")


@query("SELECT id, 'id' AS via FROM {cards} WHERE id % 5 = 0 UNION ALL SELECT id, 'name' FROM {cards} WHERE id % 5 <> 0 AND regexp_matches(lower(name), '(^|[^a-z0-9])bolt($|[^a-z0-9])')")
def j23_search_all_prints(t):
    cards = t("cards").select("id", "name")
    return X.search_all_prints(cards.where("id % 5 = 0"), cards, "id", F.col("name"), "bolt").select("id", "via")


@query("SELECT p_size, p_type, coalesce(s.n, CAST(p_size AS STRING)) AS name FROM (SELECT DISTINCT p_size FROM part) CROSS JOIN (SELECT DISTINCT p_type FROM part) LEFT JOIN (SELECT p_size, min(p_name) AS n FROM part WHERE p_size % 2 = 0 GROUP BY p_size) s USING (p_size)")
def j24_fan_out_rarity(t):
    names = t("part").where("p_size % 2 = 0").groupBy("p_size").agg(F.min("p_name").alias("n"))
    return X.fan_out(t("part").select("p_size").distinct(), t("part").select("p_type").distinct(), names, "p_size", "n")


#: Two cards in four have a prefix; rows have it now and then, or a context that names it.
HELD_CODES = "SELECT concat('Promos ', set_id) AS set_name, id AS card_pos, CASE WHEN id % 4 = 0 THEN concat('SM', local_id) WHEN id % 4 = 1 THEN concat('XY', local_id) ELSE local_id END AS code FROM {cards}"
ROW_CODES = "SELECT concat('Promos ', set_id) AS set_name, source_id AS row_pos, CASE WHEN source_id % 30 = 0 THEN concat('sm', local_id) ELSE local_id END AS code, CASE WHEN source_id % 40 = 0 THEN 'SM Promos' WHEN source_id % 60 = 0 THEN 'XY and SM' END AS context FROM {source}"


@query()
def j26_code_match_rows(t):
    return X.code_match_rows(t(HELD_CODES), t(ROW_CODES), "set_name")


@query(f"SELECT number, base_number, slug FROM ({FORMS}) WHERE base_number = 6 UNION ALL SELECT number, base_number, slug FROM ({FORMS}) WHERE number = 20071")
def j32_form_lookup(t):
    forms = t(FORMS).select("number", "base_number", "slug")
    return O.form_lookup(forms, base=6).unionByName(O.form_lookup(forms, number=20071))


@query("""SELECT c.id, f.file FROM {cards} c LEFT JOIN (SELECT id, CASE WHEN id % 3 = 0 THEN 'redbolt' || CAST(id AS STRING) || '.png' WHEN id % 3 = 1 AND id % 5 <> 0 THEN 'redbolt' || CAST(id AS STRING) || '.jpg' END AS file FROM {cards}) f USING (id)""")
def j33_resolve_row_images(t):
    cards = t("cards").select("id")
    held = cards.select(F.concat(F.lit("redbolt"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, ".png").when(F.col("id") % 3 == 1, ".jpg")).alias("file"), F.when(F.col("id") % 5 == 0, F.lit(100)).otherwise(F.lit(70)).alias("w"), F.lit(100).alias("h"), (F.col("id") % 3 == 0).alias("any")).where("file is not null")
    from quarry.functions.predicates import card_shaped

    files = T.guess_filenames(F.lit("red"), [F.lit("bolt")], F.col("id").cast("string"))
    return X.resolution_ladder(cards, "id", [("guess", files)], held, "file", lambda: card_shaped(F.col("w"), F.col("h")) | F.col("any")).select("id", F.col("found").alias("file"))


#: Files as guessed from name, set and number, half of them of another shape; the rows of set articles; and single pages.
DEEP = "SELECT id, name, set_id AS set_name, local_id AS code FROM {cards} WHERE rarity <> ''"
FILES = """SELECT concat(translate(name, ' -&#', ''), translate(set_id, ' -&#', ''), CAST(CAST(local_id AS INT) AS STRING), CASE WHEN id % 4 = 0 THEN '.png' ELSE '.jpg' END) AS file, CASE WHEN id % 8 = 0 THEN 100 ELSE 70 END AS w, 100 AS h FROM {cards} WHERE id % 4 < 2
  UNION ALL SELECT concat('Row', CAST(id AS STRING), '.jpg'), CASE WHEN id % 3 = 0 THEN 100 ELSE 70 END, 100 FROM {cards}"""
SET_ROWS = "SELECT set_id AS set_name, id AS row_pos, local_id AS code FROM {cards} WHERE id % 5 = 0"
CARD_PAGES = "SELECT DISTINCT concat(name, ' (', set_id, ' ', CAST(CAST(local_id AS INT) AS STRING), ')') AS title FROM {cards} WHERE id % 7 < 3"


def _deep(t):
    from quarry.functions.predicates import card_shaped
    from quarry.operators.stages import first_found, resolve_in_stages

    files, rows, pages = t(FILES).groupBy("file").agg(F.min("w").alias("w"), F.min("h").alias("h")), t(SET_ROWS), t(CARD_PAGES)
    shaped = lambda: card_shaped(F.col("w"), F.col("h"))

    def set_rows(rest):
        """Rows of the card's set by code (J26), and what their own files hold (J33); a row without one resolves nothing."""
        met = X.code_match_rows(rest.select("set_name", F.col("id").alias("card_pos"), "code"), rows, "set_name")
        named = met.select(F.col("card_pos").alias("id"), F.concat(F.lit("Row"), F.col("row_pos").cast("string"), F.lit(".jpg")).alias("file"))
        return X.resolution_ladder(named, "id", [("row", F.col("file"))], files, "file", shaped).select("id", "found")

    number = T.numerator(F.col("code"))
    guess = first_found([T.guess_filenames(F.col("name"), [F.col("set_name")], F.col("code"))], files, "file", "id", shaped)
    page = first_found([F.concat(F.col("name"), F.lit(" ("), F.col("set_name"), F.lit(" "), number, F.lit(")"))], pages, "title", "id")
    return resolve_in_stages(t(DEEP), [("filename-guess", guess), ("set-rows", set_rows), ("article", page)], "id")


@query(r"""WITH f AS (SELECT file, min(w) AS w FROM (""" + FILES + r""") GROUP BY file), d AS (""" + DEEP + r"""),
  g AS (SELECT d.*, regexp_replace(name, '[^A-Za-z0-9]', '', 'g') || regexp_replace(set_name, '[^A-Za-z0-9]', '', 'g') || CAST(CAST(code AS INT) AS STRING) AS base FROM d),
  a AS (SELECT g.*, CASE WHEN j.w < 100 THEN j.file WHEN p.w < 100 THEN p.file END AS one FROM g LEFT JOIN f j ON j.file = base || '.jpg' LEFT JOIN f p ON p.file = base || '.png'),
  r AS (SELECT *, row_number() OVER (PARTITION BY set_name, code ORDER BY row_pos) AS k FROM (""" + SET_ROWS + r""")),
  b AS (SELECT a.*, row_number() OVER (PARTITION BY set_name, code ORDER BY id) AS k FROM a WHERE one IS NULL),
  c AS (SELECT b.*, CASE WHEN f.w < 100 THEN f.file END AS two FROM b LEFT JOIN r USING (set_name, code, k) LEFT JOIN f ON f.file = 'Row' || CAST(r.row_pos AS STRING) || '.jpg'),
  e AS (SELECT c.*, p.title AS three FROM c LEFT JOIN (""" + CARD_PAGES + r""") p ON two IS NULL AND p.title = name || ' (' || set_name || ' ' || CAST(CAST(code AS INT) AS STRING) || ')')
  SELECT id, one AS found, 'filename-guess' AS method FROM a WHERE one IS NOT NULL UNION ALL SELECT id, coalesce(two, three), CASE WHEN two IS NOT NULL THEN 'set-rows' WHEN three IS NOT NULL THEN 'article' END FROM e""")
def j34_deep_image_stages(t):
    return _deep(t).select("id", "found", "method")


@query("SELECT coalesce(method, 'none') AS method, count(*) AS n FROM (SELECT CASE WHEN id % 2 = 0 THEN 'guess' WHEN id % 3 = 0 THEN 'rows' WHEN id % 5 = 0 THEN 'pages' END AS method FROM {cards}) GROUP BY 1")
def j34_counts_by_method(t):
    from quarry.operators.stages import counts_by_method, resolve_in_stages

    part = lambda n: lambda rest: rest.where(F.col("id") % n == 0).select("id", F.lit(n).alias("found"))
    return counts_by_method(resolve_in_stages(t("cards").select("id"), [("guess", part(2)), ("rows", part(3)), ("pages", part(5))], "id"))


TARGETS = "SELECT DISTINCT p_name AS target, p_name || ' gears' AS wanted, CASE WHEN length(p_name) % 2 = 0 THEN ' small' ELSE ' box' END AS suffix FROM {part}"
TITLES = "SELECT p_partkey AS candidate, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' gear ' ELSE ' ' END || p_type AS title FROM {part}"
WORDS_OF = "list_distinct(list_transform(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN left(x, length(x) - 1) ELSE x END))"
SCORED = f"SELECT target, candidate, len(list_intersect(a, b)) / len(a) + CASE WHEN ends_with(lower(title), lower(suffix)) THEN 0.25 ELSE 0 END AS score FROM (SELECT *, {WORDS_OF.format('wanted')} AS a FROM ({TARGETS})), (SELECT *, {WORDS_OF.format('title')} AS b FROM ({TITLES})) WHERE len(list_intersect(a, b)) > 0"


@query(f"SELECT target, candidate, round(score, 6) AS score FROM ({SCORED}) QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, candidate) = 1")
def w15_best_candidate(t):
    best = X.best_candidates(t(TARGETS), t(TITLES), "target", "wanted", "candidate", "title", "suffix")
    return best.select("target", "candidate", F.round("score", 6).alias("score"))


PRINTS = "SELECT p_partkey AS card_id, p_name AS name, p_brand || ' ' || p_type AS set_name, 'SM' || CAST(p_size AS STRING) AS local_id FROM {part}"
PAGES = """SELECT upper(p_name) || ' (' || CASE p_partkey % 5 WHEN 0 THEN p_brand || ' ' || p_type ELSE p_brand || ' sm ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ' foil' ELSE '' END || CASE WHEN p_partkey % 5 = 4 THEN '' ELSE ' 0' || CAST(p_size AS STRING) END END || ')' AS title FROM {part}"""
#: The same guard and score in SQL: tokens are those of brand and type; a prefix SM is named by the titles that hold a number.
W16 = f"""WITH p AS (SELECT DISTINCT title, regexp_extract(title, '^(.*) \\(', 1) AS key, regexp_extract(title, '\\((.*)\\)$', 1) AS inside FROM ({PAGES})),
  d AS (SELECT title, key, CASE WHEN regexp_matches(inside, ' 0[0-9]+$') THEN regexp_replace(inside, ' 0[0-9]+$', '') ELSE inside END AS s, ltrim(regexp_extract(inside, ' (0[0-9]+)$', 1), '0') AS n FROM p),
  m AS (SELECT c.card_id, d.title, d.n, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(a) AS overlap FROM (SELECT *, {WORDS_OF.format('set_name')} AS a FROM ({PRINTS})) c JOIN (SELECT *, {WORDS_OF.format('s')} AS b FROM d) d ON d.key = upper(c.name)
    WHERE d.n = '' OR d.n = substr(c.local_id, 3)),
  s AS (SELECT card_id, title, CASE WHEN n = '' THEN 0.75 ELSE 1 END + overlap AS score FROM m WHERE overlap >= CASE WHEN n = '' THEN 0.75 ELSE 0.5 END),
  t AS (SELECT * FROM s WHERE score >= 1.5 QUALIFY score = max(score) OVER (PARTITION BY card_id))
  SELECT card_id, CASE WHEN count(*) = 1 THEN 'hit' ELSE 'ambiguous' END AS status, CASE WHEN count(*) = 1 THEN min(title) END AS title, round(max(score), 6) AS score, CASE WHEN count(*) > 1 THEN string_agg(title, '|' ORDER BY title) END AS tied FROM t GROUP BY card_id"""


@query(W16)
def w16_best_or_ambiguous(t):
    best = X.best_prints(t(PRINTS), t(PAGES).distinct())
    return best.withColumns({"score": F.round("score", 6), "tied": F.array_join("tied", "|")})


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'direct' ELSE 'variant' END AS method, CASE WHEN page_id % 3 = 0 THEN url ELSE replace(url, 'http', 'HTTP') END AS found FROM pages")
def w18_resolution_ladder(t):
    pages = t("pages").select("page_id", "url")
    there = pages.select(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.replace(F.col("url"), F.lit("http"), F.lit("HTTP"))).alias("key"))
    return X.resolution_ladder(pages, "page_id", [("direct", F.col("url")), ("variant", F.array(F.lower("url"), F.replace(F.col("url"), F.lit("http"), F.lit("HTTP"))))], there, "key")


@query("""SELECT p_partkey AS print_id, CASE p_partkey % 4 WHEN 0 THEN 'a' || CAST(p_partkey AS STRING) || 'set.jpg' WHEN 1 THEN NULL WHEN 2 THEN 'b.jpg' ELSE 'only' || CAST(p_partkey AS STRING) || '.jpg' END AS file FROM part""")
def w19_infobox_image(t):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    field = lambda f, c: F.struct(f.alias("file"), c.cast("string").alias("caption"))
    own, other = F.concat(F.lit("a"), n, F.lit("set.jpg")), F.concat(F.lit("c"), n, F.lit("x.jpg"))
    none = F.array().cast("array<struct<file:string,caption:string>>")
    fields = (
        F.when(k == 0, F.array(field(own, F.lit("Big Set print")), field(F.lit("z999999.jpg"), F.lit(None))))
        .when(k == 1, F.array(field(own, F.lit(None)), field(other, F.lit("big set"))))
        .when(k == 2, F.array(field(F.lit("b.jpg"), F.lit("in BIG SET"))))
        .otherwise(none)
    )
    prints = t("part").select(F.col("p_partkey").alias("print_id"), F.concat(F.lit("0"), n, F.lit("/9")).alias("number"), F.array(F.lit(" Big Set ")).alias("set_names"), F.concat(F.lit("only"), n, F.lit(".jpg")).alias("image"), fields.alias("fields"))
    return X.infobox_image(prints)
