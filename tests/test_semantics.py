"""Domain semantics on small fixtures."""

import random
import re

import pytest
from compare import SF
from pyspark.sql import functions as F

from quarry.functions import classify as C
from quarry.functions import predicates as P
from quarry.functions import text as T
from quarry.operators import collection as L
from quarry.operators import forms as O
from quarry.operators import keyed as K
from quarry.operators import match as X
from quarry.operators import merge as M
from quarry.plans import matching, tables
from quarry.sources import catalog as S
from quarry.sources import extract as E
from quarry.streaming.state import next_state


def column(spark, values, f, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("value", "code"),
    [("sm0198/236", "SM198"), ("074", "74"), ("H04", "H4"), ("abc", "ABC"), ("15a1", "15A1"), ("", "")],
)
def test_card_code(spark, value, code):
    assert column(spark, [value], T.normalize_card_code) == [code]


def test_names_of_powered_forms(spark):
    names = ["Mega Gear X ex", "M Gear-EX", "Mega-Gear-ex", "メガリングXex", "メガリング", "Megan", "M Gear", "Mega A & B GX"]
    assert column(spark, names, C.is_mega_name) == [True, True, True, True, False, False, False, True]
    assert column(spark, ["Ring VMAX", "Ring-VMAX", "王VMAX", "VMAX Ring", "RingVMAX"], C.is_vmax_name) == [True, True, True, False, False]
    assert column(spark, ["Mega A X ex", "Mega A Y-ex", "メガAXex", "M A EX", None], C.variant_token) == ["X", "Y", "X", None, None]


@pytest.mark.parametrize(("title", "want"), [("Ring (Promo SM198)", ("Ring", "Promo", "SM198")), ("Ring (First Battle)", ("Ring", "First Battle", None)), ("Ring (198)", None), ("Ring", None), ("Ring (Promo)", ("Ring", "Promo", None))])
def test_disambiguator(spark, title, want):
    found = column(spark, [title], T.print_disambiguator)[0]
    assert (found and tuple(found)) == want


def test_era_order_matters(spark):
    era = lambda c: C.era(c, [("base|ex\\d", "classic"), ("dp|hgss", "transitional"), ("sm|sv", "modern")], {"hs": "transitional", "ex": "classic"}, r"^20\d\d(sm|sv)$", r"^tk-([a-z]+)-", "modern")
    assert column(spark, ["2017sm", "tk-hs-g", "tk-ex-m", "ex1", "dp2", "zzz", " HGSS1 "], era) == ["modern", "transitional", "classic", "classic", "transitional", "modern", "transitional"]


def test_violations_count_null_as_failing(spark):
    rules = {"there": F.col("v").isNotNull(), "long": F.length("v") > 2}
    assert column(spark, ["abc", "a", None], lambda _: P.violated(rules)) == [[], ["long"], ["there", "long"]]
    assert column(spark, ["a..", "..", "", None], P.safe_id) == [True, False, False, None]


def test_language_text_ladder(spark):
    df = spark.createDataFrame([({"pt-br": "b", "en": "e"}, "pt"), ({"en": "e", "fr": "f"}, "pt-br"), ({"fr": "f"}, "de"), ({"pt": "", "pt-br": ""}, "pt")], "m map<string,string>, l string")
    assert [r[0] for r in df.select(T.resolve_language_text(F.col("m"), F.col("l"))).collect()] == ["b", "e", "f", None]


def test_image_less_first_source_row_blocks_the_fill(spark):
    target = spark.createDataFrame([("a", None), ("b", None), ("c", "x")], "k string, img string")
    source = spark.createDataFrame([("a", 1, None), ("a", 2, "no"), ("b", 1, "yes"), ("c", 1, "z")], "k string, pos int, img string")
    found = {r["k"]: (r["img"], r["outcome"]) for r in M.same_print_fill(target, source, "k", "img", ["pos"]).collect()}
    assert found == {"a": (None, "missing"), "b": ("yes", "filled"), "c": ("x", "had")}


def test_guards_are_opposite(spark):
    old = spark.range(100).select(F.col("id").alias("k"))
    new = spark.range(90, 200).select(F.col("id").alias("k"), F.lit("s").alias("g"))
    assert M.overlap_guard(old, new, "g", "k", supplement=True).first()["refused"]
    assert not M.overlap_guard(old, new, "g", "k", supplement=False).first()["refused"]


def test_override_to_an_inactive_group_hides(spark):
    cards = spark.createDataFrame([(1, "Ring", "rare", "s"), (2, "Mega Ring ex", "rare", "s"), (3, "Rod", "none", "stg"), (4, "Rod", "none", "s")], "id int, name string, rarity string, set_id string")
    groups = spark.createDataFrame([("full", "rare"), ("also", "rare")], "group_id string, rarity string")
    over = spark.createDataFrame([(1, "off"), (2, "off")], "card_id int, group_id string")
    gallery = F.when(P.trainer_gallery(F.col("set_id")), "full")
    shown = lambda *active: sorted(r["id"] for r in L.available_cards(cards, groups, active, over, gallery).collect())
    assert shown("full", "also") == [3]
    assert shown("full", "mega") == [2, 3]
    assert shown("off") == [1, 2]


def test_ambiguity_gives_nothing(spark):
    names = spark.createDataFrame([("big ring",), ("gear",), ("rod",), ("ab",)], "n string")
    targets = spark.createDataFrame([("ring",), ("gear box",), ("gear set",), ("rod",), ("b",)], "t string")
    found = {r["name"]: (r["target"], r["how"]) for r in X.fuzzy_set_match(names, targets, "n", "t").collect()}
    assert found == {"big ring": ("ring", "contained"), "gear": (None, "ambiguous"), "rod": ("rod", "exact"), "ab": (None, "none")}


def in_turn(cards, rows):
    """Each card in order takes the first free row of its code, else the first free one that a prefix accounts for."""

    def parts(code):
        letters, digits, rest = re.match(r"([A-Za-z]*)0*(\d+)(.*)", code).groups()
        return letters.upper(), digits + rest.upper()

    def words(name):
        return {w[:-1] if len(w) > 3 and w.endswith("s") else w for w in re.findall("[a-z0-9]+", name.lower())}

    def by_prefix(a, b, name):
        return a[1] == b[1] and bool(a[0]) != bool(b[0]) and (a[0] or b[0]).lower() in words(name)

    out = set()
    for group in {c[0] for c in cards}:
        free = sorted((r for r in rows if r[0] == group), key=lambda r: r[1])
        for _, pos, code in sorted((c for c in cards if c[0] == group), key=lambda c: c[1]):
            hit = next(((r, "exact") for r in free if parts(r[2]) == parts(code)), None)
            hit = hit or next(((r, "prefix") for r in free if by_prefix(parts(code), parts(r[2]), r[3] or group)), None)
            if hit:
                free.remove(hit[0])
                out.add((group, pos, hit[0][1], hit[1]))
    return out


def test_code_rows_are_matched_once(spark):
    cards = [("SM Promos", 1, "SM01"), ("SM Promos", 2, "1"), ("SM Promos", 3, "2"), ("SM Promos", 4, "XY5"), ("Old Gears", 5, "GEAR7")]
    rows = [("SM Promos", 10, "1", None), ("SM Promos", 11, "SM2", None), ("SM Promos", 12, "5", "XY Box"), ("SM Promos", 13, "1", None), ("Old Gears", 14, "7", None)]
    draw = random.Random(2)
    code = lambda: draw.choice(["", "SM", "XY", "TG"]) + str(draw.randrange(1, 9))
    cards += [(f"SM XY {k % 3}", 100 + k, code()) for k in range(60)]
    rows += [(f"SM XY {k % 3}", 200 + k, code(), draw.choice([None, "TG box", "SM"])) for k in range(60)]
    found = X.code_match_rows(spark.createDataFrame(cards, "g string, card_pos long, code string"), spark.createDataFrame(rows, "g string, row_pos long, code string, context string"), "g")
    want = in_turn(cards, rows)
    assert {(r["g"], r["card_pos"], r["row_pos"], r["how"]) for r in found.collect()} == want
    assert {("SM Promos", 1, 10, "prefix"), ("SM Promos", 2, 13, "exact"), ("SM Promos", 3, 11, "prefix"), ("SM Promos", 4, 12, "prefix"), ("Old Gears", 5, 14, "prefix")} <= want


def test_code_rows_of_the_query(spark):
    """The query of J26 against one card after the other."""
    t = lambda text: tables.sql(spark, SF, text)
    cards = [(r["set_name"], r["card_pos"], r["code"]) for r in t(matching.HELD_CODES).collect()]
    rows = [(r["set_name"], r["row_pos"], r["code"], r["context"]) for r in t(matching.ROW_CODES).collect()]
    want = in_turn(cards, rows)
    found = tables.QUERIES["j26_code_match_rows"](spark, SF)
    assert {(r["set_name"], r["card_pos"], r["row_pos"], r["how"]) for r in found.collect()} == want and found.count() == len(want)
    assert {how for *_, how in want} == {"exact", "prefix"}


def test_cards_that_turn_each_other_away(spark):
    """Kinds with one list compete for every row; a kind without offers gets nothing."""
    cards = [(1, kind, 3 * k + i) for i, kind in enumerate("abc") for k in range(6)] + [(2, "a", 99)]
    offers = [(1, kind, row, "exact" if kind == "b" and row % 2 else "prefix") for kind in "ab" for row in range(9)]
    found = X.in_card_order(spark.createDataFrame(cards, "g int, kind string, card_pos long"), spark.createDataFrame(offers, "g int, kind string, row_pos long, how string"), ["g"], "kind")
    free, want = set(range(9)), set()
    for g, kind, pos in sorted(cards, key=lambda c: c[2]):
        mine = sorted((how, row) for og, ok, row, how in offers if (og, ok) == (g, kind) and row in free)
        if mine:
            free.remove(mine[0][1])
            want.add((pos, mine[0][1]))
    assert {(r["card_pos"], r["row_pos"]) for r in found.collect()} == want


def test_native_matches(spark):
    cards = spark.createDataFrame([(i, "box", loc, 7) for i, loc in enumerate(["1", "2", "3", "9"])] + [(4, "two", "1", 7), (5, "none", "1", 7), (6, "lone box set", "5", 8)], "card_id int, set_key string, local_key string, species int")
    source = [(10, "box", "1", [7]), (11, "box", "2", [4]), (12, "box", "3", []), (13, "box", "3", [7]), (14, "two", None, [7]), (15, "two", "4", [7, 7]), (16, "lone box", None, [8, 8]), (17, "box b", None, [1])]
    found = {r["card_id"]: (r["kind"], r["source_id"]) for r in X.match_japanese(cards, spark.createDataFrame(source, "source_id int, set_key string, local_key string, species array<int>")).collect()}
    # the conflict keeps its row; several rows of the species are ambiguous
    assert found[0] == ("primary", 10) and found[1] == ("species-conflict", 11) and found[2] == ("ambiguous", None) and found[3] == ("ambiguous", None)
    assert found[4] == ("ambiguous", None) and found[5] == ("none", None)
    nothing = spark.createDataFrame([(10, "box", "1", None)], "source_id int, set_key string, local_key string, species array<int>")
    assert X.match_japanese(cards.where("card_id = 0"), nothing).first()["kind"] == "primary"  # no species at all don't conflict
    one = spark.createDataFrame(source[4:5] + source[6:7], "source_id int, set_key string, local_key string, species array<int>")
    found = {r["card_id"]: (r["kind"], r["source_id"]) for r in X.match_japanese(cards, one).collect()}
    assert found[4] == ("fallback-species", 14) and found[6] == ("fallback-species", 16)


def test_latin_matches(spark):
    cards = spark.createDataFrame([(1, "box", "1", "kel"), (2, "box", "2", "kel"), (3, "box", "3", "x"), (4, "box deluxe", "1", "kel")], "card_id int, set_key string, local_key string, name_key string")
    source = spark.createDataFrame([(10, "box", "1", "other", []), (11, "box", "2", "kel two", []), (12, "box", "2", "zed", []), (13, "box", "3", "a", ["big x"]), (14, "box", "3", "b", [])], "source_id int, set_key string, local_key string, name_key string, species_keys array<string>")
    found = {r["card_id"]: (r["kind"], r["source_id"]) for r in X.match_english(cards, source).collect()}
    assert found == {1: ("primary", 10), 2: ("primary", 11), 3: ("primary", 13), 4: ("primary", 10)}


def test_accents(spark):
    import unicodedata

    texts = ["Élan ÀB straße 日本語", "Ångström K\u212a e\u0301x", "ﬁ ½ Ǆ ế", "", None]
    plain = lambda v: v if v is None else re.sub("[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c)).lower()).strip()
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_ascii(F.col("t")).alias("a")).collect()
    assert [r["a"] for r in rows] == [plain(r["t"]) for r in rows]


def test_longest_species_wins(spark):
    words = spark.createDataFrame([("Kel", 0), ("Kel Two", 1), ("Ke", 2)], "w string, pos int")
    df = spark.createDataFrame([(0, "kel two-star"), (1, "Kel"), (2, "Kelling"), (3, None), (4, "")], "k int, t string")
    assert [r["matched"] for r in X.match_prefix(df, "k", "t", words, "w", "pos").orderBy("k").collect()] == ["Kel Two", "Kel", None, None, None]


def test_mega_variants(spark):
    cards = spark.createDataFrame(
        [(1, 6, "Lizard", "a", "1", 0), (2, 6, "Mega Lizard X ex", "a", "2", 1), (3, 6, "M Lizard EX", "a", "3", 2), (4, 7, "Mega Other & Turtle GX", "a", "4", 3), (5, 7, "Turtle", "a", "5", 4), (6, 6, "M Lizard-EX", "b", "06", 5)],
        "id int, species int, name string, set_id string, local_id string, pos int",
    )
    forms = spark.createDataFrame([(101, 6, "l-mega-x"), (102, 6, "l-mega-y"), (103, 7, "t-mega")], "number int, base_number int, slug string")
    over = spark.createDataFrame([("B::6", "Y")], "print_key string, variant string")
    found = {(r["number"], r["id"]) for r in O.mega_members(cards, forms, over, [6], [6]).collect()}
    assert found == {(101, 2), (101, 3), (102, 3), (102, 6)}


@pytest.mark.parametrize("by_column", [False, True])
def test_slots_and_back(spark, by_column):
    df = spark.range(50).select(F.col("id").cast("int").alias("i"))
    rows = L.binder_slots(df, "i", 3, 4, 4, by_column)
    back = rows.select("i", L.slot_index(F.col("page"), F.col("row"), F.col("col"), 3, 4, by_column).alias("j")).collect()
    assert len(back) == 48 and all(r["i"] == r["j"] for r in back)
    assert L.binder_slots(df, "i", 0, 4, 4).count() == 0
    first = rows.where("i = 1").first()
    assert (first["row"], first["col"]) == ((1, 0) if by_column else (0, 1))


def test_collection_rules(spark):
    events = [("wish", 1, "a"), ("wish", 1, "b"), ("own", 1, "c"), ("wish", 1, "d"), ("wish", 2, "x"), ("wish", 2, "x"), ("wish", 3, "y"), ("own", 4, "z"), ("unown", 4, "z"), ("wish", 5, None), ("look", 6, "q")]
    df = spark.createDataFrame([(1, k, *e) for k, e in enumerate(events)], "user long, seq long, action string, species long, card_id string")
    assert sorted(map(tuple, L.collection_state(df).select("kind", "species", "card_id").collect())) == [("owned", 1, "c"), ("wish", 1, "d"), ("wish", 3, "y")]
    assert L.collection_state(df.limit(0)).count() == 0


def test_a_busy_species_lies_in_several_blocks(spark):
    """Random events of few keys, dealt to many partitions, against one fold after the other."""
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["own", "unown", "wish", "wish", "wish", "unwish", "look"]) if rng.random() < 0.3 else "wish", rng.choice([7, 7, 7, 8, 9]), rng.choice("abcd")) for k in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        for n in (1, 57, 3000):
            state = {}
            for _, _, action, species, card in rows[:n]:
                state[species] = next_state(*state.get(species, (None, None)), action, card)
            found = L.species_state(spark.createDataFrame(rows[:n], "user long, seq long, action string, species long, card_id string").repartition(5))
            assert {r["species"]: (r["owned"], r["wish"]) for r in found.collect()} == state
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_limit_counts_whole_units(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (1, 1, 2), (3, 1, 3), (4, 2, 4)], "k int, u int, p int")
    assert sorted(r["k"] for r in K.limit_distinct(df, "k", 3, "u", "p").collect()) == [1, 2, 3]


def test_catalog_files(spark, tmp_path):
    (tmp_path / "en").mkdir()
    (tmp_path / "en.json").write_text('{"1": [{"id": "a", "dexNumber": 1}, {"id": "b"}]}')
    (tmp_path / "en" / "gen2.json").write_text('{"152": [{"id": "c"}]}')
    (tmp_path / "de.json").write_text("{broken")
    rows = S.read_catalog(spark, str(tmp_path))
    assert sorted((r["key"], r["pos"], r["id"]) for r in rows.collect()) == [("1", 0, "a"), ("1", 1, "b"), ("152", 0, "c")]


def test_gapless_or_fail(spark):
    assert S.require_gapless(spark.range(1, 6), "id", 5).count() == 5
    with pytest.raises(Exception, match="numbers are missing"):
        S.require_gapless(spark.range(1, 5), "id", 5).collect()


def test_wikitext(spark):
    text = "{{Set Infobox|name=A|image=[[File:x.png|a]]}}\n== Cards ==\n{{l/entry|001/9|{{TCG ID|Base|Ring|4}}|Fire|Rare|new}}\n{{l/nmentry|2|[[Rod (Base 5)|Rod]]|Tool|n}}\n{{l/entry|3|open\n== Rest ==\nx"
    pages = spark.createDataFrame([("p", text), ("none", None), ("empty", "")], "title string, wikitext string")
    rows = [tuple(r) for r in E.setlist_rows(pages).orderBy("pos").collect()]
    assert rows == [("p", 0, "entry", "001/9", "Ring", "Ring (Base 4)", "Fire", "Rare", "new"), ("p", 1, "nmentry", "2", "Rod", "Rod (Base 5)", "Tool", None, "n")]
    assert E.infobox(pages).where("title = 'p'").first()["fields"] == {"name": "A", "image": "[[File:x.png|a]]"}
    assert E.section(F.col("wikitext"), F.lit("rest")) is not None
    assert pages.select(E.section(F.col("wikitext"), F.lit("Rest")).alias("s")).first()["s"] == "x"


def test_html_fields(spark):
    page = '<html><h1 class="a name">Ring <b>X</b></h1><p>no</p><img data-src="i.png"></html>'
    pages = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    rows = [tuple(r) for r in E.card_pages(pages, "html", {"name": ("h1", "name")}, ["id"]).collect()]
    assert rows == [(1, "Ring X", "i.png"), (2, None, None)]


def test_aliases_first_language_wins(spark):
    rows = spark.createDataFrame([(1, 0, "Rare", "rara"), (2, 0, "Common", "rara"), (1, 1, "Odd", "x"), (1, 2, "Rare", "Common"), (1, 3, "Common", " ")], "language_pos int, pos int, canonical string, localized string")
    assert [tuple(r) for r in C.derive_aliases(rows, ["Rare", "Common"]).collect()] == [("rara", "Rare", 1)]


def test_missing_numbers_fail_the_job(spark):
    whole = spark.range(1, 6).toDF("n")
    assert S.require_gapless(whole, "n", 5).count() == 5
    with pytest.raises(Exception, match="numbers are missing"):
        S.require_gapless(whole.where("n <> 3"), "n", 5).collect()
