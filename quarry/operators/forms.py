"""Synthetic forms over base items: which cards belong to which form of a species."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.classify import is_mega_name, is_vmax_name, regional_pattern, variant_token
from quarry.functions.text import blank, print_key


def form_lookup(forms: DataFrame, number: int | None = None, base: int | None = None) -> DataFrame:
    """Forms by their own number, or all forms of a base species."""
    return forms.where(F.col("number") == number) if number is not None else forms.where(F.col("base_number") == base)


def entry_variant(slug: Column) -> Column:
    """X, Y or Z by the end of a form's slug."""
    return F.upper(blank(F.regexp_extract(slug, "-mega-([xyz])$", 1)))


def with_reference_name(cards: DataFrame, species: str = "species", name: str = "name", position: str = "pos") -> DataFrame:
    """Adds ``reference``: the shortest plain name of the species (first on ties), null if none is plain."""
    plain = ~F.contains(F.col(name), F.lit("&")) & ~is_mega_name(F.trim(name))
    own = cards.where(plain).groupBy(species).agg(F.min_by(F.trim(name), F.struct(F.length(F.trim(name)), position)).alias("reference"))
    return cards.join(own, species, "left")


def mega_members(cards: DataFrame, forms: DataFrame, overrides: DataFrame, split: Sequence[int], ambiguous: Sequence[int]) -> DataFrame:
    """Pairs of a form (number, base_number, slug) and a card of its base species that shows it.

    cards: species, name, set_id, local_id, pos, id. Species in ``split`` tell X, Y and Z apart; a print override
    (print_key, variant) beats the name; a name without a letter shows on every form of the ``ambiguous`` species. On a
    card of several species the tag belongs to the first name only.
    """
    rows = with_reference_name(cards).withColumn("print_key", print_key(F.col("set_id"), F.col("local_id"))).join(overrides.select("print_key", F.col("variant").alias("override")), "print_key", "left")
    rows = rows.where(is_mega_name(F.col("name"))).join(forms, F.col("species") == F.col("base_number"))
    first = F.trim(F.substring_index("name", "&", 1))
    token = F.coalesce(blank(F.regexp_extract(first, "^(?:Mega|M)[- ](.+)$", 1)), blank(F.regexp_extract(first, "^メガ(.+)$", 1)))
    token = F.when(F.contains("name", F.lit("&")), F.lower(F.trim(token)))
    reference = F.lower(F.trim("reference"))
    owns = token.isNull() | F.col("reference").isNull() | (token == reference) | (F.regexp_replace(token, r"\s+[xyz]$", "") == reference)
    wanted, letter = entry_variant(F.col("slug")), variant_token(F.col("name"))
    shown = (
        F.when(~F.col("base_number").isin(*split), F.lit(True))
        .when(F.col("override").isNotNull(), F.coalesce(F.col("override") == wanted, F.lit(False)))
        .when(wanted.isNull(), letter.isNull())
        .when(letter.isNull(), F.col("base_number").isin(*ambiguous))
        .otherwise(letter == wanted)
    )
    return rows.where(owns & shown).select("number", "id")


def vmax_members(cards: DataFrame, forms: DataFrame) -> DataFrame:
    """Pairs of a form (number, base_number, label) and a card: the only form takes all, siblings need their word in the name."""
    siblings = F.count("*").over(Window.partitionBy("base_number"))
    word = blank(F.trim(F.regexp_replace(F.regexp_extract("label", r"\(([^)]+)\)$", 1), r"\s+Style$", "")))
    own = forms.withColumn("siblings", siblings).withColumn("word", word)
    rows = cards.where(is_vmax_name(F.col("name"))).join(own, F.col("species") == F.col("base_number"))
    return rows.where((F.col("siblings") == 1) | F.col("word").isNull() | F.contains(F.lower("name"), F.lower("word"))).select("number", "id")


def regional_members(cards: DataFrame, forms: DataFrame, templates: DataFrame) -> DataFrame:
    """Pairs of a form (number, base_number, label, family) and a card whose name a template of the family matches."""
    patterns = forms.join(templates, "family").select("number", "base_number", regional_pattern(F.col("template"), F.col("label")).alias("pattern"))
    rows = cards.join(patterns, F.col("species") == F.col("base_number"))
    return rows.where(F.rlike("name", F.col("pattern"))).select("number", "id").distinct()


def exclude_regional(cards: DataFrame, members: DataFrame) -> DataFrame:
    """Base cards without those that belong to a regional form."""
    return cards.join(members.select("id"), "id", "left_anti")


def synthetic_form_view(forms: DataFrame, cards: DataFrame, matchers: Mapping[str, Callable[[], Column]]) -> DataFrame:
    """Forms with their cards in one join; the matcher of a form's family is a function that returns a Column."""
    rows = forms.join(cards, F.col("species") == F.col("base_number"))
    hit = F.lit(False)
    for family, matcher in matchers.items():
        hit = hit | ((F.col("family") == family) & matcher())
    return rows.where(hit)
