"""Classification of items: rarity vocabulary, foil tier, era, name families, ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import blank

# Rarities by foil tier, in lower case; every other rarity is "sheen".
FOIL_TIERS = {
    "none": ("common", "uncommon"),
    "holo": (
        "common holo", "double rare", "holo rare", "holo rare v", "holo rare vmax", "holo rare vstar", "radiant rare", "rare holo",
        "rare holo lv.x", "rare prime", "rare vmax", "rare vstar", "shiny rare", "shiny rare v", "shiny rare vmax", "uncommon holo",
    ),
    "ultra": ("hyper rare", "illustration rare", "mega hyper rare", "secret rare", "shiny ultra rare", "special illustration rare", "ultra rare", "ultra-rare rare"),
}
# Names of the two families of powered forms.
MEGA_NAME = r"^M[- ][A-Za-zÀ-ÿ].*[- ]EX$|^Mega[ -][A-Za-zÀ-ÿ].*\b(ex|GX)$|^メガ.+ex$"
VMAX_NAME = r"[ -]VMAX$|[㐀-鿿぀-ヿ]VMAX"


def foil_tier(rarity: Column) -> Column:
    """Foil treatment of a rarity: ultra, holo, none, else sheen."""
    value = F.lower(F.trim(rarity))
    return F.when(value.isin(*FOIL_TIERS["ultra"]), "ultra").when(value.isin(*FOIL_TIERS["holo"]), "holo").when(value.isin(*FOIL_TIERS["none"]), "none").otherwise("sheen")


def era(set_id: Column, prefixes: Sequence[tuple[str, str]], exact: Mapping[str, str], dated: str, deck: str, default: str) -> Column:
    """Era of a set id by its token: exact tokens first, then patterns in order, else the default.

    The token is group 1 of ``dated``, else of ``deck``, else the id itself; ``prefixes`` pairs a pattern with its era.
    """
    value = F.lower(F.trim(set_id))
    token = F.coalesce(blank(F.regexp_extract(value, dated, 1)), blank(F.regexp_extract(value, deck, 1)), value)
    out = F.when(F.lit(False), F.lit(default))
    for name, found in exact.items():
        out = out.when(token == name, found)
    for pattern, found in prefixes:
        out = out.when(token.rlike(f"^(?:{pattern})"), found)
    return out.otherwise(default)


def is_mega_name(name: Column) -> Column:
    return name.rlike(MEGA_NAME)


def is_vmax_name(name: Column) -> Column:
    return name.rlike(VMAX_NAME)


def variant_token(name: Column) -> Column:
    """A standalone X, Y or Z, else one fused to a final ``ex``, else null."""
    return F.coalesce(blank(F.regexp_extract(name, r"(?:^|[\s-])([XYZ])(?=$|[\s-])", 1)), blank(F.regexp_extract(name, "([XYZ])ex$", 1)))


def regional_pattern(template: Column, label: Column) -> Column:
    """A marker template with ``{}`` replaced by the escaped species label."""
    escaped = F.regexp_replace(label, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.replace(template, F.lit("{}"), escaped)


def normalize_rarity(df: DataFrame, column: str, aliases: DataFrame, canonical: Sequence[str], to: str = "canonical", unknown: str = "Unknown") -> DataFrame:
    """Adds ``to``: canonical spellings pass, aliases (raw, canonical) map, blanks and all else become ``unknown``.

    ``aliases`` is a dictionary; the join is left to Spark, which broadcasts it while it is small.
    """
    raw = F.trim(F.col(column))
    found = df.withColumn("_raw", raw).join(aliases.select(F.col("raw").alias("_raw"), F.col("canonical").alias("_to")), "_raw", "left")
    value = F.when(F.col("_raw").isin(*canonical), F.col("_raw")).otherwise(F.coalesce(F.col("_to"), F.lit(unknown)))
    return found.withColumn(to, value).drop("_raw", "_to")


def derive_aliases(dictionary: DataFrame, canonical: Sequence[str]) -> DataFrame:
    """raw, canonical and n_conflicts from a dictionary (language_pos, pos, canonical, localized).

    Targets that aren't canonical, blanks and raws that are canonical themselves are left out; the first language wins,
    later ones that disagree are conflicts.
    """
    rows = dictionary.withColumn("raw", F.trim("localized")).where(F.col("canonical").isin(*canonical) & (F.col("raw") != "") & ~F.col("raw").isin(*canonical))
    order = Window.partitionBy("raw").orderBy("language_pos", "pos")
    winner = F.first("canonical").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = rows.withColumn("winner", winner)
    return marked.groupBy("raw", F.col("winner").alias("canonical")).agg(F.count_if(F.col("canonical") != F.col("winner")).alias("n_conflicts"))


def generation_of(number: Column, ranges: Sequence[tuple[int, int, str]], strict: bool = False) -> Column:
    """Label of the disjoint range that holds a number; outside all of them null, or an error where ``strict``."""
    out = F.when(F.lit(False), F.lit(""))
    for low, high, label in ranges:
        out = out.when(number.between(low, high), label)
    return out.otherwise(F.raise_error(F.concat(F.lit("no range for "), number.cast("string")))) if strict else out


def is_synthetic(number: Column, base: int = 20000) -> Column:
    """Numbers of synthetic forms start at ``base``."""
    return number >= base


def translate_field(df: DataFrame, column: str, dictionary: DataFrame, field: str) -> DataFrame:
    """Replaces a value by its translation (field, source, target); unchanged where there is none."""
    own = dictionary.where(F.col("field") == field).select(F.col("source").alias(column), F.col("target").alias("_target"))
    return df.join(own, column, "left").withColumn(column, F.coalesce("_target", column)).drop("_target")
