"""Scalar text functions over Columns: codes, names, titles, URLs. Built-in expressions only, except where said."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def blank(value: Column) -> Column:
    """Null for an empty string: empty and missing are both absent."""
    return F.nullif(value, F.lit(""))


def print_key(set_id: Column, local_id: Column) -> Column:
    """Key of a print across sources: upper-case set id, local id without zeros that precede a digit."""
    return F.concat_ws("::", F.upper(set_id), F.regexp_replace(local_id, r"^0+(?=\d)", ""))


def normalize_set_code(raw: Column) -> Column:
    """Trimmed, without an image extension and without a trailing `` F``."""
    code = F.regexp_replace(F.trim(raw), r"(?i)\.(png|jpe?g|webp)$", "")
    return F.trim(F.regexp_replace(code, r"\s+F$", ""))


def normalize_local_id(value: Column) -> Column:
    """Trimmed, upper-case, without leading zeros before a digit."""
    return F.regexp_replace(F.upper(F.trim(value)), r"^0+(?=\d)", "")


def local_part(card_number: Column) -> Column:
    """``normalize_local_id`` of what stands before a slash; blank is null."""
    return blank(normalize_local_id(F.split_part(card_number, F.lit("/"), F.lit(1))))


def numerator(card_number: Column) -> Column:
    """What stands before a slash, trimmed, without leading zeros before a digit; case stays."""
    return F.regexp_replace(F.trim(F.split_part(card_number, F.lit("/"), F.lit(1))), r"^0+(?=\d)", "")


def normalize_card_code(code: Column) -> Column:
    """The part before a slash: upper case, and no zeros before the digits that follow its letters, if digits do."""
    text = F.trim(F.split_part(code, F.lit("/"), F.lit(1)))
    letters = F.regexp_extract(text, "^[A-Za-z]*", 0)
    digits = F.regexp_extract(F.substring(text, F.length(letters) + 1, F.length(text)), "^[0-9]*", 0)
    rest = F.substring(text, F.length(letters) + F.length(digits) + 1, F.length(text))
    bare = F.ltrim(digits, F.lit("0"))
    number = F.when(bare == "", "0").otherwise(bare)
    return F.upper(F.when(digits == "", text).otherwise(F.concat(letters, number, rest)))


def code_prefix(code: Column) -> Column:
    """Leading letters of a normalized code."""
    return F.regexp_extract(code, "^([A-Z]*)", 1)


def code_rest(code: Column) -> Column:
    """A normalized code without its leading letters."""
    return F.regexp_replace(code, "^[A-Z]*", "")


def tokens(value: Column, plural: bool = True) -> Column:
    """Distinct lower-case runs of letters and digits; with ``plural``, longer ones lose a final s."""
    found = F.filter(F.split(F.lower(value), "[^a-z0-9]+"), lambda t: t != "")
    if plural:
        found = F.transform(found, lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.regexp_replace(t, "s$", "")).otherwise(t))
    return F.array_distinct(found)


def token_overlap(a: Column, b: Column, plural: bool = True) -> Column:
    """Share of the first text's tokens that the second one has; 0 if the first has none."""
    return tokens_shared(tokens(a, plural), tokens(b, plural))


def tokens_shared(own: Column, other: Column) -> Column:
    """Share of the first tokens that are among the second; 0 if there are none."""
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, other)) / F.size(own))


def card_codes_match(held: Column, other: Column, other_set: Column) -> Column:
    """Equal codes, or equal rests where the one prefix that is there is a token of the other's set name."""
    a, b = normalize_card_code(held), normalize_card_code(other)
    pa, pb = code_prefix(a), code_prefix(b)
    only = F.when((pa != "") & (pb == ""), pa).when((pb != "") & (pa == ""), pb)
    return (a == b) | ((code_rest(a) == code_rest(b)) & F.coalesce(F.array_contains(tokens(other_set), F.lower(only)), F.lit(False)))


def slugify(name: Column, separator: str = "", fallback: str = "set") -> Column:
    """Without a parenthetical, lower-case; other characters are dropped or become one separator."""
    slug = F.regexp_replace(F.lower(F.regexp_replace(name, r"\s*\([^)]*\)", "")), "[^a-z0-9]+", separator)
    if separator:
        slug = F.regexp_replace(slug, f"^{separator}+|{separator}+$", "")
    return F.coalesce(blank(slug), F.lit(fallback))


def proposed_set_id(code: Column, name: Column) -> Column:
    """First segment of a code, cleaned and lower-case; without one the slug of the name."""
    first = F.regexp_replace(F.lower(F.split_part(F.trim(code), F.lit("/"), F.lit(1))), "[^a-z0-9.-]", "")
    return F.coalesce(blank(first), slugify(name))


def article_title(name: Column, language: Column, regional: tuple[str, ...] = ("id", "th")) -> Column:
    """Article title of a set: base name and the language's suffix."""
    base = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))
    return F.concat(base, F.when(language.isin(*regional), " (ATCG)").otherwise(" (TCG)"))


def set_name_of_title(title: Column) -> Column:
    """The inverse of ``article_title``."""
    return F.trim(F.regexp_replace(title, r"\s*\(A?TCG\)\s*$", ""))


def _swaps(title: Column, plain: str, accented: str) -> list[Column]:
    """Rewritten titles, in a stated order; null where a rewriting doesn't apply."""
    return [
        F.when(F.contains(title, F.lit(plain)), F.replace(title, F.lit(plain), F.lit(accented))),
        F.when(F.contains(title, F.lit(accented)), F.replace(title, F.lit(accented), F.lit(plain))),
        F.when(title.rlike(r"\s&\s"), F.regexp_replace(title, r"\s&\s", " and ")),
        F.when(title.rlike(r"(?i)\sand\s"), F.regexp_replace(title, r"(?i)\sand\s", " & ")),
        F.when(title.endswith("(ATCG)"), F.regexp_replace(title, r"\(ATCG\)$", "(TCG)")),
    ]


def title_variants(title: Column, plain: str = "Deja", accented: str = "Déjà") -> Column:
    """Titles reachable by one or two rewritings (accent, ``&`` and ``and``, regional suffix), without the title itself."""
    once = F.array_compact(F.array(*_swaps(title, plain, accented)))
    twice = F.flatten(F.transform(once, lambda t: F.array_compact(F.array(*_swaps(t, plain, accented)))))
    return F.filter(F.array_distinct(F.concat(once, twice)), lambda t: t != title)


def derive_set_id(card_id: Column, local_id: Column) -> Column:
    """Card id without ``-localId`` at its end, by length."""
    return F.substring(card_id, F.lit(1), F.length(card_id) - F.length(local_id) - 1)


def resolve_language_text(texts: Column, language: Column) -> Column:
    """Text of a language from a map: itself, a longer key that starts with its code, English, or the first non-empty."""
    entries = F.map_entries(texts)
    longer = F.try_element_at(F.filter(entries, lambda e: F.startswith(e["key"], F.concat(language, F.lit("-"))) & (e["value"] != "") & ~F.contains(language, F.lit("-"))), F.lit(1))
    first = F.try_element_at(F.filter(entries, lambda e: e["value"] != ""), F.lit(1))
    return F.coalesce(blank(F.element_at(texts, language)), longer["value"], blank(F.element_at(texts, F.lit("en"))), first["value"])


def local_id_from_file(file_name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def asset_url(base: str, *parts: Column) -> Column:
    """URL of an asset below ``base``."""
    return F.concat_ws("/", F.lit(base), *parts)


def image_url(image_base: Column, quality: str = "low", extension: str = "webp") -> Column:
    """Image of a card in one quality."""
    return F.concat(image_base, F.lit(f"/{quality}.{extension}"))


def percent_encode(value: Column) -> Column:
    """Percent-encoding that leaves ``- _ . ! ~ * ' ( )`` bare, spaces as ``%20``."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for escape, bare in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(escape), F.lit(bare))
    return out


def search_url(base: str, *terms: Column) -> Column:
    """Search link with the terms, joined by spaces, as its query."""
    return F.concat(F.lit(f"{base}?q="), percent_encode(F.concat_ws(" ", *terms)))


def extension_for_type(content_type: Column) -> Column:
    """File extension of an image's MIME type; any other type fails the job."""
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.when(kind == "image/jpeg", "jpg").when(kind == "image/png", "png").when(kind == "image/webp", "webp").otherwise(F.raise_error(F.concat(F.lit("unknown image type "), content_type)))


def guess_filenames(card_name: Column, set_names: list[Column], number: Column) -> Column:
    """Candidate file names in order: each set in turn, jpg before png; letters and digits of name and set only."""
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "")
    bases = [F.concat(clean(card_name), clean(s), numerator(number)) for s in set_names]
    return F.array_distinct(F.array_compact(F.array(*[F.concat(b, F.lit(f".{e}")) for b in bases for e in ("jpg", "png")])))


#: Letters that a card number may begin with, and the shares of set tokens that a title needs with and without a number: fixed values.
CODE_LETTERS, SET_SHARE, SET_SHARE_ALONE = 8, 0.5, 0.75


def looks_like_code(token: Column) -> Column:
    """Whether a token may be a card number: a few letters or none, a digit, then letters and digits."""
    rest = F.regexp_replace(token, "^[A-Za-z]+", "")
    return (F.length(token) - F.length(rest) <= CODE_LETTERS) & F.substring(rest, 1, 1).between("0", "9") & ~rest.rlike("[^A-Za-z0-9]")


def _bracketed(title: Column) -> tuple[Column, Column]:
    """What stands before and in the brackets that end a title; null without them, or if nothing parts them from the name."""
    back = F.instr(F.reverse(title), F.lit("("))  # the last opening bracket, from the end
    size = F.length(title)
    head, inner = F.substring(title, F.lit(1), size - back), F.substring(title, size - back + 2, back - 2)
    whole = title.endswith(")") & (back > 2) & head.rlike(r"\s$") & ~F.contains(inner, F.lit(")"))
    return F.when(whole, F.trim(head)), F.when(whole, F.trim(inner))


def print_disambiguator(title: Column, need_number: bool = False) -> Column:
    """``Name (Set Number)`` as a struct (name, set_name, number), else null; the number may be absent unless needed."""
    name, inner = _bracketed(title)
    words = F.split(inner, " +")
    last = F.element_at(words, -1)
    first = F.trim(F.substring(inner, F.lit(1), F.length(inner) - F.length(last)))
    numbered = F.struct(name.alias("name"), first.alias("set_name"), last.alias("number"))
    alone = F.struct(name.alias("name"), inner.alias("set_name"), F.lit(None).cast("string").alias("number"))
    there = (name != "") & (inner != "")
    several = F.size(words) > 1
    if need_number:
        return F.when(there & several, numbered)
    return F.when(there & several & looks_like_code(last), numbered).when(there & (several | ~looks_like_code(last)), alone)


def match_print(title: Column, name: Column, set_name: Column, local_id: Column) -> Column:
    """Why a page's title is not a card's print; ``ok`` where it is.

    Three things are held against the title's brackets: the name, the number if they have one, and the share of the
    set's tokens, of which a title without a number needs more.
    """
    page = print_disambiguator(title)
    bare = page["number"].isNull()
    rules = [
        ("no disambiguator", page.isNull()),
        ("name", F.lower(page["name"]) != F.lower(name)),
        ("number", ~bare & ~card_codes_match(local_id, page["number"], page["set_name"])),
        ("set", token_overlap(set_name, page["set_name"]) < F.when(bare, SET_SHARE_ALONE).otherwise(SET_SHARE)),
    ]
    return F.coalesce(*[F.when(broken, reason) for reason, broken in rules], F.lit("ok"))


def infobox_code(fields: Column, pattern: str = r"CS\d+[a-zA-Z]?") -> Column:
    """First match of a code in a map's values."""
    hits = F.filter(F.map_values(fields), lambda v: v.rlike(pattern))
    return F.when(F.size(hits) > 0, F.regexp_extract(F.element_at(hits, 1), f"({pattern})", 1))


def rename_if_latin(name: Column, native: Column) -> Column:
    """The matched native name where the name holds Latin letters and the native one has none."""
    return F.when(name.rlike("[A-Za-z]") & native.isNotNull() & (native != "") & ~native.rlike("[A-Za-z]"), native).otherwise(name)


@cache
def _accented() -> tuple[str, str]:
    """Characters that are an ASCII letter or digit with marks, and those letters or digits."""
    parts = ((chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000)
    found = [(c, p[0]) for c, p in parts if p[0] < "\x80" and p[0].isalnum() and all(unicodedata.combining(x) for x in p[1:])]
    return "".join(c for c, _ in found), "".join(p for _, p in found)


def normalize_ascii(value: Column) -> Column:
    """Without accents, lower-case, other characters as one space."""
    bare = F.translate(F.regexp_replace(value, r"\p{Mn}+", ""), *_accented())
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def normalize_native(values: pd.Series) -> pd.Series:
    """Compatibility composed (NFKC), trimmed, runs of white space as one space."""
    return values.map(lambda v: v if v is None else " ".join(unicodedata.normalize("NFKC", v).split()))
