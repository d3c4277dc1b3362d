"""Collections: what is available, owned and wished for, and how it is laid out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.classify import is_mega_name, is_vmax_name
from quarry.sources.folders import keep


def available_cards(cards: DataFrame, groups: DataFrame, active: Sequence[str], overrides: DataFrame, fallback_group: Column | None = None, mega: str = "mega", vmax: str = "vmax") -> DataFrame:
    """``cards`` (id, name, rarity) that show under the active groups.

    A card's group by override, else by ``fallback_group``, decides alone if there is one; else its rarity must be in an
    active group (group_id, rarity). Afterwards the two name families may re-admit a card while their group is active.
    """
    on = groups.where(F.col("group_id").isin(*active)).select("rarity").distinct().withColumn("_on", F.lit(True))
    rows = cards.join(overrides.select(F.col("card_id").alias("id"), F.col("group_id").alias("_over")), "id", "left").join(on, "rarity", "left")
    decided = F.coalesce(F.col("_over"), fallback_group if fallback_group is not None else F.lit(None).cast("string"))
    shown = F.when(decided.isNotNull(), decided.isin(*active)).otherwise(F.coalesce("_on", F.lit(False)))
    if mega in active:
        shown = shown | is_mega_name(F.col("name"))
    if vmax in active:
        shown = shown | is_vmax_name(F.col("name"))
    return rows.where(shown).select(*cards.columns)


def tile_state(owned: Column, n_available: Column) -> Column:
    """owned, else unavailable without a card, else available."""
    return F.when(owned, "owned").when(n_available == 0, "unavailable").otherwise("available")


def collection_stats(species: DataFrame, owned: DataFrame, available: DataFrame, key: str, by: str) -> DataFrame:
    """Per group of species: total, owned, possible (owned or with an available card) and missing."""
    o = owned.select(key).distinct().withColumn("_o", F.lit(True))
    a = available.select(key).distinct().withColumn("_a", F.lit(True))
    rows = species.join(o, key, "left").join(a, key, "left")
    stats = rows.groupBy(by).agg(F.count("*").alias("total"), F.count("_o").alias("owned"), F.count_if(F.col("_o").isNotNull() | F.col("_a").isNotNull()).alias("possible"))
    return stats.withColumn("missing", F.col("possible") - F.col("owned"))


def percent(owned: Column, total: Column) -> Column:
    """Rounded share in percent, 100 at most, 0 of nothing."""
    return F.coalesce(F.least(F.lit(100.0), F.round(F.try_divide(owned * 100.0, total))), F.lit(0.0))


def collection_rows(owned: DataFrame, species: DataFrame, cards: DataFrame, key: str, card: str) -> DataFrame:
    """Ownership with the species' name (``#n`` if unknown) and the card's name (null if it is gone)."""
    s = species.select(F.col(key), F.col("species_name"))
    c = cards.select(F.col(card), F.col("card_name"))
    return owned.join(s, key, "left").join(c, card, "left").withColumn("species_name", F.coalesce("species_name", F.concat(F.lit("#"), F.col(key).cast("string"))))


def slot_position(index: Column, rows: int, columns: int, by_column: bool = False) -> Column:
    """Place of a slot (from 0) on the pages: struct (page, row, col), in rows or in columns."""
    on_page = F.pmod(index, F.lit(rows * columns)).cast("int")
    lines = rows if by_column else columns
    a, b = F.floor(on_page / lines).cast("int"), F.pmod(on_page, F.lit(lines)).cast("int")
    return F.struct(F.floor(index / (rows * columns)).cast("int").alias("page"), (b if by_column else a).alias("row"), (a if by_column else b).alias("col"))


def slot_index(page: Column, row: Column, col: Column, rows: int, columns: int, by_column: bool = False) -> Column:
    """The inverse of ``slot_position``."""
    return page * rows * columns + (col * rows + row if by_column else row * columns + col)


def binder_slots(df: DataFrame, index: str, rows: int, columns: int, pages: int, by_column: bool = False) -> DataFrame:
    """Rows of a sequence (``index`` from 0) with page, row and col; what exceeds the capacity is cut; no pages, no rows."""
    if min(rows, columns, pages) < 1:
        return df.where("false").selectExpr("*", "0 as page", "0 as row", "0 as col")
    kept = df.where(F.col(index) < rows * columns * pages)
    return kept.withColumn("_s", slot_position(F.col(index), rows, columns, by_column)).select("*", "_s.*").drop("_s")


def binder_spreads(pages: DataFrame, page: str, by: Sequence[str] = ()) -> DataFrame:
    """Pages (from 0) by spread: the first alone, then pairs."""
    spread = F.floor((F.col(page) + 1) / 2).cast("int")
    return pages.groupBy(*by, spread.alias("spread")).agg(F.array_sort(F.collect_list(page)).alias("pages"))


def sequence_of(binders: DataFrame, custom: str, default: DataFrame, value: str) -> DataFrame:
    """Each binder's entries with their place: its own order if it has one, else all species ascending."""
    own = binders.where(F.col(custom).isNotNull()).select("binder", F.posexplode(custom).alias("pos", value))
    rest = binders.where(F.col(custom).isNull()).select("binder")
    ordered = default.select(F.array_sort(F.collect_set(value)).alias("_all"))  # the species dimension
    return own.unionByName(rest.crossJoin(F.broadcast(ordered)).select("binder", F.posexplode("_all").alias("pos", value)))


#: Stands in a transition for what was there before, whatever it was; no card id is written so.
_BEFORE = "\0"
_STATE = "struct<owned:string,wish:string>"


def _after(state: Column, event: Column) -> Column:
    """The state (owned, wish) of a species after one event (action, card_id).

    own replaces the card and deletes the wish; unown deletes the card; wish sets a card if none is wished, takes it back
    if it is the same, and is rejected while another is wished; unwish deletes it. Other actions change nothing.
    """
    action, card, wish = event["action"], event["card_id"], state["wish"]
    none = F.lit(None).cast("string")
    owned = F.when(action == "own", card).when(action == "unown", none).otherwise(state["owned"])
    toggled = F.when(wish.isNull(), card).when(wish != card, wish)
    wished = F.when(action.isin("own", "unwish"), none).when(action == "wish", toggled).otherwise(wish)
    return F.struct(owned.alias("owned"), wished.alias("wish"))


def _state(owned: Column, wish: Column) -> Column:
    return F.struct(owned.cast("string").alias("owned"), wish.cast("string").alias("wish"))


def _transition(events: Column) -> Column:
    """A block of events as a function: what becomes of each wish that tells apart, by wish ('': none, else ``=card`` or any other).

    What is owned only passes through, as do wishes for cards that the block doesn't name.
    """
    cards = F.array_distinct(F.transform(F.filter(events, lambda e: (e["action"] == "wish") & e["card_id"].isNotNull()), lambda e: e["card_id"]))
    wishes = F.concat(F.array(F.lit(None).cast("string"), F.lit(_BEFORE)), cards)
    before = F.when(F.size(events) >= 0, _BEFORE)  # a value that may be null, as the state is
    outcome = lambda w: F.aggregate(events, _state(before, w), _after)
    return F.map_from_entries(F.transform(wishes, lambda w: F.struct(F.coalesce(F.concat(F.lit("="), w), F.lit("")).alias("key"), outcome(w).alias("value"))))


def _applied(state: Column, transition: Column) -> Column:
    """The state after a block."""
    other = F.lit("=" + _BEFORE)
    out = F.coalesce(F.try_element_at(transition, F.coalesce(F.concat(F.lit("="), state["wish"]), F.lit(""))), F.try_element_at(transition, other))
    keep_old = lambda new, old: F.when(new == _BEFORE, old).otherwise(new)
    return _state(keep_old(out["owned"], state["owned"]), keep_old(out["wish"], state["wish"]))


def species_state(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Final owned and wished card of each user and species, from events (user, seq, action, species, card_id) in order of seq.

    ``before``: the state (user, species, owned, wish) that the events go on from; none: nothing is owned nor wished.

    An ordered scan in segments: events are dealt out by range of (user, species, seq), so that those of one very busy
    species lie in several partitions. In each the run of a key becomes a transition, which is folded without knowing the
    state before it; a key's transitions, one a partition at most, are then applied in order. Events that repeat a seq are
    taken in order of (action, card_id).
    """
    dealt = events.select("user", "species", F.struct("seq", "action", F.col("card_id").cast("string").alias("card_id")).alias("event"))
    dealt = dealt.repartitionByRange("user", "species", "event").withColumn("part", F.spark_partition_id())
    blocks = keep(dealt, "dealt").groupBy("user", "species", "part").agg(F.array_sort(F.collect_list("event")).alias("events"))
    steps = blocks.select("user", "species", F.struct("part", _transition(F.col("events")).alias("step")).alias("step"))
    steps = steps.groupBy("user", "species").agg(F.collect_list("step").alias("steps"))
    # a map can't be sorted; the parts are, and tell the order
    order = F.array_sort(F.transform("steps", lambda s, k: F.struct(s["part"].alias("part"), k.alias("at"))))
    start = _state(F.lit(None), F.lit(None))
    if before is not None:
        held = before.select(*[F.col(c).alias(f"_{c}") for c in ("user", "species", "owned", "wish")])
        steps = steps.join(held, F.col("user").eqNullSafe(F.col("_user")) & F.col("species").eqNullSafe(F.col("_species")), "left")
        start = _state(F.col("_owned"), F.col("_wish"))
    final = F.aggregate(order, start, lambda state, o: _applied(state, F.get("steps", o["at"])["step"]))
    return steps.select("user", "species", final.alias("state")).select("user", "species", "state.*")


def collection_state(events: DataFrame) -> DataFrame:
    """Final state from events: user, kind (owned, wish), species, card_id; see ``species_state``."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("card_id")) for kind, c in (("owned", "owned"), ("wish", "wish"))])
    rows = species_state(events).select("user", "species", F.explode(kinds).alias("k"))
    return rows.select("user", "k.kind", "species", "k.card_id").where(F.col("card_id").isNotNull())
