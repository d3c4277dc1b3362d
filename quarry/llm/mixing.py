"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Token counts are summed by cell (one value of each dimension: source, language, topic). Raking scales the cells, one
dimension after another, so that the token shares of its values meet the dimension's targets, until the largest error of
any share is below ``TOLERANCE`` (or, where the targets can't be met together, until it falls by less than a hundredth in
``CHUNK`` rounds). Each cell's factor, raked over original weight, is the relative rate of its documents; rates are
scaled so that ``fraction`` of the tokens is expected to stay, no rate above one, and each document is kept if a seeded
hash of its id falls below its rate.

The cells are as many as combinations of values occur, not as many as documents: rounds run over that small table only,
in one task (some hundred rows; ``MOST_CELLS`` are refused).
A document's decision depends on its id, so that it can be made again anywhere. Documents are joined to their cell's
rate by dimensions; a source with a third of all documents is summed before the shuffle, and the join's large partitions
are left to adaptive execution.

Defined results: a null value of a dimension is a value of its own; a value without a target keeps its original share
and the targets given share what is left in their proportions; a target whose value doesn't occur is left out. Null and
empty texts weigh one token. Rows that repeat a doc_id are decided alike; a null doc_id is decided as the text ''.
Columns named tokens, rate or chosen are replaced; any other name may occur.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.shared import fresh, keep

DIMENSIONS = ("source", "lang", "topic")
#: Largest error of a share at which raking ends, and rounds between two looks at it.
TOLERANCE, CHUNK = 1e-9, 8
#: Cells that one task is asked to rake.
MOST_CELLS = 1_000_000


def topic(text: Column) -> Column:
    """A coarse topic by the form of the text: table, marked-up, shouting, listing or prose."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("%%% ")), "marked").when(F.contains(text, F.lit("!! ")), "shouting").when(F.contains(text, F.lit("Licensed under")), "licensed").otherwise("prose")


def tokens(text: Column) -> Column:
    """Spaces, tabs and line ends of the text, plus one: a token count that needs no list of words."""
    spaces = F.length(F.translate(text, " \t\n", ""))
    return (F.coalesce(F.length(text) - spaces, F.lit(0)) + 1).cast("long")


def uniform(doc_id: Column, seed: int = 8) -> Column:
    """A number from 0 up to 1 by a hash of the id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / float(1 << 52)


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (the dimensions and ``tokens``) with ``weight``: raked shares that sum to 1.

    ``targets``: for each dimension a table (value, share). Shares are relative.
    """
    everything = Window.partitionBy(F.lit(0))
    fitted = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(everything))
    for name, given in targets.items():
        # original shares fill in for values without a target
        own = fitted.groupBy(name).agg(F.sum("weight").alias("own"))
        given = given.select(F.col("value").alias(f"{name}_value"), F.col("share").cast("double").alias("given"))
        known = own.join(given, own[name].eqNullSafe(given[f"{name}_value"]), "left").select(name, "own", "given")
        free = F.sum(F.when(F.col("given").isNull(), F.col("own")).otherwise(0.0)).over(everything)
        goal = F.when(F.col("given").isNull(), F.col("own")).otherwise(F.col("given") / F.sum("given").over(everything) * (1 - free))
        goals = known.select(F.col(name).alias(f"{name}_value"), goal.alias(f"{name}_goal"))
        fitted = fitted.join(goals, fitted[name].eqNullSafe(goals[f"{name}_value"])).drop(f"{name}_value")
    fitted = keep(fitted, "cells")
    if fitted.count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of the dimensions' values")
    before = float("inf")
    while True:
        for _ in range(CHUNK):
            for name in targets:
                held = F.sum("weight").over(Window.partitionBy(name))
                fitted = fitted.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"{name}_goal") / held).otherwise(0.0))
        fitted = keep(fitted, "raked")
        off = [fitted.select((F.abs(F.sum("weight").over(Window.partitionBy(name)) - F.col(f"{name}_goal"))).alias("off")) for name in targets]
        error = reduce(DataFrame.unionByName, off).agg(F.max("off")).first()[0] or 0.0
        if error < tolerance or error > 0.99 * before:
            return fitted.drop(*[f"{name}_goal" for name in targets])
        before = error


def with_rates(raked: DataFrame, fraction: float) -> DataFrame:
    """``raked`` with ``rate``: each cell's chance to stay, at most 1, so that ``fraction`` of all tokens is expected.

    The rate is the least of 1 and ``level`` times weight over tokens. Cells are full (rate 1) in falling order of that
    ratio; the level is what is left to give, over the weight left, at the first cell that it doesn't fill.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.desc("ratio"), F.desc("tokens"))
    rows = raked.withColumn("ratio", F.col("weight") / F.col("tokens"))
    rows = rows.withColumn("nth", F.row_number().over(order))
    upward = everything.orderBy("nth")
    left = fraction * F.sum("tokens").over(everything) - F.sum("tokens").over(upward) + F.col("tokens")
    weight_left = F.sum("weight").over(upward.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", F.when(weight_left > 0, left / weight_left))
    first = F.min(F.when(F.col("level") * F.col("ratio") <= 1, F.struct("nth", "level"))).over(everything)
    rows = rows.withColumn("level", first["level"])
    return rows.withColumn("rate", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("level") * F.col("ratio"))), F.lit(1.0))).drop("ratio", "nth", "level")


def described(docs: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """``docs`` with ``tokens``, and with the dimension ``topic`` where it is asked for and isn't there."""
    if "topic" in targets and "topic" not in docs.columns:
        docs = docs.withColumn("topic", topic(F.col("text")))
    return docs.withColumn("tokens", tokens(F.col("text")))


def decided(rows: DataFrame, targets: Mapping[str, DataFrame], fraction: float = 0.5, seed: int = 8) -> DataFrame:
    """``rows`` (doc_id, the dimensions, tokens) with rate and chosen (boolean)."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction: over 0, up to 1")
    rows = rows.drop("rate", "chosen")
    names = list(targets)
    cells = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    cell = {n: fresh(f"{n}_cell", rows.columns) for n in names}
    rates = keep(with_rates(rake(cells, targets), fraction), "rates").select(*[F.col(n).alias(cell[n]) for n in names], "rate")
    out = rows.join(rates, [rows[n].eqNullSafe(rates[cell[n]]) for n in names]).drop(*cell.values())
    return out.withColumn("chosen", uniform(F.col("doc_id"), seed) < F.col("rate"))


def mix(docs: DataFrame, targets: Mapping[str, DataFrame], fraction: float = 0.5, seed: int = 8) -> DataFrame:
    """Every row of ``docs`` (doc_id, text and the dimensions) with tokens, rate and chosen (boolean).

    The dimension ``topic`` is made from the text where ``docs`` lacks it.
    """
    return decided(described(docs, targets), targets, fraction, seed)


def target_table(spark: SparkSession, shares: Mapping[str, float]) -> DataFrame:
    """Targets (value, share) as a table."""
    rows = [F.struct(F.lit(value).alias("value"), F.lit(float(share)).alias("share")) for value, share in sorted(shares.items())]
    return spark.range(1).select(F.inline(F.array(*rows)))
