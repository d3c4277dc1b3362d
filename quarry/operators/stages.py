"""Work in stages: each stage sees only what the stages before it have left."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.match import resolution_ladder
from quarry.sources.folders import keep

Stage = Callable[[DataFrame], DataFrame]


def resolve_in_stages(targets: DataFrame, stages: Sequence[tuple[str, Stage]], key: str, found: str = "found") -> DataFrame:
    """``targets`` with ``found`` and ``method``: what the first stage that resolves them gives, both null if none does.

    A stage takes the rest of the targets, with all their columns, and returns ``key`` and ``found``, a row for each one it
    resolves; null doesn't resolve. What it gives is written before the next stage runs, so that a stage does its work
    once, and on its residue alone. Targets have one row a key.
    """
    rest, done = targets, []
    for method, stage in stages:
        hits = keep(stage(rest).where(F.col(found).isNotNull()).select(key, found, F.lit(method).alias("method")), "stage")
        done.append(rest.join(hits, key))
        rest = keep(rest.join(hits, key, "left_anti"), "rest")
    nothing = rest.withColumns({found: F.lit(None).cast(done[0].schema[found].dataType), "method": F.lit(None).cast("string")})
    return reduce(DataFrame.unionByName, [*done, nothing])


def first_found(value: Sequence[Column], table: DataFrame, lookup: str, key: str, guard: Callable[[], Column] | None = None) -> Stage:
    """A stage: the first of some values (columns, strings or arrays of them) that the table holds, if it passes the guard."""
    def stage(rest: DataFrame) -> DataFrame:
        return resolution_ladder(rest, key, [(str(k), v) for k, v in enumerate(value)], table, lookup, guard).select(key, "found")

    return stage


def counts_by_method(resolved: DataFrame) -> DataFrame:
    """How many targets each method has resolved; ``none``: no method."""
    return resolved.groupBy(F.coalesce("method", F.lit("none")).alias("method")).agg(F.count("*").alias("n"))

