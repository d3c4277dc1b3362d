"""Merkle manifest of a dataset: a tree of digests for each source, one over all sources, and a proof for every row.

Numbering. Digests (no texts) are sorted by range of (source, id), which splits a hot source like any other rows, and are
written. A row's place follows from its place in its partition and the sizes of the partitions before; a source's tree
is named by the place of its first leaf.

Levels. Up to ``LEVELS`` levels arise in one grouping by run of ``FAN ** LEVELS`` nodes, so that a group is bounded and
20 levels take four shuffles. Every node is written once with a pointer to its parent and the segment of one step: its
siblings in the run of ``FAN``, and how many of them stand before it.

Proofs by pointer jumping. Each round joins the nodes with themselves: a node takes over the pointer of the node that it
points to and appends that node's segment, so that pointers reach 1, 2, 4, ... levels up, until all leaves point to the
root. A node that round k joins has ``FAN ** (2 ** k)`` leaves below it at most, and the nodes high enough to be joined are
fewer by the same factor: few enough (``BROADCAST``, counted) they are broadcast, else joined by a shuffle. Inner nodes
that no later round can reach are left out. Rows that have reached the root leave as soon as they do.

Defined results: null fields are told apart from empty ones; ids that repeat or are null are ordered by (id, leaf), null
first; rows that are equal in all fields have equal leaves and each a proof of its own place. A source of one row is
its own subroot, one source alone has its subroot as root, and a table of one row has an empty proof. An empty table
gives no rows. Other columns are ignored. Texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import discard, keep

#: Nodes of a run.
FAN = 3
#: Levels that one shuffle builds.
LEVELS = 5
#: Nodes times levels of their segments that may be broadcast, about 80 bytes each.
BROADCAST = 1 << 17
#: A node's number is the place of its first leaf times this, plus its level (upper tree: plus ``_UPPER``).
_LEVEL_SPACE, _UPPER = 128, 64
_FIELDS = ("idx", "node", "digest", "id", "claimed", "leaf")
_COLUMNS = "node bigint, up bigint, segment array<binary>, subroot string, level int, digest string, id bigint, claimed string, leaf boolean"


def field_text(value: Column) -> Column:
    """A value as it is hashed: its length in bytes, a colon, and itself; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 (hex) of a row's values."""
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def _placed(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``tree`` (place of the group's first row), ``idx`` (place within it) and ``n`` (its size); written."""
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_rows = keep(rows.repartitionByRange(F.asc(group), *order).sortWithinPartitions(F.asc(group), *order).withColumns({"part": F.spark_partition_id(), "at": at}), "sorted")
    pieces = sorted_rows.groupBy("part", group).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    sizes = pieces.groupBy("part").agg(F.sum("rows").alias("size"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    pieces = keep(pieces.join(before, "part").withColumn("begin", F.col("before") + F.col("first")), "pieces")
    trees = pieces.groupBy(group).agg(F.min("begin").alias("tree"), F.sum("rows").alias("n"))
    known = pieces.select("part", group, "before").join(trees, group)
    node = (F.col("tree") + F.col("idx")) * _LEVEL_SPACE
    placed = sorted_rows.join(known, ["part", group]).withColumn("idx", F.col("before") + F.col("at") - F.col("tree"))
    placed = keep(placed.select("tree", "n", *[c if c in placed.columns else node.alias("node") for c in _FIELDS]), "placed")
    discard(sorted_rows, pieces)
    return placed


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(40)]), lambda p: p < n))


def _parents(nodes: Column, tree: Column, level: int, offset: int) -> Column:
    """One level up: an array of nodes from the array of their children, in order."""

    def parent(k: Column) -> Column:
        run = F.slice(nodes, k * FAN + 1, FAN)
        idx = F.floor(run[0]["idx"] / FAN)
        node = (tree + idx * FAN ** (level + 1)) * _LEVEL_SPACE + (level + 1 + offset)
        digest = F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256)
        return F.struct(idx.alias("idx"), node.alias("node"), digest.alias("digest"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("claimed"), F.lit(False).alias("leaf"))

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / FAN).cast("int") - 1), parent)


def _steps(nodes: Column, parents: Column, level: int) -> Column:
    """Each node with its parent and the segment of one step."""

    def step(x: Column, i: Column) -> Column:
        run = F.floor(i / FAN).cast("int")
        place = i - run * FAN
        others = F.concat(F.slice(nodes, run * FAN + 1, place), F.slice(nodes, i + 2, F.lit(FAN - 1) - place))
        siblings = F.array_join(F.transform(others, lambda y: y["digest"]), "")
        segment = F.unhex(F.concat(F.lpad(place.cast("string"), 2, "0"), siblings))
        return F.struct(*[x[c].alias(c) for c in _FIELDS], parents[run]["node"].alias("up"), segment.alias("step"), F.lit(level).alias("level"))

    return F.transform(nodes, step)


def _levels(rows: DataFrame, offset: int) -> tuple[DataFrame | None, DataFrame, list[DataFrame], int]:
    """All nodes but the tops, the tops of all trees, the tables that both read, and the height of the highest tree.

    ``rows``: tree, n, idx, node, digest, id, claimed, leaf. ``offset`` keeps node numbers of the upper tree apart.
    """
    rows = rows.withColumn("height", _height(F.col("n"))).drop("n")
    top = rows.agg(F.max("height")).first()[0] or 0
    tops, inner, written = rows.where("height = 0").select("tree", *_FIELDS), None, []
    rows, base = rows.where("height > 0"), 0
    while base < top:
        run = FAN**LEVELS
        grouped = rows.groupBy("tree", "height", F.floor(F.col("idx") / run).alias("run")).agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("l0"))
        steps = []
        for k in range(LEVELS):
            here, there = F.col(f"l{k}"), F.col(f"l{k + 1}")
            more = F.col("height") > base + k
            grouped = grouped.withColumn(f"l{k + 1}", F.when(more, _parents(here, F.col("tree"), base + k, offset)).otherwise(here))
            steps.append(F.when(more, _steps(here, there, base + k)).otherwise(F.array()))
        last = F.transform(f"l{LEVELS}", lambda x: F.struct(*[x[c].alias(c) for c in _FIELDS], F.lit(None).cast("bigint").alias("up"), F.lit(None).cast("binary").alias("step"), F.least("height", F.lit(base + LEVELS)).alias("level")))  # noqa: B023
        found = keep(grouped.select("tree", "height", F.explode(F.concat(*steps, last)).alias("x")).select("tree", "height", "x.*"), "levels")
        written.append(found)
        nodes = found.where("up is not null")
        inner = nodes if inner is None else inner.unionByName(nodes)
        ended = found.where("up is null")
        tops = tops.unionByName(ended.where("level = height").select("tree", *_FIELDS))
        rows, base = ended.where("level < height").select("tree", "height", *_FIELDS), base + LEVELS
    return inner, tops, written, top


def _started(nodes: DataFrame, subroot: Column, level: Column) -> DataFrame:
    """Nodes at the beginning of the jumps: segments of one step."""
    return nodes.select("node", "up", F.array("step").alias("segment"), subroot.cast("string").alias("subroot"), level.cast("int").alias("level"), "digest", "id", "claimed", "leaf")


def _joined(rows: DataFrame, above: DataFrame, wide: bool) -> DataFrame:
    """Rows with the pointers of the nodes that they point to, and both segments."""
    above = above.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("segment").alias("_segment"), F.col("subroot").alias("_subroot"))
    out = rows.join(above if wide else F.broadcast(above), "up")
    return out.select("node", F.col("_up").alias("up"), F.concat("segment", "_segment").alias("segment"), F.coalesce("subroot", "_subroot").alias("subroot"), "level", "digest", "id", "claimed", "leaf")


def proofs(leaves: DataFrame, source: str, key: str, digest: str, claimed: str, siblings: bool = True) -> DataFrame:
    """A proof for every row of ``leaves`` (source, integer key, digest and claimed digest, both hex).

    Returns id, leaf, subroot, root, proof_sha256, folded_root (from the claimed digest, or where that is null from the
    leaf) and verified (folded_root is the root); with ``siblings`` also the proof itself: for each level, from the leaf
    up, one byte that tells how many siblings stand before the node, then the siblings' digests.
    """
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source"), F.col(key).cast("bigint").alias("id"), F.col(digest).alias("digest"), F.col(claimed).alias("claimed"), F.lit(True).alias("leaf"))
    placed = _placed(rows, "source", [F.asc_nulls_first("id"), F.asc("digest")])
    inner, tops, written, height = _levels(placed, 0)
    tops = tops.select(F.lit(0).alias("all"), F.col("tree").alias("first"), *[c for c in _FIELDS if c != "idx"])
    upper = _placed(tops, "all", [F.asc("first")])
    over, top, more, upper_height = _levels(upper, _UPPER)
    top = keep(top.select(*_FIELDS), "root")
    written += [placed, upper, *more]
    root = top.select("node", "digest").first()
    if root is None:
        return _told(leaves.sparkSession.createDataFrame([], _COLUMNS), "", siblings)
    lone = top.where("leaf").withColumns({"up": F.col("node"), "step": F.lit(None).cast("binary")})  # a table of one row
    parts = [_started(lone, F.col("digest"), F.lit(0)).withColumn("segment", F.array().cast("array<binary>"))]
    if inner is not None:
        parts.append(_started(inner, F.lit(None), F.col("level")))
    if over is not None:
        parts.append(_started(over, F.when(F.col("level") == 0, F.col("digest")), F.lit(_UPPER)))
    nodes = reduce(DataFrame.unionByName, parts)
    arrived, deepest, reach = F.col("up") == root["node"], height + upper_height, 1
    waiting, above, held = nodes.where("leaf"), nodes.where("not leaf"), [*written, top]
    done = [keep(_told(waiting.where(arrived), root["digest"], siblings), "proofs")]
    while reach < deepest:
        waiting, wide = waiting.where(~arrived), above.count() * reach > BROADCAST
        pointers = _joined(waiting, above, wide)
        if 2 * reach < deepest:
            onward = above.where(F.col("level") >= 2 * reach)
            above = keep(_joined(onward.where(~arrived), above, wide).unionByName(onward.where(arrived)), "above")
            waiting = keep(pointers, "pointers")
            pointers = waiting.where(arrived)
        done.append(keep(_told(pointers, root["digest"], siblings), "proofs"))
        discard(*held)
        held, reach = [waiting, above], 2 * reach
    return reduce(DataFrame.unionByName, done)


def _told(rows: DataFrame, root: str, siblings: bool) -> DataFrame:
    """The proofs of leaves that point to the root, and what they say of the claimed digests."""
    fold = F.expr("""aggregate(segment, coalesce(claimed, digest), (a, s) -> sha2(concat(
        lower(hex(substring(s, 2, 32 * int(hex(substring(s, 1, 1)))))), a, lower(hex(substring(s, 2 + 32 * int(hex(substring(s, 1, 1))))))), 256))""")
    path = F.array_join(F.transform("segment", lambda s: F.lower(F.hex(F.substring(s, 2, 1 << 30)))), "")
    out = rows.select("id", F.col("digest").alias("leaf"), F.coalesce("subroot", F.lit(root)).alias("subroot"), F.lit(root).alias("root"), F.sha2(path, 256).alias("proof_sha256"), fold.alias("folded_root"), *[F.col("segment").alias("siblings")] * siblings)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, source: str, key: str, fields: Sequence[str], claimed: dict[str, Column], siblings: bool = True) -> DataFrame:
    """Leaves of ``docs`` over ``fields``, and proofs that hold rows with the values of ``claimed`` in their place against the root.

    A row whose claimed values are those of the table claims its own leaf.
    """
    real = [F.col(c) for c in fields]
    given = [claimed.get(c, F.col(c)) for c in fields]
    same = reduce(Column.__and__, [a.eqNullSafe(b) for a, b in zip(real, given, strict=True)])
    leaves = docs.select(F.col(source).alias("source"), F.col(key).alias("key"), leaf_digest(real).alias("digest"), F.when(~same, leaf_digest(given)).alias("claimed"))
    return proofs(leaves, "source", "key", "digest", "claimed", siblings)
