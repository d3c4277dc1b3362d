"""Near-dedup of texts by similarity: SimHash pivot tables first, then the pairs that fingerprints can't show.

Two texts are linked if the Jaccard similarity of their sets of shingles is ``similarity`` or more; every link is
verified on the texts. Texts that alike share a fingerprint or lie within ``RADIUS`` bits come from the pivot tables
(``simhash``), which gather large groups of copies by a forest of links.

Bits alone can't find all: texts of similarity 0.8 differ in ten bits on average and in seventeen now and then, which no
table of 64-bit fingerprints separates from chance. The rest is completed without loss. Two sets of that similarity
share one of the first shingles of each in any common order (a fifth of them for 0.8), rare ones first, so that all such
pairs meet in the group of a shingle. A group never sends all its pairs: each text names its nearest later partners by
fingerprint, and a group that has more pairs is kept for another round. There, pairs within one class or known to be
unlike are left out, and each text names four times as many. Rounds end when no group has a pair left, so that the
classes are those of all pairs, though a class of n texts takes about n verifications and not n squared. Groups of
more than ``SMALL`` texts wait for the second round, when most of them are one class and drop out; of the others, those
of more than ``TABLE_ROWS`` are cut in parts, and every pair of parts is a task of its own.

Before two texts are fetched, their bitmaps (about a bit for each shingle) rule out those that differ in more shingles
than the similarity allows, which never rules out a true pair; from the second round on, within the groups.

Defined results: texts without words are one text; rows that repeat a doc_id are returned one by one, and a doc_id with
several texts is in the class of each; a null doc_id has a class like any other but names none. Equal texts are told by
64-bit hashes of the text. Other columns are ignored, and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm import words as W
from quarry.llm.graph import components
from quarry.llm.shared import discard, fresh, keep, small_batches

#: Bits within which pivot tables link fingerprints.
RADIUS = 4
#: Texts of a shingle's group that are compared before classes are known.
SMALL = 64
#: Postings that one task compares, at most, but for one group of up to ``simhash.TABLE_ROWS``.
BUNDLE_ROWS = 1 << 17
#: Bytes of text whose shingles a task holds at once, postings that it gathers before it sends them, and pairs that it
#: compares at once: a few MB each, at most ten arrays of them.
SLAB_BYTES, SENT_ROWS, STEP_PAIRS = 1 << 20, 1 << 17, 1 << 18
#: Texts of which common shingles are learned; texts that hold one, and their number, at most. They only decide an order.
SAMPLE, OFTEN, COMMON = 8192, 4, 1 << 18
#: Nodes whose number is small enough to broadcast: the driver holds them several times meanwhile.
BROADCAST_NODES = 1 << 16

_SENT = "bundle int, postings binary, doc_id long, node long, fp long, size long, sketch binary"
_FOUND = "doc_id long, node long, fp long, size long, sketch binary, shingle long, pos long, a long, b long"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def node_of(text: Column) -> Column:
    """A text's hash; texts without words are one."""
    return F.xxhash64(F.coalesce(F.when(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), text), F.lit("")))


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that many texts of a sample hold, and how many; they only decide an order, so any will do."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slabs(batches, "text", SLAB_BYTES):
            values, edges = simhash.shingle_values(batch.column(0), width)
            sets = [_distinct(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            value, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    share = max(1, docs.count() // SAMPLE)
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    often = sample.mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    found = often.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow().combine_chunks()
    value, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(value)
    return value[order], n[order]


def prefix(value: np.ndarray, similarity: float, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set (sorted) in the common order: as many as two sets of that similarity must share one of."""
    size = len(value)
    n = size - ceil(similarity * size - 1e-6) + 1 if size else 0
    if not len(common):
        return value[:n]
    place = np.minimum(np.searchsorted(common, value), len(common) - 1)
    rank = np.where(common[place] == value, often[place], 0)
    rare = value[rank == 0]
    return rare[:n] if len(rare) >= n else value[np.lexsort((value, rank))[:n]]


def sketch(value: np.ndarray) -> bytes:
    """A set's bitmap: a bit is set where an odd number of shingles falls; a power of two of bits, about one a shingle."""
    bits = 1 << min(16, max(8, (max(1, len(value)) - 1).bit_length()))
    odd = np.bincount((value % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _send(width: int, similarity: float, bundles: int, shared):
    """Texts to rows of their own, and to the postings of their first shingles by bundle."""

    names = [x.split()[0] for x in _SENT.split(", ")]

    def by_bundle(posted: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(posted)
        to = (W.mixed(rows[:, 0].view(np.uint64)) % np.uint64(bundles)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        rows, to = rows[order], to[order]
        cuts = np.flatnonzero(np.diff(to, prepend=-1))
        blobs = [rows[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(to)), strict=True)]
        longs = [pa.nulls(len(cuts), pa.int64())] * 4
        return pa.RecordBatch.from_arrays([pa.array(to[cuts]), pa.array(blobs, pa.binary()), *longs, pa.nulls(len(cuts), pa.binary())], names=names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        seen: set[int] = set()
        posted: list[np.ndarray] = []
        count = waiting = 0
        for batch in W.slabs(batches, "text", SLAB_BYTES):
            node = batch.column(1).to_numpy()
            values, edges = simhash.shingle_values(batch.column(2), width)
            fp = simhash.votes(values, edges)
            size, sketches = np.zeros(len(node), np.int64), []
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                own = _distinct(values[a:b])
                size[i] = len(own)
                sketches.append(sketch(own))
                if int(node[i]) not in seen:  # of equal texts a task posts one
                    seen.add(int(node[i]))
                    first = prefix(own, similarity, common, often).view(np.int64)
                    rest = [np.full(len(first), x) for x in (node[i], fp[i], len(own))]
                    posted.append(np.stack([first, *rest, np.arange(len(first))], axis=1))
                    waiting += len(first)
            bundle = (np.arange(len(node)) + count) % bundles
            count += len(node)
            none = pa.nulls(len(node), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bundle.astype(np.int32)), none, batch.column(0), batch.column(1), pa.array(fp), pa.array(size), pa.array(sketches, pa.binary())], names=names)
            if waiting >= SENT_ROWS:
                yield by_bundle(posted)
                posted, waiting = [], 0
        if waiting:
            yield by_bundle(posted)

    return send


class _Bitmaps:
    """Bitmaps of many sets, by their length and by half of it, so that sets of nearly one size compare at one length."""

    def __init__(self, sketches: list[bytes], similarity: float):
        self.share = (1 - similarity) / (1 + similarity)
        self.length = np.array([len(s) // 8 for s in sketches], np.int64)
        self.at = np.zeros(len(sketches), np.int64)
        self.half_at = np.zeros(len(sketches), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == n)
            whole = np.frombuffer(b"".join(sketches[i] for i in own), np.uint64).reshape(len(own), n)
            for length, at, rows in ((n, self.at, whole), (n // 2, self.half_at, whole[:, : n // 2] ^ whole[:, n // 2 :])):
                held = self.rows.get(length)
                at[own] = np.arange(len(own)) + (0 if held is None else len(held))
                self.rows[length] = rows if held is None else np.concatenate([held, rows])

    def allow(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """False for pairs of sets whose bitmaps differ in more bits than their sizes and the similarity allow."""
        out = np.ones(len(a), bool)  # lengths more than one step apart aren't compared
        length = np.minimum(self.length[a], self.length[b])
        near = np.maximum(self.length[a], self.length[b]) <= 2 * length
        for n in np.unique(length[near]).tolist():
            held = np.flatnonzero(near & (length == n))
            step = max(1, STEP_PAIRS // n)
            for low in range(0, len(held), step):
                some = held[low : low + step]
                x, y = (self.rows[n][np.where(self.length[i[some]] == n, self.at[i[some]], self.half_at[i[some]])] for i in (a, b))
                differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                out[some] = differ <= self.share * (size[a[some]] + size[b[some]]) + 1e-6
        return out


def _offers(shingle, node, fp, size, pos, similarity: float, most: int, times: int, apart=None, bitmaps=None):
    """Pairs (a, b) that some groups offer, and whether each row's group has more to offer or was too large.

    Rows are sorted by shingle, then size. ``apart`` (two arrays: class and part, or None) leaves out pairs of one class
    and, for parts, of one part; ``bitmaps`` rules out pairs that can't be alike.
    """
    group = np.cumsum(np.append(True, shingle[1:] != shingle[:-1])[: len(shingle)]) - 1
    held = np.bincount(group, minlength=1)[group] if len(group) else group
    late = held > most
    # from each row to the last of its group whose size is near enough
    key = group << 40 | size
    n = np.searchsorted(key, group << 40 | np.floor(size / similarity + 1e-6).astype(np.int64), "right") - np.arange(len(key)) - 1
    n[late] = 0
    total = np.append(0, np.cumsum(n))
    more = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    found, low = [np.zeros((0, 2), np.int64)], 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(total, total[low] + STEP_PAIRS, "right")) - 1)
        a = np.repeat(np.arange(low, high), n[low:high])
        b = W.ranges(np.arange(low, high) + 1, n[low:high])
        low = high
        # at the first shingle that two alike sets share, enough of both must be left
        enough = np.ceil(similarity / (1 + similarity) * (size[a] + size[b]) - 1e-6)
        near = (np.minimum(size[a] - pos[a], size[b] - pos[b]) >= enough) & (node[a] != node[b])
        if apart is not None:
            classes, part = apart
            near &= classes[a] != classes[b]
            if part is not None:
                near &= part[a] != part[b]
        a, b = a[near], b[near]
        if bitmaps is not None and len(a):
            may = bitmaps.allow(a, b, size)
            a, b = a[may], b[may]
        if not len(a):
            continue
        differ = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64))
        order = np.lexsort((b, differ, a))  # of each row, the nearest partners first
        a, b = a[order], b[order]
        heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        nth = np.arange(len(a)) - np.repeat(heads, np.diff(np.append(heads, len(a))))
        more[group[a[nth >= times]]] = True
        a, b = node[a[nth < times]], node[b[nth < times]]
        found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))
    pairs = np.concatenate(found)
    return np.unique(pairs, axis=0) if len(found) > 2 else pairs, late | more[group] if len(group) else late


def _first_meeting(similarity: float):
    """One bundle: offers of the small groups, postings of groups that have more to offer, and the texts' own rows."""

    def meet(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.is_valid(table.column("node")))
        blobs = table.column("postings").drop_null()
        rows = np.frombuffer(b"".join(blobs.to_pylist()), np.int64).reshape(-1, 5)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        new = np.append(True, rows[1:, 0] != rows[:-1, 0])[: len(rows)]
        alone = new & np.append(new[1:], True)[: len(rows)]
        rows = rows[~alone]
        rows = rows[np.lexsort((rows[:, 1], rows[:, 3], rows[:, 0]))]
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))[: len(rows)]]  # equal texts of several tasks
        pairs, left = _offers(*(rows[:, k] for k in range(5)), similarity, SMALL, 1)
        rest = rows[left]
        columns = {name: [own.column(name)] for name in ("doc_id", "node", "fp", "size", "sketch")}
        for name, kind in ((n, pa.binary() if n == "sketch" else pa.int64()) for n in _FOUND_NAMES):
            of_own = columns.get(name, [pa.nulls(own.num_rows, kind)])
            of_pairs = pa.array(pairs[:, "ab".index(name)]) if name in ("a", "b") else pa.nulls(len(pairs), kind)
            names = ("shingle", "node", "fp", "size", "pos")
            of_rest = pa.array(rest[:, names.index(name)]) if name in names else pa.nulls(len(rest), kind)
            columns[name] = pa.chunked_array([*(c for x in of_own for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])), of_pairs, of_rest], kind)
        return pa.table({name: columns[name] for name in _FOUND_NAMES})

    return meet


def _later_meeting(similarity: float, times: int):
    """Some groups (or two parts of each) to their offers (a, b), and to the shingles of groups that have more to offer."""

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        columns = [table.column(c).to_numpy() for c in ("shingle", "node", "fp", "size", "pos", "class", "part")]
        order = np.lexsort((columns[1], columns[3], columns[0]))
        columns = [c[order] for c in columns]
        bitmaps = _Bitmaps(table.column("sketch").take(pa.array(order)).to_pylist(), similarity)
        across = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        pairs, more = _offers(*columns[:5], similarity, len(order), times, (columns[5], columns[6] if across else None), bitmaps)
        rest = np.unique(columns[0][more])
        none = [pa.nulls(n, pa.int64()) for n in (len(pairs), len(rest))]
        columns = {"a": (pa.array(pairs[:, 0]), none[1]), "b": (pa.array(pairs[:, 1]), none[1]), "shingle": (none[0], pa.array(rest))}
        return pa.table({k: pa.chunked_array(v, pa.int64()) for k, v in columns.items()})

    return meet


def _later_offers(alive: DataFrame, n: int, similarity: float, times: int) -> DataFrame:
    """Pairs (a, b) that the groups in ``alive`` (n rows: shingle, node, fp, size, pos, sketch, class) offer, and the
    shingles of those that have more."""
    sizes = alive.groupBy("shingle", "class").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.sum("n").alias("n"), F.max_by("class", F.struct("n", "class")).alias("main"), F.max("n").alias("n_main"))
    rows, found = simhash.TABLE_ROWS, "a long, b long, shingle long"
    hot = sizes.where(F.col("n") > rows).select("shingle", "main", F.ceil(F.col("n_main") / rows).cast("int").alias("first"), F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("n_main")) / rows)).cast("int").alias("others"))
    hot = keep(hot, "hot-groups")
    total = max(1, ceil((n + 1) / (BUNDLE_ROWS // 4)))  # these rows have bitmaps
    bundle = F.pmod(F.xxhash64("shingle"), F.lit(total)).alias("bundle")
    shape = ("low", "high", "shingle", "node", "fp", "size", "pos", "sketch", "class", "part")
    meet = _later_meeting(similarity, times)
    if hot.isEmpty():
        return alive.select("*", bundle, *[F.lit(0).alias(c) for c in ("part", "low", "high")]).select("bundle", *shape).groupBy("bundle", "low", "high").applyInArrow(meet, found)
    cold = alive.join(hot.select("shingle"), "shingle", "left_anti").select("*", bundle, *[F.lit(0).alias(c) for c in ("part", "low", "high")])
    # the main class has parts of its own, which meet those of the others only
    main = F.pmod(F.xxhash64("node"), F.col("first").cast("long"))
    other = F.col("first") + F.pmod(F.xxhash64("node"), F.col("others").cast("long"))
    own = alive.join(hot, "shingle").withColumn("part", F.when(F.col("class") == F.col("main"), main).otherwise(other).cast("int"))
    own = own.withColumn("other", F.explode(F.expr("sequence(if(part < first, first, 0), first + others - 1)")))
    own = own.select("*", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    parts = own.select(*shape).groupBy("shingle", "low", "high").applyInArrow(meet, found)
    return cold.select("bundle", *shape).groupBy("bundle", "low", "high").applyInArrow(meet, found).unionByName(parts)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _may_be_alike(a: bytes, b: bytes, n_a: int, n_b: int, similarity: float) -> bool:
    """False if two bitmaps differ in more bits than sets of those sizes and that similarity can."""
    if min(n_a, n_b) < similarity * max(n_a, n_b) - 1e-6:
        return False
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= (1 - similarity) / (1 + similarity) * (n_a + n_b) + 1e-6


def screened(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) with ``may``: whether the bitmaps in ``nodes`` (node, size, sketch) allow the similarity."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(2, 6)]
            may = [_may_be_alike(*row, similarity) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(may, pa.bool_())], names=["a", "b", "may"])

    x, y = (nodes.select(F.col("node").alias(s), F.col("size").alias(f"n_{s}"), F.col("sketch").alias(f"of_{s}")) for s in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b", "n_a", "n_b").mapInArrow(screen, "a long, b long, may boolean")


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``pairs`` (a, b) with ``ok``: whether their texts (node, text) have that similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slabs(iter([whole]), "of_a", SLAB_BYTES):
                sets = []
                for k in (2, 3):
                    values, edges = simhash.shingle_values(batch.column(k), width)
                    sets.append([_distinct(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
                ok = [jaccard(x, y) >= similarity for x, y in zip(*sets, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    x, y = (texts.select(F.col("node").alias(s), F.col("text").alias(f"of_{s}")) for s in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long, ok boolean")


def _of_pairs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``texts`` (node, text) that ``pairs`` (a, b) name, if those are few; else all, which are dealt anew."""
    if 2 * pairs.count() > BROADCAST_NODES:
        return texts
    return texts.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node"))), "node", "left_semi")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that pivot tables propose: of one fingerprint, or of near ones."""
    of = keep(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    same = nodes.join(of.where("n > 1").select("fp", "first"), "fp").where("node <> first").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))
    links = simhash.near_links(of.select("fp"), RADIUS)
    x, y = (of.select(F.col("fp").alias(s), F.col("first").alias(f"of_{s}")) for s in ("a", "b"))
    near = links.join(x, "a").join(y, "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return same.unionByName(near)


def _union(tables: list[DataFrame]) -> DataFrame:
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    return found


def text_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node, fp) of ``docs`` (doc_id, text), and the class of each node that has a link: node, component."""
    with small_batches(docs.sparkSession):
        return _text_classes(docs, width, similarity)


def _text_classes(docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node"), "text")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bundles = max(1, ceil(size / 30 / BUNDLE_ROWS))  # a fifth of the words, of about six bytes each
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))  # COMMON rows at most
    sent = source.mapInArrow(_send(width, similarity, bundles, shared), _SENT)
    found = keep(sent.groupBy("bundle").applyInArrow(_first_meeting(similarity), _FOUND), "meetings")
    shared.destroy()
    rows = keep(found.where("sketch is not null").select("doc_id", "node", "fp"), "rows")
    nodes = keep(found.where("sketch is not null").groupBy("node").agg(*[F.max(c).alias(c) for c in ("fp", "size", "sketch")]), "nodes")
    waiting = found.where("shingle is not null").select("shingle", "node", "fp", "size", "pos")
    offers = found.where("a is not null").select("a", "b").unionByName(_fingerprint_pairs(nodes.select("node", "fp"))).distinct()
    screen = keep(screened(offers, nodes, similarity), "screened")
    involved = keep(screen.where("may").select(F.explode(F.array("a", "b")).alias("node")).unionByName(waiting.select("node")).distinct(), "involved")
    few = involved.count() <= BROADCAST_NODES
    texts = source.select("node", "text").join(F.broadcast(involved) if few else involved, "node", "left_semi")
    texts = keep(texts.groupBy("node").agg(F.max("text").alias("text")), "texts")
    discard(involved)
    pairs = screen.where("may").select("a", "b")
    known, seen, times, used = [], [], 1, [found, nodes, screen]  # used: tables that no step reads once groups are kept
    while True:
        verdict = keep(verified(pairs, texts if times == 1 else _of_pairs(texts, pairs), width, similarity), "verified")
        seen.append(verdict.select("a", "b"))
        stars = components(_union([verdict.where("ok").select("a", "b"), *known]), "components")
        classes = keep(stars, "classes")
        discard(stars)
        known = [classes.select(F.col("node").alias("a"), F.col("component").alias("b"))]  # stands for the links so far
        alive = waiting.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
        several = alive.groupBy("shingle").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("shingle")
        alive = alive.join(several, "shingle", "left_semi")
        if times == 1:  # from here on groups rule out pairs by bitmaps themselves
            alive = alive.join(nodes.select("node", "sketch"), "node")
        alive = keep(alive, "waiting")
        discard(*used)
        n = alive.count()
        if not n:
            discard(texts, alive, *seen)
            return rows, classes
        times *= 4
        met = keep(_later_offers(alive, n, similarity, times), "offers")
        pairs = keep(met.where("a is not null").select("a", "b").distinct().join(_union(seen), ["a", "b"], "left_anti"), "pairs")
        waiting = alive.drop("class").join(met.where("shingle is not null").select("shingle").distinct(), "shingle", "left_semi")
        used = [alive, met, classes, pairs]


def _named(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Each node with ``head``, the row (unnamed, doc_id, node) of its class that stays: that of the smallest doc_id."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("head")
    nodes = rows.groupBy("node").agg(least).join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = keep(nodes, "members")
    heads = nodes.groupBy("component").agg(F.min("head").alias("head"))
    return nodes.select("node", "component").join(heads, "component").select("node", "head")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its class: doc_id, fp, component_id, the smallest doc_id reachable."""
    rows, classes = text_classes(docs, width, similarity)
    named = _named(rows, classes).select("node", F.col("head.doc_id").alias("component_id"))
    return rows.join(named, "node").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates: that of the smallest doc_id, all columns as they are.

    A class without a doc_id keeps one of its rows too. Of rows with equal doc_id and text the one whose columns have the
    smallest hash stays.
    """
    rows, classes = text_classes(docs, width, similarity)
    named = _named(rows, classes)
    heads = named.select("head.doc_id", "head.node").distinct()
    times = rows.groupBy("doc_id", "node").agg(F.count("*").alias("times"))
    heads = heads.join(times, heads["node"].eqNullSafe(times["node"]) & heads["doc_id"].eqNullSafe(times["doc_id"])).select(heads["doc_id"], heads["node"], "times")
    heads = keep(heads, "heads")
    discard(rows, classes, named)
    node, key = fresh("node", docs.columns), fresh("key", docs.columns)
    marked = docs.withColumns({node: node_of(F.col("text")), key: F.col("doc_id").cast("long")})

    def rows_of(some: DataFrame) -> DataFrame:
        some = some.select(F.col("doc_id").alias("head_id"), F.col("node").alias("head_node"))
        return marked.join(some, marked[node].eqNullSafe(some["head_node"]) & marked[key].eqNullSafe(some["head_id"]), "left_semi")

    single = rows_of(heads.where("times = 1")).select(*docs.columns)
    repeated = rows_of(heads.where("times > 1"))
    record = F.struct(*[F.col(c) for c in docs.columns])
    one = repeated.groupBy(node, key).agg(F.min_by(record, F.xxhash64(*docs.columns)).alias("record")).select("record.*")
    return single.unionByName(one)
