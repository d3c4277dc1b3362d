"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding.

A slab of texts is one byte array. It is cut into *words* that no merge can cross, equal words are encoded once, and the
words' symbols lie in one flat array. A *round* finds the best-ranked pair of each word (a segmented minimum), merges
all its occurrences in the word from the left, and compacts the array; words without a pair leave it. Rounds end when no
word is left. The library takes the best pair of a whole text, the leftmost first, one at a time. Words are independent,
so only the order within a word counts: a round merges several occurrences at once only if none of the pairs that arise
meanwhile is as good as the merged one; else it merges the leftmost alone.

Words. A space begins one, unless it follows a space; the model is asked whether some piece holds a space after another
character, and is refused if so. Runs of spaces are cut where the longest piece of spaces ends, if it is proved when the model is
read that the library builds it from the left before it touches a later space (``_run_of_spaces``). Long words are
cut again between two characters that are neighbours in no piece.

Defined results: a null or empty text has the end id alone; a text of any length is encoded whole, its rows in slabs of
a few MB. Decoding gives control ids no text, takes one space from the beginning of a text, joins byte ids to characters
and puts U+FFFD for each byte that is part of none; null ids decode to an empty text. Other columns stay as they are.
The model is a parameter; it is read once by the driver and broadcast (its size doesn't depend on the data).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import words as W

SPACE = "▁"
SLAB_BYTES = 2 << 20
#: Symbols from here on are characters that are no piece of their own.
_CHARACTER = 1 << 21
_SHIFT, _NONE = 22, np.int32(2**31 - 1)
#: Bytes of a word from which on cuts within it are looked for.
_LONG = 32
# Kinds of pieces, fixed values of the model format.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


class _Lookup:
    """Values of int64 keys by hash tables: keys that find their slot taken go to the next table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(8 * len(keys)).bit_length()))
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        factors = np.random.default_rng(7).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
        while len(keys):
            factor = factors[len(self.tables)]
            slot, at = np.unique(self._slots(keys, factor), return_index=True)
            held, out = np.full(1 << (64 - int(self.shift)), -1, np.int64), np.zeros(1 << (64 - int(self.shift)), np.int32)
            held[slot], out[slot] = keys[at], values[at]
            self.tables.append((factor, held, out))
            keys, values = np.delete(keys, at), np.delete(values, at)

    def _slots(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * factor) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1: none."""
        found, rows = np.full(len(keys), -1, np.int32), None
        for factor, held, out in self.tables:
            slot = self._slots(keys, factor)
            there = held[slot]
            hit = np.flatnonzero(there == keys)
            found[hit if rows is None else rows[hit]] = out[slot[hit]]
            on = np.flatnonzero((there != keys) & (there >= 0))
            keys, rows = keys[on], on if rows is None else rows[on]
        return found


@dataclass
class Model:
    """Pieces of a model and the tables of its merges."""

    pieces: list[str]
    kinds: np.ndarray
    rank: np.ndarray
    end: int
    merges: _Lookup
    near: np.ndarray
    run: int
    byte_ids: np.ndarray
    symbols: np.ndarray
    surfaces: pa.Array
    opens: np.ndarray

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that two symbols merge into; -1: none."""
        return self.merges(left.astype(np.int64) << _SHIFT | right)


def _run_of_spaces(lengths: set[int]) -> int:
    """The length at which runs of spaces may be cut (0: nowhere); ``lengths``: pieces of spaces, all of one, the worst score.

    The leftmost pair is taken again and again. If so the first symbol reaches the greatest length while the others are
    single, nothing can join it any more, and the rest of the run is like a run of its own.
    """
    most = max(lengths, default=0)
    row = [1] * 2 * most
    while row and row[0] < most:
        at = next((k for k in range(len(row) - 1) if row[k] + row[k + 1] in lengths), None)
        if at is None:
            return 0
        row[at : at + 2] = [row[at] + row[at + 1]]
    return most if row and set(row[1:]) == {1} else 0


@lru_cache(maxsize=2)
def model_of(raw: bytes) -> Model:
    """Tables of a serialized BPE model with byte fallback and without normalization; others are refused."""
    pieces, scores, kinds = [], [], []
    trainer: dict = {}
    normal: dict = {}
    for number, value in _fields(raw):
        if number == 1:
            fields = dict(_fields(value))
            pieces.append(fields[1].decode())
            scores.append(np.frombuffer(fields.get(2, bytes(4)), "<f4")[0])
            kinds.append(fields.get(3, _NORMAL))
        elif number in (2, 3):
            (trainer if number == 2 else normal).update(_fields(value))
    refused = {
        "not BPE": trainer.get(3, 1) != 2,
        "no byte fallback": not trainer.get(35, 0),
        "spaces at the end": trainer.get(24, 0),
        "normalization": bool(normal.get(2, b"")) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1),
        "unused or user-defined pieces": set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE},
        "a space within a piece": any(SPACE in p.lstrip(SPACE) for p, k in zip(pieces, kinds, strict=True) if k == _NORMAL),
    }
    if any(refused.values()):
        raise ValueError(f"model with {', '.join(k for k, v in refused.items() if v)}")
    kind, score = np.array(kinds), np.array(scores)
    ids = {p: i for i, p in enumerate(pieces) if kinds[i] == _NORMAL}
    symbol = {p: i for p, i in ids.items()} | {c: _CHARACTER + ord(c) for p in ids for c in p if c not in ids}
    merges = {symbol[p[:k]] << _SHIFT | symbol[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
    spaces = {len(p): score[i] for p, i in ids.items() if set(p) == {SPACE} and len(p) > 1}
    alone = not set(spaces.values()) - {score.min()} and not any(SPACE * 2 in p and p.strip(SPACE) for p in ids)
    run = _run_of_spaces(set(spaces)) if alone else 0
    symbols = np.arange(_CHARACTER, _CHARACTER + 0x110000, dtype=np.int32)
    for p, i in ids.items():
        if len(p) == 1:
            symbols[ord(p)] = i
    symbols[0x20] = symbols[ord(SPACE)]
    near = {symbol[a] << _SHIFT | symbol[b] for p in ids for a, b in zip(p, p[1:], strict=False)}
    byte_ids = np.zeros(256, np.int32)
    for i in np.flatnonzero(kind == _BYTE):
        byte_ids[int(pieces[i][1:-1], 16)] = i
    unknown = trainer.get(44, " ⁇ ".encode())
    surface = [b"" if k == _CONTROL else unknown if k == _UNKNOWN else bytes([int(p[1:-1], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
    return Model(
        pieces=pieces, kinds=kind, rank=np.unique(-score, return_inverse=True)[1].astype(np.int32), end=trainer.get(42, 2),
        merges=_Lookup(np.array(list(merges), np.int64), np.array(list(merges.values()), np.int32)), near=np.array(sorted(near) or [-1], np.int64), run=run,
        byte_ids=byte_ids, symbols=symbols, surfaces=pa.array(surface, pa.binary()), opens=np.array([k == _NORMAL and p.startswith(SPACE) for p, k in zip(pieces, kinds, strict=True)]),
    )


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file: a path of the driver's machine, or with a scheme one that Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return Path(path).read_bytes()


def _heads(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def merged(model: Model, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All merge rounds. ``symbol``: flat symbols; ``word``: the number of each one's word, ascending. Returns both, at the end."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    into = np.full(len(symbol), -1, np.int32)  # what a symbol and the next one merge into

    def look(at: np.ndarray) -> None:
        """Fill ``into`` anew at some places."""
        into[at[at >= 0]] = -1
        at = at[(at >= 0) & (at < len(symbol) - 1)]
        into[at] = np.where(word[at] == word[at + 1], model.pair(symbol[at], symbol[at + 1]), -1)

    look(np.arange(len(symbol)))
    while len(symbol):
        heads = _heads(word)
        size = np.diff(np.append(heads, len(word)))
        rank = np.where(into >= 0, model.rank[into], _NONE)
        least = np.minimum.reduceat(rank, heads)
        more = least < _NONE
        if not more.all():
            stay = np.repeat(more, size)
            done.append((symbol[~stay], word[~stay]))
            symbol, word, into, rank, size, least = symbol[stay], word[stay], into[stay], rank[stay], size[more], least[more]
            if not len(symbol):
                break
        hits = np.flatnonzero(rank == np.repeat(least, size))
        begun = np.maximum.accumulate(np.where(np.diff(hits, prepend=-2) != 1, hits, 0))
        hits = hits[(hits - begun) % 2 == 0]  # of overlapping pairs every other one
        made = into[hits]
        left = np.maximum(hits - 1, 0)
        follows = np.concatenate(([False], (hits[1:] == hits[:-1] + 2) & (word[hits[1:]] == word[hits[:-1]])))
        before = np.where(follows, np.concatenate(([0], made[:-1])), symbol[left])
        right = np.minimum(hits + 2, len(symbol) - 1)
        aside = np.where((hits > 0) & (word[left] == word[hits]), model.pair(before, made), -1)
        onward = np.where((hits + 2 < len(symbol)) & (word[right] == word[hits]), model.pair(made, symbol[right]), -1)
        now = model.rank[made]
        early = ((aside >= 0) & (model.rank[aside] <= now)) | ((onward >= 0) & (model.rank[onward] <= now))
        if early.any():
            first = np.concatenate(([True], word[hits[1:]] != word[hits[:-1]]))
            kept = first | ~np.isin(word[hits], word[hits[early]])
            hits, made = hits[kept], made[kept]
        symbol[hits] = made
        stay = np.ones(len(symbol), bool)
        stay[hits + 1] = False
        symbol, word, into = symbol[stay], word[stay], into[stay]
        at = hits - np.arange(len(hits))
        look(np.concatenate((at - 1, at)))
    if not done:
        return symbol, word
    symbol, word = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return symbol[order], word[order]


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(data)))
    point = data[at].astype(np.int32)
    for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        rows = np.flatnonzero(size == n)
        value = point[rows] & mask
        for k in range(1, n):
            value = value << 6 | (data[at[rows] + k] & 0x3F)
        point[rows] = value
    return point, at


def _tokens(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of different words, flat, and how many each has."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    point, at = _characters(data)
    symbol = model.symbols[point]
    word = np.searchsorted(offsets, at, "right") - 1
    new = np.concatenate(([True], word[1:] != word[:-1]))
    inside = np.flatnonzero(~new & (np.diff(offsets) > _LONG)[word])
    keys = symbol[inside - 1].astype(np.int64) << _SHIFT | symbol[inside]
    new[inside[model.near[np.minimum(np.searchsorted(model.near, keys), len(model.near) - 1)] != keys]] = True
    part = np.cumsum(new) - 1
    owner = word[_heads(part)]
    symbol, part = merged(model, symbol, part)
    odd = symbol >= _CHARACTER
    point = np.where(odd, symbol - _CHARACTER, 0)
    size = np.where(odd, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
    ids, where = np.repeat(symbol, size), np.repeat(owner[part], size)
    if odd.any():
        raw = np.frombuffer("".join(map(chr, point[odd].tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        ids[np.repeat(odd, size)] = model.byte_ids[raw]
    return ids, np.bincount(where, minlength=len(offsets) - 1)


def encode_texts(model: Model, texts: pa.Array, end: bool = True) -> pa.ListArray:
    """Ids of each text, with the end id if ``end``."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring(texts, SPACE)).as_py():
        texts = pc.replace_substring(texts, SPACE, " ")
    data, at = W.text_bytes(texts)
    full = np.diff(at) > 0
    data = np.insert(data, at[:-1][full], 0x20)  # each text that isn't empty begins with a space
    at = at + np.concatenate(([0], np.cumsum(full)))
    space = np.flatnonzero(data == 0x20)
    new = np.diff(space, prepend=-2) != 1
    new[np.searchsorted(space, at[:-1][full])] = True
    if model.run:
        place = space - np.maximum.accumulate(np.where(new, space, 0))
        new |= place % model.run == 0
    starts = space[new]
    wide = (np.int64, pa.LargeStringArray) if len(data) >= 2**31 else (np.int32, pa.StringArray)
    offsets = np.append(starts, len(data)).astype(wide[0])
    found = wide[1].from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())).dictionary_encode()
    ids, counts = _tokens(model, *W.text_bytes(found.dictionary))
    which = found.indices.to_numpy(zero_copy_only=False)
    n = counts[which]
    flat = ids[W.ranges((np.cumsum(counts) - counts)[which], n)] if len(which) else np.zeros(0, np.int32)
    ends = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, at)]
    if end:
        flat = np.insert(flat, ends[1:], model.end)
        ends = ends + np.arange(len(ends))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _repaired(raw: bytes) -> bytes:
    """Bytes with U+FFFD for each one that is part of no character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                raw[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(raw[at : at + size])
            break
        else:
            out.append("�".encode())
            size = 1
        at += size
    return b"".join(out)


def decode_ids(model: Model, ids: pa.ListArray) -> pa.Array:
    """Texts of lists of ids."""
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and not (0 <= flat.min() and flat.max() < len(model.pieces)):
        raise ValueError("ids beyond the model")
    taken = model.surfaces.take(pa.array(flat))
    data, piece = W.text_bytes(taken)
    at = np.concatenate(([0], np.cumsum(counts)))
    spoken = np.flatnonzero(model.kinds[flat] != _CONTROL)
    first = np.searchsorted(spoken, at[:-1])
    some = first < np.searchsorted(spoken, at[1:])
    first = spoken[first[some]]
    drop = piece[first[model.opens[flat[first]]]]
    data = np.delete(data, drop)
    piece = piece - np.searchsorted(drop, piece)
    raw = data.tobytes()
    ends = piece[at]
    starts = ends[:-1][ends[:-1] < ends[1:]]
    mute = np.setdiff1d(np.flatnonzero(model.kinds[flat] == _CONTROL), at[1:] - 1)  # bytes on both sides of one aren't joined
    try:
        raw.decode()
        whole = not len(mute) and not ((data[starts] & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if whole:
        return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw)).cast(pa.string())
    texts = []
    for begin, end in zip(at, at[1:], strict=False):
        cuts = [piece[begin], *piece[mute[(mute > begin) & (mute < end)]], piece[end]]
        texts.append("".join(_repaired(raw[a:b]).decode() for a, b in zip(cuts, cuts[1:], strict=False)))
    return pa.array(texts, pa.string())


def _with_column(docs: DataFrame, raw: bytes, source: str, to: str, kind: str, make: Callable[[Model, pa.Array], pa.Array], limit: int) -> DataFrame:
    """``docs`` and the column ``to`` that ``make`` gives for slabs of ``source``."""
    if to.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{to}: there is such a column")
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    place = docs.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            column = batch.column(place)
            size = pc.fill_null(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(total, total[begin] + limit, "right")) - 1)
                some = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*some.columns, make(model, some.column(place))], names=[*batch.schema.names, to])
                begin = end

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{to}` {kind}")


def encode(docs: DataFrame, model: bytes, text: str = "text", to: str = "ids", end: bool = True) -> DataFrame:
    """``docs`` with ``to``: the ids of ``text``, closed by the end id if ``end``. ``model``: see ``read_model``."""
    return _with_column(docs, model, text, to, "array<int>", lambda m, texts: encode_texts(m, texts, end), SLAB_BYTES)


def decode(docs: DataFrame, model: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with ``to``: the text of the ids in ``ids``."""
    return _with_column(docs, model, ids, to, "string", decode_ids, SLAB_BYTES // 4)
