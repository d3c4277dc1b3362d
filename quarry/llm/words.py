"""Words of many texts at once: byte offsets and 64-bit hashes, found with numpy inside a task.

A batch of texts is one byte array plus offsets (Arrow's own layout), so that a word is a pair of byte positions and
nothing is built per word. Texts are handled in slabs of a few MB, which bounds a task's memory whatever the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that separate words: space, tab, LF, VT, FF, CR.
WHITESPACE = b" \t\n\v\f\r"
SLAB_BYTES = 2 << 20
_PIECE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def whitespace_table() -> np.ndarray:
    """True for the bytes of words between white space."""
    table = np.ones(256, bool)
    table[list(WHITESPACE)] = False
    return table


def alphanumeric_table() -> np.ndarray:
    """True for ASCII letters and digits and for every byte of a character beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    """Lower-cases A-Z and leaves every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slabs(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text each; one text alone may be larger."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def bounds(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (one more at the end)."""
    inside = table[data]
    edges = at[(at > 0) & (at < len(data))]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(size: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        ones = np.ones(max(size, _PIECE + 4096), np.uint64)
        up, down = ones.copy(), ones
        up[1:], down[1:] = np.uint64(_MULTIPLIER), np.uint64(_INVERSE)
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from differences of running sums over pieces of about 1 MB.

    With ``prefixes``, a row for the words and one for each prefix length; a prefix as long as its word or longer is 0.
    """
    out = np.zeros((1 + len(prefixes), len(starts)), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _PIECE, "right")))
        low, high = int(starts[first]), int(ends[last - 1])
        up, down = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        begun, shift = sums[s], down[s]
        out[0, first:last] = mixed((sums[e] - begun) * shift)
        for k, n in enumerate(prefixes, 1):
            longer = e - s > n
            out[k, first:last][longer] = mixed((sums[s[longer] + n] - begun[longer]) * shift[longer] + np.uint64(n))
        first = last
    return out if prefixes else out[0]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64
#: Longer pieces are hashed one by one.
_LONG = 1024


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many pieces of ``data`` (bytes) at once: eight bytes a step, all pieces that are long enough together."""
    padded = np.append(data, np.zeros(8, np.uint8))
    lanes = np.ascontiguousarray(np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)))  # eight bytes from each position
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), 1 << 13):  # as many as a processor's cache holds
        some = slice(low, low + (1 << 13))
        out[some] = _xxh64(data, padded, lanes, starts[some], ends[some], seed)
    return out


def _xxh64(data, padded, lanes, starts, ends, seed) -> np.ndarray:
    n = ends - starts
    order = np.argsort(np.minimum(n, _LONG + 1).astype(np.uint16), kind="stable")
    n_long = int((n > _LONG).sum())
    out = np.empty(len(n), np.uint64)
    for i in order[len(n) - n_long :].tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    order = order[: len(n) - n_long]
    at, size = starts[order], n[order]
    h = np.full(len(order), (seed + int(_P5)) % (1 << 64), np.uint64)
    first = int(np.searchsorted(size, 32))
    if first < len(order):
        begin = (seed + int(_P1) + int(_P2), seed + int(_P2), seed, seed - int(_P1))
        v = [np.full(len(order) - first, x % (1 << 64), np.uint64) for x in begin]
        begun, stripes = at[first:], size[first:] // 32
        for k in range(int(stripes[-1])):
            low = int(np.searchsorted(stripes, k + 1))
            for j in range(4):
                v[j][low:] = _rotated(v[j][low:] + lanes[begun[low:] + (32 * k + 8 * j)] * _P2, 31) * _P1
        total = _rotated(v[0], 1) + _rotated(v[1], 7) + _rotated(v[2], 12) + _rotated(v[3], 18)
        for x in v:
            total = (total ^ (_rotated(x * _P2, 31) * _P1)) * _P1 + _P4
        h[first:] = total
    h += size.astype(np.uint64)
    at, rest = at + size // 32 * 32, size % 32
    for k in range(3):
        held = np.flatnonzero(rest >= 8 * (k + 1))
        x = h[held] ^ (_rotated(lanes[at[held] + 8 * k] * _P2, 31) * _P1)
        h[held] = _rotated(x, 27) * _P1 + _P4
    at, rest = at + rest // 8 * 8, rest % 8
    held = np.flatnonzero(rest >= 4)
    h[held] = _rotated(h[held] ^ ((lanes[at[held]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at, rest = at + rest // 4 * 4, rest % 4
    for k in range(3):
        held = np.flatnonzero(rest > k)
        h[held] = _rotated(h[held] ^ (padded[at[held] + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    out[order] = h ^ (h >> np.uint64(32))
    return out


def word_hash(word: str) -> int:
    """``hashes`` of one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` consecutive words, by the first word's index; ``len(words) - n + 1`` values."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(_MULTIPLIER) + words[k : k + len(total)]
    return mixed(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbouring values."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[: len(values) - step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` (``counts[0]`` of them), then those of ``starts[1]``, and so on."""
    total = int(counts.sum())
    jump = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return jump + np.arange(total)
