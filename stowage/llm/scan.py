"""Vectorised scans over the UTF-8 bytes of Arrow string columns.

Every function works on one contiguous byte buffer plus document offsets, so a task handles millions of
words in a handful of numpy passes instead of one Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: The separators of `[^\x20\x09-\x0D]+`.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random odd 64-bit value per byte and an odd base, twice: for rolling hashes, which only say where to look.
BYTE_VALUE = [_rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for _ in range(2)]
BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_powers: dict[tuple[int, bool], np.ndarray] = {}
_keys: dict[int, np.ndarray] = {}
#: Masks of the first 0 to 8 bytes of a lane.
LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse) modulo 2**64 for i below n; grown on demand and kept per process."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(BASE[which], -1, 2**64) if inverse else BASE[which]
        out = np.full(max(n, 1 << 16), base, U)
        out[0] = 1
        have = _powers[which, inverse] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def stir(x: np.ndarray) -> np.ndarray:
    """Another bijective finaliser."""
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(30))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `most` bytes of text each (one row at least), so that the passes stay in cache."""
    raw, offsets = text_buffer(batch.column(column))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """Start, end and document of every word, in order; first[d]..first[d + 1] are the words of document d."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR):
        inside = ~separator[raw]
        n, edge = len(raw), offsets[(offsets > 0) & (offsets < len(raw))]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edge], after[edge - 1] = False, False
        self.inside = inside
        self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)


def keys(which: int, n: int) -> np.ndarray:
    """A key for each of a span's lanes; grown on demand and kept per process."""
    have = _keys.get(which)
    if have is None or len(have) < n:
        at = np.arange(max(n, 1 << 12), dtype=U)
        have = _keys[which] = mix(at * U(BASE[which]) + BYTE_VALUE[which][77])
    return have[:n]


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for every span; spans may overlap.

    A span is read in lanes of eight bytes. Each lane is mixed with a key of its place, so no rule on the places of bytes
    makes spans collide, as it does in a polynomial modulo 2**64. The two hashes differ in keys, mixing and sum.
    """
    if not len(start):
        return np.zeros(0, U)
    bytes_at = np.append(raw, np.zeros(8, np.uint8))
    lanes = np.ndarray((len(raw) + 1,), "<u8", bytes_at.data, strides=(1,))
    size = end - start
    count = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(count) - count
    if len(start) == (total := int(count.sum())):
        nth, at, left = 0, start, size
    else:
        nth = np.arange(total) - np.repeat(first, count)
        at = np.repeat(start, count) + 8 * nth
        left = np.repeat(end, count) - at
    lane = lanes[at] & LANE[np.minimum(left, 8)]
    key = keys(which, int(count.max()))[nth]
    if which == 0:
        lane = mix(lane ^ key)
        lane = lane if len(lane) == len(start) else np.add.reduceat(lane, first)
    else:
        lane = stir(lane + key)
        lane = lane if len(lane) == len(start) else np.bitwise_xor.reduceat(lane, first)
    return mix(lane + size.astype(U) * U(BASE[1 - which]))


def window_hash(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of every `size` consecutive word hashes; windows that cross documents are for the caller to drop."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    base = U(BASE[1 - which])
    for i in range(size):
        out *= base
        out += words[i : i + n]
    return mix(out)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Indexes of the words at which a window of `size` words of one document starts."""
    n = int(first[-1])
    ok = np.ones(max(n, 0), bool)
    counts = np.diff(first)
    for back in range(1, size):  # the last size - 1 words of each document start none
        ok[first[1:][counts >= back] - back] = False
    return np.flatnonzero(ok)


def sequence_hash(values: np.ndarray, cut: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the hashes values[cut[i]:cut[i + 1]] in their order; no part is empty."""
    n = np.diff(cut)
    nth = np.arange(cut[-1]) - np.repeat(cut[:-1], n)
    key = keys(which, int(n.max()))[nth]
    total = np.add.reduceat(mix(values ^ key), cut[:-1]) if which == 0 else np.bitwise_xor.reduceat(stir(values + key), cut[:-1])
    return mix(total + n.astype(U))


def order_by(values: np.ndarray | None, doc: np.ndarray) -> np.ndarray:
    """The order by document, then by value; without values stable. Small numbers are sorted by their digits."""
    order = np.arange(len(doc)) if values is None else np.argsort(values)
    if len(doc):
        for shift in range(0, max(1, int(doc.max()).bit_length()), 16):
            order = order[np.argsort((doc[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[d]:bounds[d + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Marks of the n positions covered by [s, s + size) for any s."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1) if len(starts) < 64 else np.add(delta[:-1], np.bincount(starts, minlength=n), out=delta[:-1], casting="unsafe")
    ends = np.bincount(starts + size, minlength=n + 1) if len(starts) else np.zeros(n + 1, np.int64)
    return np.cumsum(delta[:n] - ends[:n]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks of the keys that occur twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def salted(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that can be equal within one document only."""
    return mix(values ^ mix(doc.astype(U) + U(0x51ED270B)))
