"""Exact substring deduplication by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every string of `size` bytes belongs to the least hash of its 32-byte pieces, so equal strings belong to the same hash,
wherever they are. Consecutive starts with one hash form a context: their text, start to end. Contexts whose hash is met
once cannot repeat and are left. Equal contexts decide each other. What remains - hashes with different contexts -
is dealt out by hash; each task concatenates contexts, builds the transform and expands intervals breadth-first by
backward extension, which yields the common prefixes of neighbouring suffixes by increasing value, and stops at `size`:
neighbours still unseparated share that many bytes. A hash with very many different contexts (the edge of a passage
that every document shares) is split by the strings themselves, so no task meets it whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import freed, keyed, packed_texts, tasks_for, unpacked, written

PIECE = 32
FLUSH = 1 << 25  # starts that a task holds before equal contexts are folded
CROWD = 1000  # different contexts of a hash beyond which it is split by strings
BLOCK = 1 << 21  # bytes of contexts in one transform


def contexts(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, hash, content hash, loop) of every context; starts are bytes of the block.

    loop: the context has its hash at two places or more, so that it may repeat itself.
    """
    n = len(raw)
    start = np.zeros(n, bool)
    for i, j in zip(offsets[:-1], offsets[1:], strict=True):
        start[i : max(i, j - size + 1)] = True
    if not start.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, scan.U, scan.U, bool))
    total = np.zeros(n + 1, scan.U)
    np.cumsum(scan.BYTE_VALUE[0][raw] * scan.powers(0, n), out=total[1:])
    least = scan.mix((total[PIECE:] - total[:-PIECE]) * scan.powers(0, n - PIECE + 1, True))
    piece, width = least.copy(), 1
    window = size - PIECE + 1
    while 2 * width <= window:
        least[: len(least) - width] = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if window > width:
        least[: len(least) - window + width] = np.minimum(least[: len(least) - window + width], least[window - width :])
    at = np.flatnonzero(start)
    h = least[at]
    doc = np.searchsorted(offsets, at, "right") - 1
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    h = h[first]
    values, code = np.unique(h, return_inverse=True)
    known = np.zeros(1 << 20, bool)  # lets few other pieces through
    low = np.uint64((1 << 20) - 1)
    known[values & low] = True
    place = np.flatnonzero(known[piece & low])
    i = np.minimum(np.searchsorted(values, piece[place]), len(values) - 1)
    place, i = place[values[i] == piece[place]], i[values[i] == piece[place]]
    key = np.sort(i * n + place)
    loop = np.searchsorted(key, code * n + at[last] + window - 1, "right") - np.searchsorted(key, code * n + at[first]) > 1
    return doc[first], at[first], at[last], h, scan.span_hash(raw, at[first], at[last] + size, 1), loop


def fold(held: list) -> pa.RecordBatch:
    """One row per context and flush; `times` is 2 if the flush has it twice or more. The other copies come with h null: decided."""
    f, r, lo, hi, h, c, loop = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((c, h))
    a, b = h[order], c[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(a))) > 1
    times = np.ones(len(h), np.int32)
    times[order[first[many]]] = 2
    copy = np.zeros(len(h), bool)
    copy[order[~new]] = True
    deal = np.where(copy, r, h.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(deal), pa.array(h.view(np.int64), mask=copy), pa.array(c.view(np.int64)), pa.array(f), pa.array(r), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(times), pa.array(loop)], ["deal", "h", "c", "f", "r", "lo", "hi", "times", "loop"])


COLUMNS = "deal long, h long, c long, f long, r long, lo int, hi int, times int, loop boolean"


def all_contexts(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for rows, raw, offsets in scan.blocks(batch, "text"):
                doc, lo, hi, h, c, loop = contexts(raw, offsets, size)
                held.append((rows.column("rk_f").to_numpy()[doc], rows.column("rk_r").to_numpy()[doc], lo - offsets[doc], hi - offsets[doc], h, c, loop))
                n += len(raw)
                if n >= FLUSH:
                    yield from sliced(fold(held))
                    held, n = [], 0
        if n:
            yield from sliced(fold(held))

    return docs.select("rk_f", "rk_r", "text").mapInArrow(freed(run), COLUMNS)


def sliced(batch: pa.RecordBatch, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(batch), most):
        yield batch.slice(i, most)


def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts in order of (h, c): drops those whose hash is met once at one place, and says what is to be done with the others.

    what 0: decided, every start repeats. 1: decided, and stands for its content. 2: to be compared. 3: to be split by strings (crowd).
    """

    def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        folded = rows.column("h").is_null().to_numpy()
        h, c = rows.column("h").fill_null(0).to_numpy(), rows.column("c").to_numpy()
        times = rows.column("times").to_numpy().astype(np.int64)
        new_h = np.append(True, (h[1:] != h[:-1]) | (folded[1:] != folded[:-1]))
        new_c = new_h | np.append(True, c[1:] != c[:-1])
        group_h, group_c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        n_h, n_c = np.bincount(group_h, times), np.bincount(group_c, times)
        kinds = np.bincount(group_h, new_c)
        many = n_c[group_c] > 1
        alone = kinds[group_h] == 1
        what = np.where(many, np.where(new_c & ~alone, 1, 0), np.where(kinds[group_h] > CROWD, 3, 2))
        what = np.where(many & new_c & (kinds[group_h] > CROWD), 4, what)  # decided, stands for its content in a crowd
        what[folded] = 0
        keep = folded | (n_h[group_h] > 1) | rows.column("loop").to_numpy()
        out = rows.append_column("what", pa.array(what.astype(np.int32))).filter(pa.array(keep)).select(["h", "c", "f", "r", "lo", "hi", "what"])
        yield from out.combine_chunks().to_batches(20_000)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        h = batch.column("h").fill_null(0).to_numpy()
        if not len(h):
            continue
        held.append(batch)
        if h[-1] != held[0].column("h").fill_null(0)[0].as_py() and sum(map(len, held)) >= 100_000:
            rows = pa.Table.from_batches(held)
            last = rows.column("h").fill_null(0).to_numpy()
            cut = len(last) - int(np.argmax(last[::-1] != last[-1]))
            yield from judge(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
    if held:
        yield from judge(pa.Table.from_batches(held))


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols (or more), up to the terminator 0, by prefix doubling."""
    n = len(symbols)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(7):
        s = np.zeros(n, np.int64)
        s[: n - j] = symbols[j:]
        key = (key << 9) | np.where(alive, s, 0)
        alive &= s != 0
    order = np.argsort(key)
    ordered = key[order]
    head = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    open_slots = np.flatnonzero((~head | np.append(~head[1:], False)) & alive[order])
    known = 7
    while known < depth and len(open_slots):
        s = order[open_slots]
        key = rank[s] * n + rank[s + known]
        by = np.argsort(key)
        s, key = s[by], key[by]
        order[open_slots] = s
        head = np.append(True, key[1:] != key[:-1])
        rank_new = open_slots[np.flatnonzero(head)][np.cumsum(head) - 1]
        # A terminated suffix ties with equal ones for good: the second half then ends in a terminator too.
        tied = ~head | np.append(~head[1:], False)
        ended = symbols_end(symbols, s, known * 2)
        rank[s] = rank_new
        open_slots = open_slots[tied & ~ended]
        known *= 2
    return order


def symbols_end(symbols: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """True where a terminator comes within `reach` symbols."""
    ends = np.flatnonzero(symbols == 0)
    return ends[np.searchsorted(ends, at)] - at < reach


def repeated_starts(symbols: np.ndarray, size: int) -> np.ndarray:
    """Marks of the positions whose next `size` symbols also start elsewhere and hold no terminator (0, the last symbol)."""
    n = len(symbols)
    order = suffix_order(symbols, size)
    bwt = symbols[order - 1]
    psi = np.argsort(bwt, kind="stable").astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[psi] = np.arange(n, dtype=np.int32)
    same = bwt[psi[1:]] == bwt[psi[:-1]]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)  # nearest rows with the same symbol before them
    before[psi[1:][same]] = psi[:-1][same]
    after[psi[:-1][same]] = psi[1:][same]
    together = np.ones(n + 1, bool)  # rows i - 1 and i not separated so far
    together[[0, n]] = False
    counts = np.bincount(bwt, minlength=257)
    hi = np.cumsum(counts)[counts > 0]
    lo = hi - counts[counts > 0]
    for k in range(size):  # after round k, all common prefixes shorter than k are known; the first round is length 0
        fresh = together[hi]
        lo, hi = lo[fresh], hi[fresh]
        together[hi] = False
        if k == size - 1 or not len(lo):
            break
        length = hi - lo
        rows = np.arange(length.sum()) + np.repeat(lo - np.append(0, np.cumsum(length)[:-1]), length)
        rows_lo, rows_hi = np.repeat(lo, length), np.repeat(hi, length)
        ok = bwt[rows] != 0
        first, last = ok & (before[rows] < rows_lo), ok & (after[rows] >= rows_hi)
        lo, hi = np.sort(lf[rows[first]]).astype(np.int64), np.sort(lf[rows[last]]).astype(np.int64) + 1
    out = np.zeros(n, bool)
    out[order[together[:-1] | together[1:]]] = True
    return out & ~symbols_end(symbols, np.arange(n), size)


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of marks."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


SPANS = "f long, r long, lo int, hi int"


def expand(size: int):
    """Contexts in order of h -> the runs of their starts that repeat, for contexts of one document."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[4] for r in rows]
        length = np.array([len(t) + 1 for t in texts])
        begin = np.append(0, np.cumsum(length))
        symbols = np.zeros(begin[-1], np.uint16)
        inside = np.ones(begin[-1], bool)
        inside[begin[1:] - 1] = False
        symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
        lo, hi = runs(repeated_starts(symbols, size))
        of = np.searchsorted(begin, lo, "right") - 1
        single = np.array([r[5] == 2 for r in rows])[of]
        lo, hi, of = lo[single], hi[single], of[single]
        f, r, at = (np.array([x[i] for x in rows], np.int64)[of] for i in (1, 2, 3))
        return pa.RecordBatch.from_arrays([pa.array(f), pa.array(r), pa.array((lo - begin[of] + at).astype(np.int32)), pa.array((hi - begin[of] + at).astype(np.int32))], ["f", "r", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "f", "r", "lo", "content", "what")), strict=True):
                if n >= BLOCK and row[0] != held[-1][0]:
                    yield settle(held)
                    held, n = [], 0
                held.append(row)
                n += len(row[4])
        if held:
            yield settle(held)

    return run


def cut_contexts(size: int, crowd: bool):
    """Joined texts and their contexts -> the contexts' bytes; for a crowd, every string by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 200):
                batch = unpacked(whole.slice(at, 200))
                out = []
                for text, f, r, list_ in zip(*(batch.column(c).to_pylist() for c in ("text", "f", "r", "cut")), strict=True):
                    for x in list_:
                        out.append((x["h"], f, r, x["lo"], text[x["lo"] : x["hi"] + size], x["what"]))
                if not crowd:
                    yield pa.RecordBatch.from_pydict({k: pa.array([o[i] for o in out], t) for i, (k, t) in enumerate((("h", pa.int64()), ("f", pa.int64()), ("r", pa.int64()), ("lo", pa.int32()), ("content", pa.binary()), ("what", pa.int32())))})
                    continue
                for i in range(0, len(out), 500):
                    part = out[i : i + 500]
                    raw = np.frombuffer(b"".join(o[4] for o in part), np.uint8)
                    length = np.array([len(o[4]) for o in part])
                    begin = np.append(0, np.cumsum(length))[:-1]
                    n = length - size + 1
                    of = np.repeat(np.arange(len(part)), n)
                    start = begin[of] + np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
                    h1, h2 = (scan.span_hash(raw, start, start + size, k).view(np.int64) for k in (0, 1))
                    f, r, lo, what = (np.array([o[k] for o in part], np.int64)[of] for k in (1, 2, 3, 5))
                    weight = np.where(what == 4, 2, 1)
                    yield from sliced(pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(f), pa.array(r), pa.array((lo + start - begin[of]).astype(np.int32)), pa.array(weight)], ["h1", "h2", "f", "r", "lo", "weight"]))

    return run


def remove_repeats(docs: DataFrame, size: int = 200, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) and the columns to carry: per row of `docs`, in no order.

    A byte goes if a string of `size` bytes that covers it starts anywhere else too, in this or any other row; overlaps
    count, strings never cross rows and are judged on the input. Null texts are empty; texts under `size` bytes lose
    nothing; repeated rows remove each other. What is kept may
    cut a character in two: kept is binary, or with as_text a string without the bytes of such characters.
    """
    docs = keyed(docs, "doc_id", "text", *carry)
    types = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) if carry else ""
    parts = tasks_for(docs, 16)
    found = all_contexts(docs, size).repartition(parts, "deal").sortWithinPartitions("h", "c").mapInArrow(freed(sort_out), "h long, c long, f long, r long, lo int, hi int, what int")
    found = written(found, "contexts")
    open_ = found.where("what >= 1 and what < 5")
    sizes = open_.agg(F.count_if(F.col("what") < 3).alias("blocks"), F.count_if(F.col("what") >= 3).alias("crowds")).first()
    texts = packed_texts(docs.select("rk_f", "rk_r", "text")).select(F.col("rk_f").alias("f"), F.col("rk_r").alias("r"), "packed")

    def with_text(rows: DataFrame) -> DataFrame:
        return rows.groupBy("f", "r").agg(F.collect_list(F.struct("h", "lo", "hi", "what")).alias("cut")).join(texts, ["f", "r"]).select("f", "r", "packed", "cut")

    spans = found.where("what in (0, 1, 4)").select("f", "r", "lo", "hi")
    if sizes["blocks"]:
        rows = with_text(open_.where("what < 3")).mapInArrow(freed(cut_contexts(size, False)), "h long, f long, r long, lo int, content binary, what int")
        n = max(parts, sizes["blocks"] // 8000)
        spans = spans.union(rows.repartition(n, "h").sortWithinPartitions("h").mapInArrow(freed(expand(size)), SPANS))
    if sizes["crowds"]:
        rows = with_text(open_.where("what >= 3")).mapInArrow(freed(cut_contexts(size, True)), "h1 long, h2 long, f long, r long, lo int, weight long")
        again = rows.groupBy("h1", "h2").agg(F.sum("weight").alias("k")).where("k > 1").select("h1", "h2")
        spans = spans.union(rows.join(again, ["h1", "h2"]).select("f", "r", "lo", F.col("lo").alias("hi")))
    spans = spans.groupBy("f", "r").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = unpacked(whole.slice(at, 500))
                out = []
                for text, list_ in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    kept, end, removed, n = [], 0, 0, 0
                    for lo, hi in sorted((x["lo"], x["hi"] + size) for x in list_ or ()):
                        if n and lo <= end:
                            removed += max(0, hi - end)
                        else:
                            kept.append(text[end:lo])
                            removed += hi - lo
                            n += 1
                        end = max(end, hi)
                    kept.append(text[end:])
                    kept = b"".join(kept)
                    out.append((len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept))
                n_bytes, removed, n, sha, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *carry)), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], ["doc_id", *carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = packed_texts(docs).join(spans.select(F.col("f").alias("rk_f"), F.col("r").alias("rk_r"), "spans"), ["rk_f", "rk_r"], "left")
    return joined.select("doc_id", *carry, "packed", "spans").mapInArrow(freed(finish), f"doc_id long{types}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'string' if as_text else 'binary'}")
