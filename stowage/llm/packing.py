"""Best-fit packing by minimum bin slack.

Only lengths matter to a bin, and there are at most `capacity` of them, so the bins are planned on the counts of lengths: a
bin takes the longest piece left and, by a bitset subset-sum over the lengths still available, the combination that
leaves the least slack; the combination is taken out as often as the counts allow, which is what bin after bin
would do. The plan is a list of combinations, however many pieces there are. Spark then numbers the pieces of each
length and looks up each one's place.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import freed, written


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to `room`; longer ones are preferred. lengths: falling."""
    full, reach = 1 << room, 1
    mask = (full << 1) - 1
    steps: list[tuple[int, int, int]] = []
    for at in range(bisect.bisect_left(lengths, -room, key=lambda x: -x), len(lengths)):
        length = lengths[at]
        left, copies = min(counts[length], room // length), 1
        while left and not reach & full:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & mask
            left, copies = left - take, copies * 2
        if reach & full:
            break
    total, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= length * take
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) of every kind of bin; together they use up the counts."""
    counts = {k: v for k, v in counts.items() if v}
    lengths = sorted(counts, reverse=True)
    bins = []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        inside = fullest(counts, lengths, capacity - longest)
        counts[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        times = min(counts[k] // m for k, m in inside.items())
        bins.append((times, inside))
        for k, m in inside.items():
            counts[k] -= times * m
            if not counts[k]:
                lengths.remove(k)
    return bins


def places(bins: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """length -> rows (first number, copies in a bin, offset of the first copy, first sequence), by first number."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, inside in bins:
        offset = 0
        for length in sorted(inside, reverse=True):
            m = inside[length]
            out.setdefault(length, []).append((used.get(length, 0), m, offset, sequence))
            used[length] = used.get(length, 0) + times * m
            offset += m * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """The texts that a tokenizer file names as tokens of their own, with their ids: they are cut out before anything else."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f).get("added_tokens", ())}


def cut_pieces(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, capacity: int, with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth (and ids): the pieces, numbered by length within each task."""
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, len(whole), 500):
                rows = whole.slice(at, 500)
                out = []
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    ids = np.array(encoding.encode(text or "", allowed_special="all", disallowed_special=()), "<u4").tobytes() + end
                    n = len(ids) // 4
                    cut = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for piece, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                        own = ids[4 * i : 4 * j]
                        out.append((doc, piece, i, j - i, zlib.crc32(own), part, seen[j - i], own))
                        seen[j - i] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)][: len(columns)], columns)

    return docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): per piece of the rows of `docs`, in no order.

    A text's ids, and end_id after them, are one piece if they fit; else the first piece is what is left over and the
    others are full. A text in `added` is one id wherever it stands (null: none). Null and empty texts are end_id alone. Repeated rows are packed as often as they come. At most `capacity`
    counts reach the driver; what goes to the executors grows with the combinations in the plan, not with the pieces.
    """
    pieces = written(cut_pieces(docs, ranks_path, pattern, end_id, capacity, with_ids, added), "pieces")
    each = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(places(plan_bins(counts, capacity)))
    before = each.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    numbered = pieces.join(before, ["part", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = table.value
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("base").to_numpy() + batch.column("nth").to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                plan = rows_of[k]
                first, m, begin, base = plan[np.searchsorted(plan[:, 0], number[at], "right") - 1].T
                sequence[at] = base + (number[at] - first) // m
                offset[at] = begin + (number[at] - first) % m * k
            made = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)

    return numbered.mapInArrow(freed(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)
