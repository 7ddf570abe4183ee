"""Documents in units: some MB of whole rows as one compressed row, for passes that have to meet the same rows again.

A pass names a document by its unit and its place there, sends one row per unit and range of hashes, and what comes back is
joined by unit, so rows and joins follow the megabytes, not the documents. Units also carry a sketch of hash counts
(`sketched`): each unit sends its different cells to the task that owns that range of cells, the ranges are summed, and the
sums go back to the unit. No sketch is broadcast or held whole, so it grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import freed, tasks_for, written

UNIT_BYTES = 4 << 20
UNIT_ROWS = 50_000
CELLS = 1 << 23  # cells of a range
PER_RANGE = 1 << 20  # hashes of a range


def in_units(docs: DataFrame, *columns: str) -> DataFrame:
    """unit, n_bytes, n_rows, data: the rows of `docs`, with `text` and the columns named, about UNIT_BYTES of text in each unit (a longer text is alone).

    The table is written, so later passes find the same rows at the same places, whatever becomes of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sealed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
                out.write_table(rows)
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([len(rows)], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["n_bytes", "n_rows", "data"])

        held, size, n = [], 0, 0
        for batch in batches:
            for rows, raw, _ in scan.blocks(batch, "text"):
                if held and (size + len(raw) > UNIT_BYTES or n + len(rows) > UNIT_ROWS):
                    yield sealed()
                    held, size, n = [], 0, 0
                held.append(rows)
                size, n = size + len(raw), n + len(rows)
        if held:
            yield sealed()

    rows = docs.select(*columns, "text").mapInArrow(freed(run), "n_bytes long, n_rows int, data binary")
    return written(rows.withColumn("unit", F.monotonically_increasing_id()), "units").select("unit", "n_bytes", "n_rows", "data")


def opened(data: pa.BinaryScalar) -> pa.RecordBatch:
    """The rows of a unit."""
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks().to_batches()[0]


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of four bytes, compressed; best for small ones."""
    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def ranges_for(units: DataFrame, bytes_each: int = 6) -> int:
    """Ranges of hashes for units with about one hash every `bytes_each` bytes."""
    return max(1, min(1 << 23, -(-(units.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0) // (bytes_each * PER_RANGE))))


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """0 to ranges - 1, rising with the hash."""
    return (hashes >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)


class Cells:
    """The different cells of a unit's hashes, by range; `back` gives each hash the value that its cell got."""

    def __init__(self, hashes: np.ndarray, ranges: int, cells: int = CELLS):
        low = np.uint64(cells.bit_length() - 1)
        code = range_of(hashes, ranges) << low | (hashes & np.uint64(cells - 1))
        self.code, self.inverse, self.times = np.unique(code, return_inverse=True, return_counts=True)
        self.range = (self.code >> low).astype(np.int32)
        self.cell = (self.code & np.uint64(cells - 1)).astype(np.int64)
        self.cut = np.append(np.flatnonzero(np.append(True, self.range[1:] != self.range[:-1])), len(self.range)) if len(self.range) else np.zeros(1, np.int64)

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        for i, j in zip(self.cut[:-1].tolist(), self.cut[1:].tolist(), strict=True):
            yield int(self.range[i]), pack(np.diff(self.cell[i:j], prepend=0)), pack(self.times[i:j])

    def back(self, answers: list[np.ndarray]) -> np.ndarray:
        """answers: by range, in order."""
        return (np.concatenate(answers) if answers else np.zeros(0, np.uint8))[self.inverse]


def sketched(units: DataFrame, hashes: Callable[[pa.RecordBatch], list[np.ndarray]], ranges: int, answer: Callable[[np.ndarray], np.ndarray], cells: int = CELLS) -> DataFrame:
    """unit and answers (structs of row, range, value): per sketch row and range of a unit, `answer` of the summed counts of its cells, one byte for each.

    `hashes` gives a unit's hashes for each row of the count-min sketch. A cell's count is never less than that of a hash in it.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, data in zip(batch.column("unit").to_pylist(), batch.column("data"), strict=True):
                for row, values in enumerate(hashes(opened(data))):
                    if found := list(Cells(values, ranges, cells).rows()):
                        at, cell, times = zip(*found, strict=True)
                        n = len(found)
                        yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int32()), pa.array(at, pa.int32()), pa.array([unit] * n, pa.int64()), pa.array(cell, pa.binary()), pa.array(times, pa.binary())], ["row", "range", "unit", "cells", "times"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(cells, np.uint32)

        def settle() -> Iterator[pa.RecordBatch]:
            count[:] = 0
            for _, cell, times in held:
                at = np.cumsum(unpack(cell), dtype=np.int64)
                count[at] = np.minimum(count[at].astype(np.uint64) + unpack(times), 2**32 - 1)
            for i in range(0, len(held), 200):
                part = held[i : i + 200]
                values = [zstandard.compress(answer(count[np.cumsum(unpack(cell), dtype=np.int64)]).astype(np.uint8).tobytes(), 1) for _, cell, _ in part]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([now[0]] * n, pa.int32()), pa.array([now[1]] * n, pa.int32()), pa.array(values, pa.binary())], ["unit", "row", "range", "value"])

        now, held = None, []
        for batch in batches:
            for *key, unit, cell, times in zip(*(batch.column(c).to_pylist() for c in ("row", "range", "unit", "cells", "times")), strict=True):
                if key != now:
                    if held:
                        yield from settle()
                    now, held = key, []
                held.append((unit, cell, times))
        if held:
            yield from settle()

    rows = units.select("unit", "data").mapInArrow(freed(send), "row int, range int, unit long, cells binary, times binary")
    rows = rows.repartition(tasks_for(units, 4), "row", "range").sortWithinPartitions("row", "range")
    back = rows.mapInArrow(freed(merge), "unit long, row int, range int, value binary")
    return back.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("row", "range", "value"))).alias("answers"))


def answers_of(answers: list[dict] | None, row: int) -> list[np.ndarray]:
    """The answers of one sketch row, by range."""
    return [np.frombuffer(zstandard.decompress(x["value"]), np.uint8) for x in answers or () if x["row"] == row]
