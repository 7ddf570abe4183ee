"""Substring deduplication behind a count-min prefilter.

Pass 1: every unit of documents sketches its windows in two rows of hashed counters; the sketches are summed by range of
cells, and each unit gets back a bit for each of its cells: counted twice or more. A cell never counts less than any of
its windows, so no repeated window is missed. Pass 2 sends on only the windows with both bits, each once per unit with the smallest
document that has it there, and groups them exactly by 128 bits of two hashes. The sketch grows with the input; a window of very many
documents is a row entry per unit, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import freed, tasks_for, written
from .units import CELLS, Cells, answers_of, in_units, opened, range_of, ranges_for, sketched

LAST = np.iinfo(np.int64).max  # stands for a doc_id that is null: after every other


def windows(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[scan.Words, np.ndarray, list[np.ndarray]]:
    """Words, the words at which a window starts, and two hashes for each of these."""
    words = scan.Words(raw, offsets)
    at = scan.window_starts(words.first, size)
    return words, at, [scan.window_hash(scan.span_hash(raw, words.start, words.end, k), size, k)[at] if len(at) else np.zeros(0, scan.U) for k in (0, 1)]


class Suspects:
    """The windows of a unit that the sketch calls repeated, and their groups: equal windows, in order of the first hash."""

    def __init__(self, rows: pa.RecordBatch, answers: list[dict] | None, size: int, ranges: int, cells: int):
        self.raw, self.offsets = scan.text_buffer(rows.column("text"))
        self.words, at, hashes = windows(self.raw, self.offsets, size)
        ok = np.ones(len(at), bool)
        for row in (0, 1):
            ok &= Cells(hashes[row], ranges, cells).back(answers_of(answers, row)).astype(bool)
        self.at, (a, b) = at[ok], (h[ok] for h in hashes)
        self.doc = rows.column("doc_id").fill_null(LAST).to_numpy()[self.words.doc[self.at]]
        order = np.lexsort((self.doc, b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        self.group = np.empty(len(a), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.h1, self.h2, self.least = a[new], b[new], self.doc[order][new]


def send_groups(size: int, ranges: int, cells: int):
    """Units with their answers -> per unit and range of the first hash, its different suspects and their smallest documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, data, answers in zip(batch.column("unit").to_pylist(), batch.column("data"), batch.column("answers").to_pylist(), strict=True):
                s = Suspects(opened(data), answers, size, ranges, cells)
                if not len(s.h1):
                    continue
                at = range_of(s.h1, ranges).astype(np.int32)
                cut = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at))
                parts = [[x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for x in (s.h1, s.h2, s.least)]
                yield pa.RecordBatch.from_arrays([pa.array(at[cut[:-1]]), pa.array(np.full(len(cut) - 1, unit)), *(pa.array(x, pa.binary()) for x in parts)], ["range", "unit", "h1", "h2", "least"])

    return run


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups the windows of each range exactly; tells each unit, bit by bit, which of its windows start in a smaller document elsewhere."""
    now, held = None, []

    def settle() -> pa.RecordBatch:
        a, b, least = (np.frombuffer(b"".join(x[i] for x in held), t) for i, t in ((1, "<u8"), (2, "<u8"), (3, "<i8")))
        order = np.lexsort((least, b, a))
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
        first = np.flatnonzero(new)
        smaller = np.empty(len(a), bool)
        smaller[order] = least[order] > np.repeat(least[order][first], np.diff(np.append(first, len(a))))
        cut = np.append(0, np.cumsum([len(x[1]) // 8 for x in held]))
        bits = [np.packbits(smaller[i:j], bitorder="little").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([now] * n, pa.int32()), pa.array(np.diff(cut)), pa.array(bits, pa.binary())], ["unit", "range", "n", "bits"])

    for batch in batches:
        for at, *row in zip(*(batch.column(c).to_pylist() for c in ("range", "unit", "h1", "h2", "least")), strict=True):
            if at != now:
                if held:
                    yield settle()
                now, held = at, []
            held.append(row)
    if held:
        yield settle()


def removed_words(docs: DataFrame, size: int = 13, most_cells: int = CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text left): per row of `docs`, in no order.

    A word goes if a window of `size` words that covers it also starts in a document with a smaller doc_id. Windows are
    judged on the input. Null, empty and short texts have no window and lose nothing. Rows that share a doc_id are one
    document to this rule: they don't remove from each other. A null doc_id counts as larger than any other.
    `most_cells` (a power of two) is what one task counts at a time; the sketch has as many for each PER_RANGE windows.
    """
    units = in_units(docs, "doc_id")
    ranges = ranges_for(units)

    def hashes(rows: pa.RecordBatch) -> list[np.ndarray]:
        return windows(*scan.text_buffer(rows.column("text")), size)[2]

    answers = written(sketched(units, hashes, ranges, lambda count: count > 1, most_cells), "repeated")
    known = units.select("unit", "data").join(answers, "unit", "left")
    sent = known.mapInArrow(freed(send_groups(size, ranges, most_cells)), "range int, unit long, h1 binary, h2 binary, least binary")
    sent = sent.repartition(tasks_for(units, 4), "range").sortWithinPartitions("range")
    found = sent.mapInArrow(freed(decide), "unit long, range int, n long, bits binary")
    found = written(found.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("range", "n", "bits"))).alias("found")), "found")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, answers, found in zip(batch.column("data"), batch.column("answers").to_pylist(), batch.column("found").to_pylist(), strict=True):
                rows = opened(data)
                s = Suspects(rows, answers, size, ranges, most_cells)
                smaller = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"], bitorder="little") for x in found or ()]
                smaller = np.concatenate(smaller).astype(bool) if smaller else np.zeros(0, bool)
                hit = smaller[s.group] | (s.doc > s.least[s.group])
                words = s.words
                gone = scan.covered(s.at[hit], size, len(words))
                texts = kept_texts(s.raw, words, gone)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(words.first)), pa.array(scan.per_document(gone, words.first)), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode() for t in texts])],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return known.join(found, "unit", "left").select("data", "answers", "found").mapInArrow(freed(finish), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def kept_texts(raw: np.ndarray, words: scan.Words, gone: np.ndarray) -> list[bytes]:
    """Per document, the words that stay, joined by one space."""
    stay = np.flatnonzero(~gone)
    length = words.end[stay] - words.start[stay] + 1
    n = np.append(0, np.cumsum(length))
    out = np.full(n[-1] + 1, 0x20, np.uint8)
    source = np.arange(n[-1]) - np.repeat(n[:-1] - words.start[stay], length)
    inside = np.ones(n[-1], bool)
    inside[n[1:] - 1] = False
    out[: n[-1]][inside] = raw[source[inside]]
    ends = n[np.searchsorted(stay, words.first)]
    data = out.tobytes()
    return [data[i : max(i, j - 1)] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
