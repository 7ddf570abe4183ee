"""Importance resampling of documents towards a target corpus, on hashed n-gram counts, with repeated lines counted once.

Line feeds separate words, so a text's features are those inside its lines and the n-grams across lines. A line that occurs many times is
counted once: tasks send each different line of a batch with its number of occurrences, the numbers are added up by line, and only then
is a line's text cut into words and features, whose counts are multiplied. N-grams across lines need a line's first and
last word only, and are counted for each document where its lines stand. Weights take the same two parts: sums over each different line of a
batch, once, and what lies across lines.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import in_order
from .scan import LOWER, Words, per_document, text_buffer
from .shared import freed, keyed, small_batches, tidy, written

#: The separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
BUCKETS = 10000  # most rows of the table of gains, which every task holds
POLYNOMIAL = 0xEDB88320  # of crc32, bits reversed

BYTE_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    BYTE_CRC = np.where(BYTE_CRC & 1, (BYTE_CRC >> 1) ^ np.uint32(POLYNOMIAL), BYTE_CRC >> 1).astype(np.uint32)
#: By k: for each byte of a register, what the register becomes after 2**k zero bytes. Registers are linear, so the four are combined by xor.
_shifts: list[np.ndarray] = []


def shift_table(k: int) -> np.ndarray:
    while len(_shifts) <= k:
        if _shifts:
            half = _shifts[-1]
            _shifts.append(np.stack([_shifted(half, half[i]) for i in range(4)]))
        else:
            register = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
            _shifts.append(BYTE_CRC[register & 255] ^ (register >> 8))
    return _shifts[k]


def _shifted(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def crc_of_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 of raw[start:end] for every span. All spans take a byte in a step; the few longest take theirs at the end, one by one."""
    size = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    live, at = np.arange(len(start)), 0
    while len(live := live[size[live] > at]):
        if len(live) < 16 and at >= 64:
            for i in live:
                crc[i] = zlib.crc32(raw[start[i] + at : end[i]].tobytes(), int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        c = crc[live]
        crc[live] = BYTE_CRC[(c ^ raw[start[live] + at]) & 255] ^ (c >> 8)
        at += 1
    return ~crc


def crc_of_pairs(left: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """The crc32 of left, a space and right, from those of left and right: left's register is moved on by right's length."""
    c = ~left
    moved = ~(BYTE_CRC[(c ^ 0x20) & 255] ^ (c >> 8))
    k = 0
    while len(todo := np.flatnonzero(right_size >> k)):
        hit = todo[(right_size[todo] >> k) & 1 == 1]
        moved[hit] = _shifted(shift_table(k), moved[hit])
        k += 1
    return moved ^ right


def batch_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Different lines of texts: their bytes in lower case and offsets, each text's lines (as numbers), and the bounds of texts among these."""
    raw, offsets = text_buffer(column)
    lower = LOWER[raw].tobytes()
    texts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(lower)])
    lists = pc.split_pattern(texts, b"\n")
    coded = lists.flatten().dictionary_encode()
    own, at = text_buffer(coded.dictionary)
    return own, at, coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


class Lines:
    """Different lines, their words, and the buckets of the features inside them (bucket, line)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, inner: bool = True):
        words = Words(raw, offsets, APART)
        self.first, self.n_words = words.first, np.diff(words.first)
        start, end, self.line = words.start, words.end, words.doc
        if not inner:  # only the first and the last word of each line
            some = self.n_words > 0
            pick = np.unique(np.concatenate([self.first[:-1][some], self.first[1:][some] - 1]))
            start, end = start[pick], end[pick]
            self.first = np.searchsorted(pick, self.first)
        self.crc, self.size = crc_of_spans(raw, start, end), end - start
        if inner:
            two = np.flatnonzero(self.line[1:] == self.line[:-1]) if len(self.line) else np.zeros(0, np.int64)
            pair = crc_of_pairs(self.crc[two], self.crc[two + 1], self.size[two + 1])
            self.bucket = (np.concatenate([self.crc, pair]) % BUCKETS).astype(np.int64)
            self.owner = np.concatenate([self.line, self.line[two]])

    def across(self, lines: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of pairs of words across lines, and the text of each. Lines without words lie between, and don't separate."""
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        some = self.n_words[lines] > 0
        lines, text = lines[some], text[some]
        two = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
        left, right = self.first[lines[two] + 1] - 1, self.first[lines[two + 1]]
        return (crc_of_pairs(self.crc[left], self.crc[right], self.size[right]) % BUCKETS).astype(np.int64), text[two]


def parts(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text, one row at least."""
    _, offsets = text_buffer(batch.column(column))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: how often features of `texts` (text) fall into each bucket; buckets without features have no row."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            raw, offsets, lines, bounds = batch_lines(whole.column("text"))
            own = Lines(raw, offsets, inner=False)
            bucket, _ = own.across(lines, bounds)
            across += np.bincount(bucket, minlength=BUCKETS)
            times = np.bincount(lines, minlength=len(offsets) - 1)
            keep = np.flatnonzero(own.n_words)
            lists = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([lists.take(pa.array(keep)), pa.nulls(len(keep), pa.int32()), pa.array(times[keep])], ["line", "bucket", "n"])
        hit = np.flatnonzero(across)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(hit), pa.binary()), pa.array(hit.astype(np.int32)), pa.array(across[hit])], ["line", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            is_line = pc.is_null(batch.column("bucket"))
            rest = batch.filter(pc.invert(is_line))
            np.add.at(sums, rest.column("bucket").to_numpy(), rest.column("n").to_numpy())
            for block in parts(batch.filter(is_line), "line"):
                own = Lines(*text_buffer(block.column("line")))
                times = block.column("n").to_numpy()[own.owner]
                # Weights are doubles in bincount: exact below 2**53, beyond which a sum of one block does not come.
                sums += np.bincount(own.bucket, times, BUCKETS).astype(np.int64)
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(sums[hit])], ["bucket", "n"])

    lines = texts.select("text").mapInArrow(freed(segments), "line binary, bucket int, n long").groupBy("line", "bucket").agg(F.sum("n").alias("n"))
    return lines.select("line", "bucket", "n").mapInArrow(freed(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """Per bucket, floor(1000 * ln of how much likelier a feature is in the target), with one count added to each bucket."""
    counts = []
    for texts in (corpus, target):
        n = np.zeros(BUCKETS, np.int64)
        for r in bucket_counts(texts).collect():  # at most BUCKETS rows
            n[r.bucket] = r.n
        counts.append(n.tolist())
    s, t = counts
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (all_s + BUCKETS) / ((a + 1.0) * (all_t + BUCKETS)))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, rk_f, rk_r, n_words, n_features, weight of keyed rows: the floored mean of gains over a document's features (none: 0)."""
    kept = [f"{n} {t}" for n, t in docs.select("doc_id", "rk_f", "rk_r").dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raw, offsets, lines, bounds = batch_lines(whole.column("text"))
            own = Lines(raw, offsets)
            inner = np.zeros(len(offsets) - 1, np.int64)
            np.add.at(inner, own.owner, table[own.bucket])
            bucket, text = own.across(lines, bounds)
            total = per_document(inner[lines], bounds)
            np.add.at(total, text, table[bucket])
            words = per_document(own.n_words[lines], bounds)
            features = np.maximum(2 * words - 1, 0)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([*(whole.column(c) for c in ("doc_id", "rk_f", "rk_r")), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "rk_f", "rk_r", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "rk_f", "rk_r", "text").mapInArrow(freed(run), ", ".join([*kept, "n_words long, n_features long, weight long"]))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: per row of `docs`, how near it is to `target` and, if it is drawn, its place in the draw.

    Of the documents with enough words, `percent` (rounded down) are drawn without replacement, as likely as their weights say: a Gumbel number from
    a hash of seed and doc_id is added to each weight, and the highest go. Ties go to the smaller doc_id. A null text has no features and
    weight 0; a null doc_id is hashed as an empty one, and comes before others in ties; repeated rows each take part. No rows give no rows.
    An empty target makes every gain follow the corpus alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with tidy(spark):
        table = gains(docs, target)
        rows = weigh(keyed(docs, "doc_id", "text"), table)
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
        rows = written(rows.withColumn("score", F.col("weight") + noise).withColumn("all", F.lit(0)), "weights")
        enough = rows.where(F.col("n_words") >= least_words)
        ranked = in_order(enough, "all", F.desc("score"), F.asc("doc_id"), F.asc("rk_f"), F.asc("rk_r"))
        drawn = ranked.withColumn("rank", F.when(F.col("place") < F.expr(f"total * {percent} div 100"), F.col("place") + 1))
        columns = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
        rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
        return drawn.select(*columns).unionByName(rest.select(*columns))
