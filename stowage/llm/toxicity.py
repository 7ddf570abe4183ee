"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts and unlabelled ones only; a label that says "not toxic" is not used as a negative,
it only helps to estimate the class prior. The risk of the negative class is estimated on unlabelled texts less the
prior's share of the confirmed ones, and held at zero or above, so that a flexible model cannot drive it below. A linear
model over byte n-grams is fitted in numpy on a bounded sample (`most_positive`, `most_unlabelled`); every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import drop_written, freed, written

BUCKETS = 1 << 20
SIZES = (5, 7)
FEATURES = 4096  # most features of a model
EVIDENCE = 12.0  # least log-likelihood ratio of a feature

#: Letters stay, lower-cased; everything else in ASCII is a gap. Bytes of other characters stay.
FOLD = np.full(256, 0x20, np.uint8)
for _c in range(256):
    if _c >= 0x80 or chr(_c).isalpha():
        FOLD[_c] = _c + 32 if 0x41 <= _c <= 0x5A else _c


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the n-grams of each text, a gap before and after; with repeats."""
    n = len(offsets) - 1
    text = np.full(len(raw) + 2 * n + 8, 0x20, np.uint8)
    shift = 2 * np.arange(n) + 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    text[np.arange(len(raw)) + shift[of]] = FOLD[raw]
    gap = text == 0x20
    keep = np.append(True, ~(gap[1:] & gap[:-1]))  # gaps of any length are one,
    keep[offsets[:-1] + 2 * np.arange(n)] = True  # but never across texts: each begins with its own
    bounds = np.searchsorted(np.flatnonzero(keep), offsets + 2 * np.arange(n + 1))
    text = text[keep]
    docs, buckets = [], []
    for size in SIZES:
        h = np.zeros(max(0, len(text) - size + 1), scan.U)
        for i in range(size):
            h = h * scan.U(0x9E3779B97F4A7C15) + scan.BYTE_VALUE[0][text[i : i + len(h)]]
        doc = np.searchsorted(bounds, np.arange(len(h)), "right") - 1
        ok = (doc < n) & (np.arange(len(h)) + size <= np.append(bounds[1:], 0)[np.minimum(doc, n)])
        docs.append(doc[ok])
        buckets.append((scan.mix(h[ok] + scan.U(size)) >> scan.U(44)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(buckets)


def distinct(doc: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc * n + feature)
    return both // n, both % n


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learned from; rows without an id carry no label and are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def evidence(pos: np.ndarray, n_pos: int, unl: np.ndarray, n_unl: int) -> np.ndarray:
    """Log-likelihood ratio of "commoner among the confirmed texts" for each feature (0 where it is rarer)."""
    p, u = pos / max(n_pos, 1), unl / max(n_unl, 1)
    both = (pos + unl) / max(n_pos + n_unl, 1)

    def ll(k, n, q):
        q = np.clip(q, 1e-9, 1 - 1e-9)
        return k * np.log(q) + (n - k) * np.log(1 - q)

    return np.where(p > u, ll(pos, n_pos, p) + ll(unl, n_unl, u) - ll(pos, n_pos, both) - ll(unl, n_unl, both), 0.0)


def document_frequencies(sample: DataFrame) -> DataFrame:
    """bucket, pos, unl: how many confirmed and unlabelled texts of the sample have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for rows, raw, offsets in scan.blocks(batch, "text"):
                doc, bucket = distinct(*features(raw, offsets), BUCKETS)
                y = rows.column("y").to_numpy()[doc]
                for k in (0, 1):
                    counts[k] += np.bincount(bucket[y == k], minlength=BUCKETS).astype(np.int32)
        at = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(at), 100_000):
            j = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(counts[1][j]), pa.array(counts[0][j])], ["bucket", "pos", "unl"])

    rows = sample.repartition(6).mapInArrow(freed(run), "bucket int, pos int, unl int")
    return rows.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))


def fit(x_doc: np.ndarray, x_feature: np.ndarray, y: np.ndarray, n_features: int, prior: float, rounds: int = 400, rate: float = 0.1, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by Adam on all of the sample.

    risk = prior * E+[l(f)] + max(0, Eu[l(-f)] - prior * E+[l(-f)]); where the second part is negative, the step goes
    against its gradient, which brings it back to zero.
    """
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    pos, n_pos, n_unl = y == 1, max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    for t in range(1, rounds + 1):
        f = np.bincount(x_doc, w[x_feature], minlength=len(y)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        loss = np.logaddexp(0, f)  # of the negative class
        negative = loss[~pos].sum() / n_unl - prior * loss[pos].sum() / n_pos
        g_negative = np.where(pos, -prior * p / n_pos, p / n_unl)
        g = np.where(pos, prior * (p - 1) / n_pos, 0.0) + g_negative if negative >= 0 else -g_negative
        grad = np.append(np.bincount(x_feature, g[x_doc], minlength=n_features), g.sum())
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    # The mean probability over the unlabelled texts is the prior by definition; the bias is set to make it so.
    f = np.bincount(x_doc, w[:-1][x_feature], minlength=len(y))[~pos]
    lo, hi = -30.0, 30.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if len(f) and (1 / (1 + np.exp(-np.clip(f + mid, -30, 30)))).mean() > prior else (mid, hi)
    return w[:-1], (lo + hi) / 2 if len(f) else float(w[-1])


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 8000, most_unlabelled: int = 16000) -> tuple[np.ndarray, float]:
    """Weight per bucket and bias, from rows that are not held out; without any confirmed toxic row, a constant score."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = ids.join(own, "doc_id", "left")
    n = known.agg(F.count("*").alias("all"), F.count("toxic").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    rate = (n["toxic"] + 0.5) / (n["labelled"] + 1)
    if not n["toxic"]:
        return np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate)))
    # Of the rows that are not confirmed toxic, those without a label hide toxic ones at the labelled rows' rate.
    hidden = (n["all"] - n["labelled"]) * rate
    prior = min(0.9, max(1e-4, hidden / max(1, n["all"] - n["toxic"])))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    y = F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))
    share = F.when(y == 1, most_positive / n["toxic"]).otherwise(most_unlabelled / max(1, n["all"] - n["toxic"]))
    chosen = known.select("doc_id", y.alias("y"), (chance < share).alias("in_sample")).where("in_sample").select("doc_id", "y").distinct()
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")  # most_positive + most_unlabelled ids, give or take
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    found = document_frequencies(sample).where("pos >= 3").orderBy(F.desc(F.col("pos") / max(1, size.get(1, 1)) - F.col("unl") / max(1, size.get(0, 1))), "bucket").limit(1 << 16).toArrow()
    pos, unl = (found.column(c).to_numpy().astype(float) for c in ("pos", "unl"))
    score = evidence(pos, size.get(1, 0), unl, size.get(0, 0))
    best = np.argsort(-score, kind="stable")[:FEATURES]
    buckets = np.sort(found.column("bucket").to_numpy()[best[score[best] >= EVIDENCE]].astype(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(buckets)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value))
        for batch in batches:
            for rows, raw, offsets in scan.blocks(batch, "text"):
                doc, feature = features(raw, offsets)
                feature = place[feature]
                doc, feature = distinct(doc[feature >= 0], feature[feature >= 0].astype(np.int64), BUCKETS)
                cut = np.searchsorted(doc, np.arange(len(rows) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("y"), pa.ListArray.from_arrays(pa.array(cut), pa.array(feature.astype(np.int32)))], ["y", "x"])

    table = sample.select("y", "text").mapInArrow(freed(extract), "y int, x array<int>").toArrow().combine_chunks()
    drop_written(sample)
    x = table.column("x").chunk(0) if len(table) else pa.array([], pa.list_(pa.int32()))
    lengths = np.diff(x.offsets.to_numpy()) if len(x) else np.zeros(0, int)
    w, bias = fit(np.repeat(np.arange(len(table)), lengths), x.flatten().to_numpy(), table.column("y").to_numpy(), len(buckets), prior)
    weights = np.zeros(BUCKETS, np.float32)
    weights[buckets] = w
    # Scores are for any text, not for the unlabelled rest: back to the labelled rows' rate.
    return weights, bias + float(np.log(rate / (1 - rate)) - np.log(prior / (1 - prior)))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_positive: int = 8000, most_unlabelled: int = 16000) -> DataFrame:
    """doc_id, held_out, score, predicted: per row of `docs`, in no order.

    A text's distinct features count once each, so its length does not matter; null and empty texts get the bias alone.
    Repeated labels of a doc_id count as toxic if one says so; null ids and labels teach nothing.
    """
    weights, bias = train(docs, labels, most_positive, most_unlabelled)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            for rows, raw, offsets in scan.blocks(batch, "text"):
                doc, feature = features(raw, offsets)
                some = weight[feature] != 0
                doc, feature = distinct(doc[some], feature[some], BUCKETS)
                f = np.bincount(doc, weight[feature], minlength=len(rows)) + bias
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(f, -30, 30))))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
