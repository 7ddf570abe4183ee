"""Toxicity: what is learned from, what is not, and the risk."""

import zlib

import numpy as np
import pytest
from corpus import awkward, frame

from stowage.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600):
    bad = lambda i: i % 6 == 0
    rows = [(i, f"{'you worthless rotten fool' if bad(i) else 'a calm note on the weather'} and text number {i} goes on", None, None, None, None, None) for i in range(n)]
    return rows, [(i, 1, int(bad(i))) for i in range(n) if i % 2 == 0 or i % 5 == 0], {i for i in range(n) if bad(i)}


def scores(spark, rows, labels):
    out = toxicity.score_documents(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    return {r.doc_id: r for r in out}, out


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_labels_are_not_read(spark):
    rows, labels, toxic = corpus()
    found, out = scores(spark, rows, labels)
    assert len(out) == len(rows) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    own = [i for i in found if held(i)]
    assert np.mean([found[i].predicted == (i in toxic) for i in own]) > 0.95
    other, _ = scores(spark, rows, [(i, q, 1 - t if held(i) else t) for i, q, t in labels])
    assert all(found[i].score == other[i].score for i in found)


def test_awkward_rows_and_labels(spark):
    rows, labels, _ = corpus(200)
    known = [r for r in awkward() if r[0] not in range(200)]
    out = scores(spark, rows + known + [(900, None, None, None, None, None, None), (901, "", None, None, None, None, None)], [*labels, (None, 1, 1), (3, 1, None), (0, 1, 1), (0, 1, 0)])[0]
    assert out[900].score == out[901].score and not np.isnan(out[900].score)
    assert toxicity.score_documents(frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0
    none = scores(spark, rows, [(i, q, 0) for i, q, _ in labels])[1]
    assert len({r.score for r in none}) == 1 and not any(r.predicted for r in none)


def test_the_risk_of_the_negative_class_stays_near_zero_or_above():
    rng = np.random.default_rng(2)
    y = np.repeat([1, 0], [60, 300])
    x = [(d, f) for d in range(360) for f in range(50) if rng.random() < (0.6 if (y[d] == 1 or d % 5 == 0) == (f < 25) else 0.1)]
    doc, feature = np.array(x).T
    w, bias = toxicity.fit(doc, feature, y, 50, 0.2)
    f = np.bincount(doc, w[feature], minlength=360) + bias
    loss = np.logaddexp(0, f)
    assert loss[y == 0].mean() - 0.2 * loss[y == 1].mean() > -0.05
    assert (1 / (1 + np.exp(-f[y == 0]))).mean() == pytest.approx(0.2, abs=0.01)
