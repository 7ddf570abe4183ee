"""Scores against a scorer in plain Python over the fitted weights; where a text stands in a batch must not matter."""

import math

import numpy as np
import pytest
from corpus import awkward, frame
from test_toxicity import LABELS, corpus

from stowage.llm import scan, toxicity

SMALL = "/root/testdata/sf0.001"
MASK = 2**64 - 1


def mix(x):
    x = (x ^ (x >> 31)) * 0x7FB5D329728EA185 & MASK
    x = (x ^ (x >> 27)) * 0x81DADEF4BC2DD44D & MASK
    return x ^ (x >> 33)


def buckets(text):
    """Distinct buckets of the 5- and 7-byte strings of a text whose gaps are single, with a gap at either end."""
    folded = [toxicity.FOLD[c] for c in (text or "").encode()]
    line = [0x20]
    for c in [*folded, 0x20]:
        if c != 0x20 or line[-1] != 0x20:
            line.append(int(c))
    values = [int(v) for v in scan.BYTE_VALUE[0]]
    out = set()
    for size in (5, 7):
        for p in range(len(line) - size + 1):
            h = 0
            for c in line[p : p + size]:
                h = (h * 0x9E3779B97F4A7C15 + values[c]) & MASK
            out.add(mix((h + size) & MASK) >> 44)
    return out


def brute(text, weights, bias):
    f = sum(float(weights[b]) for b in sorted(buckets(text))) + bias
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, f))))


def compare(spark, docs, labels):
    weights, bias = toxicity.train(docs, labels)
    want = sorted((r.doc_id is None, r.doc_id or 0, brute(r.text, weights, bias)) for r in docs.select("doc_id", "text").collect())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in toxicity.score_documents(docs, labels).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-5)
    return weights


def test_scores_of_a_small_table(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{x}.parquet") for x in ("documents", "labels"))
    compare(spark, docs, labels)


def test_scores_of_awkward_rows(spark):
    rows, labels, _ = corpus(300)
    rows = rows + [(1000 + n, *r[1:]) for n, r in enumerate(awkward())] + [(2000, "rotten fool " * 100_000, None, None, None, None, None)]
    weights = compare(spark, frame(spark, rows), spark.createDataFrame(labels, LABELS))
    assert (weights != 0).sum() > 10


@pytest.mark.parametrize("texts", [["idiot", "idiot", "an idiot"], ["", "rotten", "", "rotten"], ["fool!", " fool"]])
def test_a_texts_place_in_the_batch_does_not_matter(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    doc, bucket = toxicity.features(raw, offsets)
    for i, text in enumerate(texts):
        assert set(bucket[doc == i].tolist()) == buckets(text)
