"""Top-k search against brute force: ties, repeated rows and ids, unusable and short vectors; and how much of the work MaxScore leaves out."""

from collections import Counter

import numpy as np

from stowage.llm import topk

SCHEMA = "vec_id long, embedding array<double>, v string, rk_f int"


def answers(spark, rows, k=5, every=50):
    vectors = topk.integer_vectors(spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA), "vec_id", "embedding", 256)
    return Counter(tuple(r) for r in topk.top_k(vectors, vectors.where(f"vec_id % {every} = 0"), k).collect())


def brute(rows, k=5, every=50):
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, q) in enumerate(usable):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j) for b, (j, v) in enumerate(usable) if b != a)
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1))
    return out


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.5]), (50, [1.0, 2.0]), (50, [1.0, -2.0]), (50, [1.0, 2.0]), (1, [0.25, 1.0]), (2, [0.25, 1.0]), (3, [-1.0]), (4, []), (100, []), (150, [0.0, 0.0])]
    rows += [(None, [1.0, 1.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (-50, [-0.001, 3.0])]
    assert answers(spark, rows) == brute(rows)
    assert answers(spark, rows, k=30) == brute(rows, k=30)
    assert not answers(spark, [])
    assert not answers(spark, [(1, [1.0]), (2, [2.0])])
    assert not answers(spark, [(50, [1.0])])


def test_many_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.round(v, 1)]) for i, v in zip(rng.integers(0, 400, 900), rng.normal(size=(900, 6)), strict=True)]
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "SAMPLE", 20)
    assert answers(spark, rows, every=20) == brute(rows, every=20)


def test_like_vectors_are_mostly_left_out():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32)) * 200
    vectors = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 20)
    keys = np.arange(4000), np.zeros(4000, int), np.arange(4000)
    asked, own = vectors[::100], tuple(x[::100] for x in keys)
    best = topk.Best(len(asked), 5)
    scored = topk.search_shard(asked, own, vectors, keys, best)
    assert scored < 0.1 * len(asked) * len(vectors)
    score = asked @ vectors.T
    score[np.arange(len(asked)), own[2]] = -np.inf
    for q in range(len(asked)):
        order = np.lexsort((keys[0], -score[q]))[:5]
        assert best.found[q] == [(-score[q, j], j) for j in order]
