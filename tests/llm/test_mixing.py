"""Entropy balancing: targets against the rule, tilts against the dual's optimum, copies against targets."""

import math
import re
from collections import Counter, defaultdict

import pytest
from corpus import WORD, awkward, frame

from stowage.llm import mixing

SMALL = "/root/testdata/sf0.001"


def size(text):
    return len(WORD.findall(text or ""))


def brute_targets(sizes, most=3):
    """sizes: source -> words. What is over a limit is shared by weight among the others, again and again."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: i % 3 + 1 for i, x in enumerate(names)}
    total, at_limit = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[x] for x in at_limit)
        open_ = sum(weight[x] for x in names if x not in at_limit)
        target = {x: most * sizes[x] if x in at_limit else rest * weight[x] / open_ for x in names}
        over = {x for x in names if x not in at_limit and target[x] >= most * sizes[x]}
        if not over:
            return target
        at_limit |= over


def check(rows, out, most=3, room=0.5):
    """rows: (doc_id, source, text); out: rows of mix()."""
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += size(text)
    targets = brute_targets(sizes, most) if any(sizes.values()) else dict.fromkeys(sizes, 0)
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, size(t)) for i, _, t in rows)
    assert all(0 <= r.copies <= most and r.taken == r.copies * r.size for r in out)
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r.source_size] += r.taken
        target[r.source_size] = target.get(r.source_size, r.target)
    for source, words in sizes.items():
        if list(sizes.values()).count(words) == 1:
            assert target[words] == pytest.approx(targets[source])
            longest = max(size(t) for _, s, t in rows if s == source)
            assert abs(taken[words] - targets[source]) <= max(1, room * longest), (source, taken[words], targets[source])


def test_awkward_rows(spark):
    rows = [(r[0], r[3], r[1]) for r in awkward()]
    check(rows, mixing.mix(frame(spark)).collect())
    assert mixing.mix(frame(spark, [])).count() == 0


def test_small_table_and_reruns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = mixing.mix(docs).collect()
    check([(r.doc_id, r.source, r.text) for r in docs.collect()], out)
    again = mixing.mix(docs.repartition(3).select(*reversed(docs.columns))).collect()
    assert Counter(out) == Counter(again)


def test_targets_stop_at_the_limit(spark):
    """One source holds nearly all words, so the others stop at three times their own, and it takes what is left."""
    rows = [(i, "w " * (20 + i % 7), None, "abcd"[max(0, i % 40 - 36)], None, None, None) for i in range(400)] + [(1000 + i, "", None, "empty", None, None, None) for i in range(5)]
    out = mixing.mix(frame(spark, rows)).collect()
    check([(r[0], r[3], r[1]) for r in rows], out)
    full = [r for r in out if r.source_size and r.target == 3 * r.source_size]
    assert full and all(r.copies == 3 for r in full)


def test_words_are_counted_natively(spark):
    texts = [t for _, t, *_ in awkward()] + ["  a b", " lead", "trail ", "\x0b", "x" * 3_000_000 + " y"]
    got = frame(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]).select("doc_id", mixing.n_words("text").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_rates_solve_the_dual(spark):
    """Newton's tilts give every source its words, at rates exp(tilt * size / mean) up to the limit."""
    counts = {"0a": {1: 400, 7: 30, 300: 2}, "0b": {5: 10, 6: 10, 5000: 1}, "1": {40: 3}}
    cells = spark.createDataFrame([(k, s, m) for k, c in counts.items() for s, m in c.items()], "key string, size long, m long")
    stats = {k: (sum(s * m for s, m in c.items()), sum(c.values()), min(c)) for k, c in counts.items()}
    ratio = {"0a": 0.37, "0b": 2.9, "1": 1.7}
    sources = spark.createDataFrame([(k, w, w / n, least, ratio[k] * w, 3.0 * w) for k, (w, n, least) in stats.items()], "key string, source_size long, mean double, least long, target double, `limit` double")
    for r in mixing.solve(cells, sources, 3).collect():
        assert r.done
        got = sum(m * s * min(3.0, math.exp(r.tilt * s / r.mean)) for s, m in counts[r.key].items())
        assert got == pytest.approx(r.target, abs=0.6)


def test_a_source_of_one_size(spark):
    """A third of all rows are copies: the odd copies are dealt by hash, exactly as many as are missing."""
    rows = [(i, "four words are here", None, "a", None, None, None) for i in range(300)] + [(1000 + i, "w " * (1 + i % 9), None, "b", None, None, None) for i in range(600)]
    out = mixing.mix(frame(spark, rows)).collect()
    check([(r[0], r[3], r[1]) for r in rows], out, room=1)
    assert len({r.copies for r in out if r.source_size == 1200}) <= 2
