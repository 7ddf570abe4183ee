"""Importance resampling against a brute force that counts every feature of every text."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import awkward, frame

from stowage.llm import resampling

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def buckets(texts):
    return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t))


def brute(docs, target):
    s, t = buckets(x for _, x in docs), buckets(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((-r[3], r[0] is not None, r[0] or 0, n) for n, r in enumerate(rows) if len(words(docs[n][1])) >= 20)
    rank = {n: k + 1 for k, (*_, n) in enumerate(enough[: 25 * len(enough) // 100])}
    return rows, rank


def compare(docs, target, out):
    rows, rank = brute(docs, target)
    got = Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score")) for r in out)
    assert got == Counter(map(tuple, rows))
    by_rank = {r["rank"]: (r.doc_id, r.score) for r in out if r["rank"] is not None}
    assert by_rank == {k: (rows[n][0], rows[n][3]) for n, k in rank.items()}


def test_small_table(spark):
    docs, target = (spark.read.parquet(f"{SMALL}/{x}.parquet") for x in ("documents", "benchmark"))
    compare([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], resampling.resample(docs, target).collect())


def test_awkward_rows(spark):
    rows = [r[:2] for r in awkward()] + [(50, "Same line\nsame LINE\n\n ... \nsame line"), (51, "é1\r\nb\x00c" * 30), (52, "w\n" * 50), (53, "ab " * 1_000_000), (54, "z" * 2_000_000 + " q\nq")]
    docs = frame(spark, [(*r, None, None, None, None, None) for r in rows])
    target = spark.createDataFrame([(1, None), (2, ""), (3, "alpha1 beta1\ngamma1 alpha2"), (3, "alpha1 beta1")], "item_id long, text string")
    compare(rows, [r.text for r in target.collect()], resampling.resample(docs, target).collect())
    empty = target.where("item_id > 9")
    compare(rows, [], resampling.resample(docs, empty).collect())
    assert resampling.resample(frame(spark, []), target).count() == 0


def test_lines_are_counted_by_their_occurrences(spark):
    """A line in every document, over several partitions: its features count once for each place it stands at."""
    rows = [(i, f"shared line of words\nown{i % 5} text {i}\n\nshared line of words") for i in range(300)]
    docs = frame(spark, [(*r, None, None, None, None, None) for r in rows]).repartition(5)
    got = {r.bucket: r.n for r in resampling.bucket_counts(docs).collect()}
    assert got == buckets(t for _, t in rows)


@pytest.mark.parametrize("longest", [1, 9, 300])
def test_crc_of_spans_and_pairs(longest):
    rng = random.Random(longest)
    spans = [bytes(rng.randrange(256) for _ in range(rng.randint(0, longest))) for _ in range(200)]
    raw = np.frombuffer(b"".join(spans), np.uint8)
    end = np.cumsum([len(x) for x in spans])
    start = end - [len(x) for x in spans]
    crc = resampling.crc_of_spans(raw, start, end)
    assert crc.tolist() == [zlib.crc32(x) for x in spans]
    pair = resampling.crc_of_pairs(crc[:-1], crc[1:], (end - start)[1:])
    assert pair.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(spans, spans[1:], strict=False)]
