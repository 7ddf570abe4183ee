import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpus import frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stowage.llm import packing, sharding

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 9)))
        room = rng.randint(0, 60)
        sums = {0}
        for k in counts.elements():
            sums |= {s + k for s in sums}
        got = packing.fullest(dict(counts), sorted(counts, reverse=True), room)
        assert all(got[k] <= counts[k] for k in got)
        assert sum(k * m for k, m in got.items()) == max(s for s in sums if s <= room)


def test_plan_uses_up_the_counts():
    rng = random.Random(2)
    counts = Counter(rng.randint(1, 1024) for _ in range(5000))
    bins = packing.plan_bins(dict(counts), 1024)
    used = Counter()
    for times, inside in bins:
        assert times > 0 and sum(k * m for k, m in inside.items()) <= 1024
        for k, m in inside.items():
            used[k] += times * m
    assert used == counts
    assert sum(t for t, _ in bins) <= 1.01 * sum(k * n for k, n in counts.items()) / 1024 + 1


@pytest.mark.parametrize("small", [False, True])
def test_pieces_hold_every_id_once(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet") if small else frame(spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, RANKS, public_tokenizers.PATTERN, with_ids=True, added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))).collect()
    expected = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cut = [0, *range(first, len(ids) + 1, 1024)]
        expected.update((r.doc_id, p, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())) for p, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / 1024 + 2


def test_packing_nothing(spark):
    assert packing.pack(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_hypergeometric_counts(spark):
    """Frequencies of the drawn counts against the exact distribution, also where the support is cut on either side."""
    from math import comb

    for g, b, d in ((7, 9, 5), (30, 3, 20), (2, 200, 50), (0, 5, 3), (5, 0, 3), (40, 60, 30)):
        n = 20000
        got = spark.range(n).select(sharding.hypergeometric(sharding.uniform(F.col("id")), F.lit(g), F.lit(b), F.lit(d)).alias("x")).groupBy("x").count().collect()
        seen = {r.x: r["count"] for r in got}
        chi = 0.0
        for x in range(max(0, d - b), min(g, d) + 1):
            e = n * comb(g, x) * comb(b, d - x) / comb(g + b, d)
            k = seen.pop(x, 0)
            chi += (k - e) ** 2 / e if e >= 5 else 0
        assert not seen and chi < 60, (g, b, d, seen, chi)


def test_shards_are_exact_and_uniform(spark, monkeypatch):
    rows = [(i % 40, "t" * (i % 3), None, None, None, None, None) for i in range(1003)]
    monkeypatch.setattr(sharding, "ROWS", 50)
    monkeypatch.setattr(sharding, "GROUP", 4)
    hits = Counter()
    for seed in range(3):
        out = sharding.uniform_shards(frame(spark, rows), 16, seed).collect()
        size = Counter(r.shard for r in out)
        assert len(out) == 1003 and set(size) == set(range(16)) and max(size.values()) - min(size.values()) <= 1
        for s in range(16):
            assert sorted(r.slot for r in out if r.shard == s) == list(range(size[s]))
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(t) + 1, zlib.crc32(t.encode())) for i, t, *_ in rows)
        hits.update((r.doc_id % 4, r.shard) for r in out)
    e = 3 * 1003 / 64
    assert sum((n - e) ** 2 / e for n in hits.values()) < 120  # 63 cells


def test_sharding_awkward_rows(spark):
    assert sharding.uniform_shards(frame(spark)).count() == frame(spark).count()
    assert sharding.uniform_shards(frame(spark, [])).count() == 0
