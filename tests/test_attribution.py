"""Stores against their allocations: brute force, lifetimes of all lengths, no store multiplied."""

import random

import pytest

from stowage.sources import traces

ALLOCS = "run_id string, seq long, end_seq long, alloc_addr long, alloc_size long, generation long, alloc_stack string"
STORES = "run_id string, seq long, addr long, value long"


def brute(stores, allocs):
    out = {}
    for run, seq, addr, _ in stores:
        held = [a for a in allocs if a[0] == run and a[3] <= addr < a[3] + a[4] and a[1] < seq and (a[2] is None or seq < a[2])]
        if held:
            a = max(held, key=lambda x: x[1])
            out[run, seq] = (a[3], a[5], addr - a[3])
    return out


def attributed(spark, stores, allocs, **how):
    df = traces.attribute_stores(spark.createDataFrame(stores, STORES), spark.createDataFrame(allocs, ALLOCS), **how)
    return {(r.run_id, r.seq): (r.alloc_addr, r.generation, r.offset) for r in df.collect()}


def test_generations_at_one_address(spark):
    n = 1000
    allocs = [("r", 10 * i, 10 * i + 10 if i < n - 1 else None, 8192, 4096, i, "") for i in range(n)]
    allocs += [("r", 5, 9000, 1 << 30, 1 << 24, 1, ""), ("r", 7, None, 1 << 40, 8, 1, "")]
    stores = [("r", 10 * i + 5, 8192 + i, i) for i in range(n)] + [("r", 8999, (1 << 30) + 99, 1), ("r", 9000, (1 << 30) + 99, 1), ("r", 8, 1 << 40, 1), ("r", 6, 1 << 40, 1)]
    assert attributed(spark, stores, allocs) == brute(stores, allocs)


@pytest.mark.parametrize(("bits", "size"), [(20, 8), (3, 2), (6, 1)])
def test_random_traces(spark, bits, size):
    """Two runs of one file's addresses; blocks of a few bytes up to many pages, also overlapping ones; ranges and slices of a few events."""
    rng = random.Random(bits)
    allocs, stores = [], []
    for run in ("x/run", "y/run"):
        seqs = rng.sample(range(1, 4000), 1200)
        for i, seq in enumerate(sorted(seqs[:200])):
            end = None if rng.random() < 0.1 else seq + rng.choice((1, 5, 50, 900))
            allocs.append((run, seq, end, 4096 * rng.randint(1, 12) + 8 * rng.randint(0, 90), rng.choice((16, 4096, 9000, 70 * 4096)), i, ""))
        stores += [(run, seq, rng.randint(4000, 90 * 4096), seq) for seq in seqs[200:]]
    assert attributed(spark, stores, allocs, bits=bits, size=size) == brute(stores, allocs)


def test_lifetimes_of_eight_magnitudes_do_not_multiply_stores(spark):
    allocs, stores, seq = [], [], 0
    for power in range(8):
        for k in range(5):
            seq += 10
            allocs.append(("r", seq, seq + 10**power, 8192 * (8 * k + power + 1), 4096, k, ""))
    allocs.append(("r", 1, None, 1 << 30, 1 << 24, 1, ""))
    stores = [("r", s, 8192 * (1 + s % 41) + s % 4096, s) for s in range(3, 2003, 10)] + [("r", 2011, (1 << 30) + 5, 1)]
    rows = traces.placed(spark.createDataFrame(stores, STORES), spark.createDataFrame(allocs, ALLOCS)).groupBy("run_id", "seq").count()
    assert {r["count"] for r in rows.collect()} == {2}  # pages, and buckets of the one large block
    assert attributed(spark, stores, allocs) == brute(stores, allocs)


def test_a_page_of_many_short_blocks_beside_a_long_one(spark):
    """The long block is in every slice of the page, the short ones in one or two."""
    n = 500
    allocs = [("r", 0, None, 8192, 2048, 1, "")] + [("r", 10 * i + 1, 10 * i + 9, 8192 + 2048, 1024, i + 1, "") for i in range(n)]
    slices = traces.time_slices(spark.createDataFrame(allocs, ALLOCS)).collect()
    assert len(slices) == (n + 1 + 7) // 8 and all(len(r.live) <= 10 for r in slices)
    stores = [("r", 10 * i + 5, 8192 + (i % 3) * 1024, 1) for i in range(n)]
    assert attributed(spark, stores, allocs, bits=8) == brute(stores, allocs)


def test_nothing(spark):
    none = spark.createDataFrame([], ALLOCS)
    assert traces.attribute_stores(spark.createDataFrame([("r", 1, 5, 1)], STORES), none).count() == 0
    assert traces.attribute_stores(spark.createDataFrame([], STORES), none).count() == 0


def test_stores_of_a_run_do_not_meet_in_one_task(spark):
    """The kinds of buckets of a run come to the stores, whatever size Spark takes them to have."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        rows = traces.placed(spark.createDataFrame([("r", 5, 8192, 1)], STORES), spark.createDataFrame([("r", 1, None, 8192, 64, 1, "")], ALLOCS))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [tuple(r) for r in rows.collect()] == [("r", 5, 8192, 1, 12, 2)]
    finally:
        spark.conf.set(name, before)
