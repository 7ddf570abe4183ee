"""The tree of stack prefixes against plain sums, over more levels than one job takes."""

import random
from collections import defaultdict

import pytest

from stowage.operators import profiles

SCHEMA = "fs array<string>, tb long, tbk long"


def brute(points):
    sums, own = defaultdict(lambda: [0, 0]), set()
    for fs, *counts in points:
        for i in range(1, len(fs) + 1):
            for k, n in enumerate(counts):
                sums[tuple(fs[:i])][k] += n
        own.add(tuple(fs))
    return sums, own


def stacks(deepest, seed):
    rng = random.Random(seed)
    out = [([f"f{rng.randint(0, 1 + d // 3)}" for d in range(rng.randint(1, deepest))], rng.randint(0, 9), 1) for _ in range(60)]
    return out + out[:5]


@pytest.mark.parametrize("deepest", [1, 4, 20])
def test_sums_of_every_prefix(spark, deepest):
    points = stacks(deepest, deepest)
    sums, own = brute(points)
    got = {tuple(r.prefix): [r.tb, r.tbk] for r in profiles.heap_prefix_tree(spark.createDataFrame(points, SCHEMA), ["tb", "tbk"]).collect()}
    assert got == sums
    children = defaultdict(set)
    for prefix in sums:
        children[prefix[:-1]].add(prefix)
    radix = {p for p in sums if p in own or len(children[p]) != 1}
    small = profiles.heap_prefix_tree(spark.createDataFrame(points, SCHEMA), ["tb", "tbk"], compress=True).collect()
    assert {tuple(r.prefix) for r in small} == radix and all([r.tb, r.tbk] == sums[tuple(r.prefix)] for r in small)


def test_nothing_and_no_frames(spark):
    assert profiles.heap_prefix_tree(spark.createDataFrame([], SCHEMA), ["tb", "tbk"]).count() == 0
    got = profiles.heap_prefix_tree(spark.createDataFrame([([], 1, 1), (["a"], 2, 1)], SCHEMA), ["tb", "tbk"]).collect()
    assert [tuple(r) for r in got] == [(["a"], 2, 1)]


def test_a_level_has_no_more_rows_than_prefixes(spark):
    points = [(["root", f"a{i % 2}", f"b{i}"], 1, 1) for i in range(200)]
    df = spark.createDataFrame(points, SCHEMA)
    nodes = profiles.prefix_nodes(df.withColumn("hs", profiles.prefix_hashes("fs")))
    assert {r.depth: r["count"] for r in nodes.groupBy("depth").count().collect()} == {1: 1, 2: 2, 3: 200}
    assert all(t not in dict(nodes.dtypes).values() for t in ("array<string>",))
