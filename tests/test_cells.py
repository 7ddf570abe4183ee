"""Cells and ordered analyses in ranges of any length, runs of one address, quantiles by digits."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stowage.operators import cells, ordered, ranges, second_stage, stores

SCHEMA = "run_id string, bench string, alloc_addr long, alloc_size long, alloc_type string, generation long, alloc_stack string, offset long, value long, rn long"
ANALYSES = {
    "c02": stores.top_allocations, "c08": stores.coverage, "c09": ordered.silent_stores, "c14": ordered.mx_feasibility, "c17": ordered.intra_buffer_gini,
    "c18": ordered.hot_offsets, "c19": ordered.mx_block_sweep, "c20": ordered.spatial_delta, "c22": stores.bdi_compression,
    "c28": ordered.mx_scale_sharing, "c31": ordered.cacheline_homogeneity, "c35": ordered.buffer_silent,
}


def rows(n=3000, seed=1):
    """Two runs that share buffers; one cell takes most stores of its buffer; ties of rn with other values."""
    rng, out = random.Random(seed), []
    for i in range(n):
        run, at, generation = f"r{i % 2}", rng.randint(1, 3), rng.randint(1, 2)
        kind = ("64bits", "32bits", "object")[at - 1]
        offset = 0 if rng.random() < 0.6 else 8 * rng.randint(0, 20)
        value = rng.choice((0, 1, 0x3FE3333333333333, 0x4010000000000000)) if kind != "32bits" else rng.choice((0, 0x3F800000, 0x40490FDB))
        out.append((run, "b", 4096 * at, 256, kind, generation, f"   at 0x1: malloc (m.c:1)\n   by 0x2: f{at} (a.c:1)", offset, value, i // 2 // 2))
    return out


def brute(stored):
    held = defaultdict(list)
    for run, bench, addr, _, kind, generation, _, offset, value, rn in stored:
        held[run, bench, addr, generation, offset, kind].append((rn, value))
    out = []
    for key, own in held.items():
        own.sort()
        pairs = list(zip(own, own[1:], strict=False))
        out.append((*key[:5], len(own), len(pairs), sum(a[1] == b[1] for a, b in pairs), own[-1][1], own[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("bits", [0, 3, 7, 20])
def test_cells_in_ranges(spark, bits):
    stored = rows()
    got = cells.cells(spark.createDataFrame(stored, SCHEMA), bits).select(*cells.CELL, "writes", "pairs", "silent", "last", "last_rn")
    assert sorted(map(tuple, got.collect())) == brute(stored)


def test_a_hot_cell_is_many_groups(spark):
    """Nine tenths of the stores hit one cell; no group of the ordered work holds more than a range."""
    stored = [("r", "b", 4096, 64, "64bits", 1, "", 0 if i % 10 else 8, i % 3, i) for i in range(4000)]
    t = spark.createDataFrame(stored, SCHEMA)
    largest = t.groupBy(*cells.CELL, F.shiftright("rn", 6)).count().agg(F.max("count")).first()[0]
    assert largest <= 64
    assert sorted(map(tuple, cells.cells(t, 6).select(*cells.CELL, "writes", "pairs", "silent", "last", "last_rn").collect())) == brute(stored)


def test_analyses_of_the_table_of_cells(spark, tmp_path):
    t = spark.createDataFrame(rows(), SCHEMA)
    table = cells.write_cells(t, str(tmp_path / "cells"), 5)
    for name, run in ANALYSES.items():
        one, two = run(t), run(table)
        assert sorted(map(str, one.select(sorted(one.columns)).collect())) == sorted(map(str, two.select(sorted(one.columns)).collect())), name
    stacks = ordered.stacks_of_buffers(t)
    for run in (lambda x, s: ordered.site_silent(x, min_pairs=1, stacks=s), lambda x, s: ordered.exponent_stability(x, least=1, stacks=s)):
        got = sorted(map(tuple, run(table, stacks).collect()))
        assert got and got == sorted(map(tuple, run(t, None).collect()))


def test_runs_of_one_address_stay_apart(spark):
    """Two runs with one buffer each at the same place."""
    stored = [(run, "b", 4096, 64, "64bits", 1, f"   by 0x2: {run} (a.c:1)", 8 * (i % 2), 0x4010000000000000, i) for run in ("r0", "r1") for i in range(6)]
    t = spark.createDataFrame(stored, SCHEMA)
    zoom = ordered.zoom_silent(t, "b").collect()
    assert sorted((r.run_id, r.site, r.pairs, r.silent, r.bench_silent_frac) for r in zoom) == [("r0", "r0", 4, 4, 1.0), ("r1", "r1", 4, 4, 1.0)]
    assert sorted((r.run_id, r.total) for r in ordered.zoom_feasibility(t, "b").collect()) == [("r0", 6), ("r1", 6)]
    both = second_stage.convertible_buffers(stores.buffer_feasibility(t), stores.buffer_exp_range(t)).collect()
    assert [(r.verdict, r.buffers, r.stores) for r in both] == [("convertible", 2, 12)]


def test_residual_of_a_type_counts_its_own_classes(spark):
    kinds = [("64bits", 0x7FF0000000000000), ("64bits", 0), ("64bits", 1), ("32bits", 0x7F800000), ("32bits", 0), ("32bits", 0x100000000), ("object", 5)]
    t = spark.createDataFrame([("r", "b", 4096, 64, kind, 1, "", 0, v, i) for i, (kind, v) in enumerate(kinds)], SCHEMA)
    got = {r.alloc_type: r.other for r in second_stage.residual_class_share(stores.exponent_classes(t)).collect()}
    assert got == {"64bits": 0.0, "32bits": 0.33333333}  # bits above a 32-bit store are of no class


def test_exponent_widths_per_type(spark):
    sites = spark.createDataFrame([("64bits", 4, 10), ("64bits", 6, 30), ("64bits", 11, 60), ("32bits", 5, 7)], "alloc_type string, required_e_bits long, total long")
    assert sorted(map(tuple, second_stage.exp_bits_histogram(sites).collect())) == [("32bits", 5, 7, 1.0), ("64bits", 4, 10, 0.1), ("64bits", 6, 30, 0.4), ("64bits", 11, 60, 1.0)]
    assert sorted(map(tuple, second_stage.exp_bits_shares(sites).collect())) == [("32bits", 7, 0.0, 1.0, 1.0, 1.0), ("64bits", 100, 0.1, 0.1, 0.4, 1.0)]


def test_exact_quantile(spark):
    rng = random.Random(3)
    values = {"a": [rng.randrange(2**63) for _ in range(700)], "b": [5] * 40, "c": [2**63 - 1, 0], "d": [rng.randrange(2**31) for _ in range(999)] + [2**42] * 3, "e": [7]}
    df = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k string, x long")
    for q in (0.0, 0.5, 0.999, 1.0):
        got = {r.k: (r.edge_value, r.below, r.total) for r in ordered.exact_quantile(df, ("k",), "x", q).withColumnRenamed("edge", "edge_value").collect()}
        for k, own in values.items():
            own = sorted(own)
            rank = max(1, -(-int(q * 1000) * len(own) // 1000))
            edge = own[rank - 1]
            assert got[k] == (edge, sum(v < edge for v in own), len(own)), (k, q)


def test_outlier_channels_exact_and_sketched(spark):
    rng = random.Random(4)
    stored = [("r", "b", 4096, 64, "64bits", 1, "   by 0x2: f (a.c:1)", 8 * rng.randint(0, 30), rng.randrange(1, 2**62), i) for i in range(3000)]
    t = spark.createDataFrame(stored, SCHEMA)
    edge = sorted(r[8] for r in stored)[-(3000 - 2997) - 1]
    (row,) = ordered.outlier_channels(t).collect()
    out = [r for r in stored if r[8] >= edge]
    assert (row.total, row.n_outlier_999, row.distinct_offsets, row.outlier_offsets) == (3000, len(out), len({r[7] for r in stored}), len({r[7] for r in out}))
    (near,) = ordered.outlier_channels(t, exact=False).collect()
    assert near.total == 3000 and abs(near.n_outlier_999 - row.n_outlier_999) <= 1


def test_running_latest_and_previous_in_ranges(spark):
    rng = random.Random(5)
    data = [(f"k{i % 3}", i, rng.randint(1, 9)) for i in rng.sample(range(500), 300)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    marks = spark.createDataFrame([("k0", 5, 1), ("k0", 200, 2), ("k1", 450, 3)], "k string, i long, m long")
    for bits in (0, 4, 20):
        sums, last = {}, defaultdict(int)
        for k, i, v in sorted(data, key=lambda x: x[1]):
            last[k] += v
            sums[k, i] = last[k]
        assert {(r.k, r.i): r.s for r in ranges.running(df, ("k",), ("i",), bits, s=F.col("v")).collect()} == sums
        want = {(k, i): max(((a, m) for c, a, m in [("k0", 5, 1), ("k0", 200, 2), ("k1", 450, 3)] if c == k and a < i), default=(0, None))[1] for k, i, _ in data}
        assert {(r.k, r.i): r.m for r in ranges.latest_of(df, marks, ("k",), "i", "m", bits).collect()} == want
        before = {}
        for k, i, v in sorted(data, key=lambda x: x[1]):
            sums[k, i] = before.get(k)
            before[k] = v
        assert {(r.k, r.i): r.p for r in ranges.previous(df, ("k",), ("i",), "v", "p", bits).collect()} == sums
