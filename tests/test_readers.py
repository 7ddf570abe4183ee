"""Readers against hand-written files, whole and cut into many splits; timelines in ranges."""

import contextlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from stowage.operators import profiles
from stowage.sources import profile_files, traces


@contextlib.contextmanager
def small_splits(spark, n=4096):
    names = {"spark.sql.files.maxPartitionBytes": str(n), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def log(n):
    """A log of n allocations with stacks, stores and frees, and its events (seq, kind, addr, block) by a plain loop."""
    rng, out, want = random.Random(4), [], []
    put = lambda line: out.append(line) or len(out)
    for i in range(n):
        at = 0x10000 * (i + 1)
        block = put("===ALLOC START===")
        want.append((put(f"Start 0x{at:x}, size 8192"), "ALLOC", at, block))
        want += [(put(f"   by 0x{j}: f{rng.randrange(9)} (a.c:{j})"), "FRAME", None, block) for j in range(rng.randint(0, 5))]
        end = put("===ALLOC END===")
        want += [(put(f"0x{at + 8 * j:x} 0x{j:x}"), "STORE", at + 8 * j, end) for j in range(rng.randint(0, 9))]
        put("junk")
        if i % 3 == 0:
            block = put("===FREE START===")
            want.append((put(f"Start 0x{at:x}, size 8192"), "FREE", at, block))
            put("===FREE END===")
    return "\n".join(out) + "\n", sorted(want)


def test_log_in_splits(spark, tmp_path):
    text, want = log(400)
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text(text)
    with small_splits(spark):
        df = traces.read_trace_log(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = df.select("run_id", "seq", "kind", "addr", "block").collect()
    for run in ("a.log", "b.log"):
        assert sorted(tuple(r)[1:] for r in got if r.run_id == run) == want


def test_memory_references_in_splits(spark, tmp_path):
    lines = [f" {'ILSM'[i % 4]} {0x1000 + i:x},{1 + i % 8}" if i % 5 else "==1== text" for i in range(2000)]
    (tmp_path / "m.txt").write_text("\n".join(lines))
    with small_splits(spark):
        got = sorted(tuple(r)[1:] for r in traces.parse_mem_reference_trace(spark, str(tmp_path / "m.txt")).collect())
    assert got == [(i + 1, "ILSM"[i % 4], 0x1000 + i, 1 + i % 8) for i in range(2000) if i % 5]


def test_site_listing(spark, tmp_path):
    (tmp_path / "s.txt").write_text("MXSITE 0x10 f 4\nMXSITE 0x10 f 8\nother\nMXSITE 0xffffffffffffffff g 2\n")
    assert sorted(map(tuple, traces.parse_site_listing(spark, str(tmp_path / "s.txt")).collect())) == [(-1, "g", 2), (16, "f", 12)]


def test_stale_sources(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("x")
    seen = traces.stale_sources(spark, str(tmp_path), None)
    rows = seen.collect()
    assert len(rows) == 2
    manifest = spark.createDataFrame([(r.path, r.modified) for r in rows], seen.schema)
    assert traces.stale_sources(spark, str(tmp_path), manifest).count() == 0
    assert traces.stale_sources(spark, str(tmp_path), manifest, force=True).count() == 2
    old = manifest.withColumn("modified", F.when(F.col("path").like("%/a"), F.timestamp_seconds(F.lit(time.time() - 3600))).otherwise(F.col("modified")))
    assert [r.path[-2:] for r in traces.stale_sources(spark, str(tmp_path), old).collect()] == ["/a"]
    assert [r.path[-2:] for r in traces.stale_sources(spark, str(tmp_path), manifest.where("path like '%/b'")).collect()] == ["/a"]


def test_unsigned_trace(spark, tmp_path):
    spark.sql("select cast(18446744073709551615 as decimal(20,0)) as value, 5 as offset, 'b' as bench").write.parquet(str(tmp_path / "t"))
    r = traces.read_trace(spark, str(tmp_path / "t")).first()
    assert (r.value, r.offset, r.bench, r.rn) == (-1, 5, "b", 0) and r.run_id.endswith(".parquet")


def test_results_are_written_once(spark, tmp_path):
    at = str(tmp_path / "r")
    rows = lambda *benches: spark.createDataFrame([(b, i) for b in benches for i in range(2)], "bench string, n long")
    assert traces.save_result(rows("a"), at) == 2
    half = tmp_path / "r" / "batch=half"  # a job that did not end
    rows("b").write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    assert traces.save_result(rows("a", "b", "c"), at) == 4
    assert traces.save_result(rows("a", "b", "c"), at) == 0
    assert sorted(r.bench for r in spark.read.parquet(at).collect()) == ["a", "a", "b", "b", "c", "c"]
    assert traces.save_result(rows("a"), str(tmp_path / "c"), "csv") == 2 and traces.save_result(rows("a", "b"), str(tmp_path / "c"), "csv") == 2


COSTS = "events: Ir Dr\nfl=a.c\nfn=f\n1 10 2\n2 5\nfn=g\n7 1 1\nfl=b.c\nfn=h\n1 4 4\n1 1\nsummary: {}\n"


def test_cost_profiles(spark, tmp_path):
    (tmp_path / "p1").write_text(COSTS.format("21 7"))
    got = sorted(tuple(r)[1:] for r in profile_files.read_cost_profiles(spark, str(tmp_path / "p1")).collect())
    assert got == sorted([("a.c", "f", 1, "Ir", 10), ("a.c", "f", 1, "Dr", 2), ("a.c", "f", 2, "Ir", 5), ("a.c", "f", 2, "Dr", 0), ("a.c", "g", 7, "Ir", 1), ("a.c", "g", 7, "Dr", 1), ("b.c", "h", 1, "Ir", 5), ("b.c", "h", 1, "Dr", 4)])
    (tmp_path / "p2").write_text(COSTS.format("20 7"))
    with pytest.raises(ValueError):
        profile_files.read_cost_profiles(spark, str(tmp_path / "p2"))
    (tmp_path / "p3").write_text("events: Ir\nfl=a\nfn=f\n1 1\n")
    with pytest.raises(ValueError):
        profile_files.read_cost_profiles(spark, str(tmp_path / "p1"), str(tmp_path / "p3"))


def test_cost_profiles_in_splits(spark, tmp_path):
    body = "".join(f"fl=f{i // 100}.c\nfn=fn{i // 10}\n" * (i % 10 == 0) + f"{i} {i % 7} 1\n" for i in range(3000))
    (tmp_path / "p").write_text("events: Ir Dr\n" + body + f"summary: {sum(i % 7 for i in range(3000))} 3000\n")
    with small_splits(spark):
        got = sorted(tuple(r)[1:] for r in profile_files.read_cost_profiles(spark, str(tmp_path / "p")).where("event = 'Ir'").collect())
    assert got == sorted((f"f{i // 100}.c", f"fn{i // 10}", i, "Ir", i % 7) for i in range(3000))


def test_heap_points(spark, tmp_path):
    point = {"tb": 64, "tbk": 2, "tl": 9, "rb": 3, "wb": 4, "acc": [-3, 5, 0xFFFF, 1], "fs": [2, 1]}
    (tmp_path / "h.json").write_text(json.dumps({"pps": [point], "ftbl": ["[root]", "main", "malloc"]}))
    r = profile_files.read_heap_points(spark, str(tmp_path / "h.json")).first()
    assert (r.tb, r.tbk, r.gb, r.acc, r.fs) == (64, 2, 0, [5, 5, 5, None, 1], ["main", "malloc"])
    (tmp_path / "bad.json").write_text(json.dumps({"ftbl": []}))
    with pytest.raises(ValueError):
        profile_files.read_heap_points(spark, str(tmp_path / "bad.json"))


def test_timeline_in_ranges(spark):
    rng = random.Random(2)
    allocs = [(f"r{i % 2}", i, None if rng.random() < 0.2 else i + rng.randint(1, 60), rng.randint(1, 99), f"s{i % 3}") for i in range(200)]
    df = spark.createDataFrame(allocs, "run_id string, seq long, end_seq long, size long, site string")
    want = []
    for run in ("r0", "r1"):
        own = [a for a in allocs if a[0] == run]
        at = sorted([a[1] for a in own] + [a[2] for a in own if a[2] is not None])
        live = lambda t: [a for a in own if a[1] <= t and (a[2] is None or a[2] > t)]  # noqa: B023, E731
        want += [(run, t, sum(a[3] for a in live(t)), len(live(t))) for t in at]
    for bits in (3, 20):
        assert sorted(map(tuple, profiles.live_heap_timeline(df, bits).collect())) == sorted(want)
    peak = {run: max((w for w in want if w[0] == run), key=lambda w: (w[2], -w[1])) for run in ("r0", "r1")}
    got = profiles.peak_composition(df).groupBy("run_id").agg(F.sum("bytes").alias("n"), F.sum("blocks").alias("k")).collect()
    assert {r.run_id: (r.n, r.k) for r in got} == {run: p[2:] for run, p in peak.items()}


def test_attribution_summary(spark):
    rows = [("a.c", "f", 1, "Ir", 100), ("a.c", "f", 0, "Ir", 50), ("b.c", "g", 3, "Ir", 40), ("c.c", "h", 2, "Ir", 30), ("???", "x", 0, "Ir", 20), ("d.c", "y", 1, "Ir", 1), ("a.c", "f", 1, "Dr", 9)]
    costs = spark.createDataFrame(rows, "file string, fn string, line int, event string, n long")
    readable = spark.createDataFrame([("a.c", False), ("b.c", True), ("d.c", False)], "file string, stale boolean")
    got = dict(map(tuple, profiles.attribution_summary(costs, "Ir", readable, threshold=1.0).collect()))
    assert got == {"annotated": 100, "known_file_no_line": 50, "stale_source": 40, "unreadable": 30, "unidentified_file": 20, "below_threshold": 1}


def test_files_of_one_name_are_two_runs(spark, tmp_path):
    for folder in "xy":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "run.log").write_text("===ALLOC START===\nStart  0x4000,  size 8192\n===ALLOC END===\n0x4010  0x2 trailing text\n0x4018\t0x3\n")
    for given in ([str(tmp_path / "x"), str(tmp_path / "y")], [str(tmp_path / "*" / "run.log")], [str(tmp_path / "x/run.log"), str(tmp_path / "y/run.log")]):
        rows = sorted((r.run_id, r.seq, r.kind) for r in traces.read_trace_log(spark, *given).collect())
        assert rows == [(f"{f}/run.log", seq, kind) for f in "xy" for seq, kind in ((2, "ALLOC"), (4, "STORE"), (5, "STORE"))]
    trace, lost = traces.ingest_log(spark, "b", str(tmp_path / "x"), str(tmp_path / "y"))
    assert sorted((r.run_id, r.generation, r.offset, r.value) for r in trace.collect()) == [(f"{f}/run.log", 1, o, v) for f in "xy" for o, v in ((16, 2), (24, 3))]
    assert lost.count() == 0
    for folder in "xy":
        (tmp_path / folder / "m.mem").write_text(" L 10,4\n S 20,8\n")
    got = sorted((r.run_id, r.seq, r.kind) for r in traces.parse_mem_reference_trace(spark, str(tmp_path / "x/m.mem"), str(tmp_path / "y/m.mem")).collect())
    assert got == [(f"{f}/m.mem", seq, kind) for f in "xy" for seq, kind in ((1, "L"), (2, "S"))]


def test_the_files_are_scanned_once(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\ny\n")
    df = traces.file_order(spark, str(tmp_path))
    assert [(r.seq, r.value) for r in df.orderBy("seq").collect()] == [(1, "x"), (2, "y")]
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_stores_dir_of_folders_and_splits(spark, tmp_path):
    """Two runs with a buffer of one name; bodies over many splits; rn is the line's number in its file."""
    for folder in ("one", "two/deep"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "0x4000_65536_64bits_1.stores").write_text("# at main\n# by g\n" + "".join(f"{8 * (i % 9)}:0x{i:x}\n" for i in range(1500)))
    with small_splits(spark):
        trace, bad = traces.read_stores_dir(spark, str(tmp_path), "b")
        rows = sorted((r.run_id, r.rn, r.offset, r.value, r.alloc_stack) for r in trace.collect())
    assert rows == [(run, i + 3, 8 * (i % 9), i, "at main\nby g") for run in ("one", "two/deep") for i in range(1500)]
    assert bad.count() == 0


def test_cost_profiles_of_one_name_and_many_counters(spark, tmp_path):
    events = [f"E{i}" for i in range(1500)]
    for folder, by in (("x", 1), ("y", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "p").write_text(f"events: {' '.join(events)}\nfl=a.c\nfn=f\n7 {' '.join(str(by * i) for i in range(1500))}\nsummary: {' '.join(str(by * i) for i in range(1500))}\n")
    got = profile_files.load_cost_profiles(spark, str(tmp_path / "out"), str(tmp_path / "x"), str(tmp_path / "y")).collect()
    assert sorted((r.run, r.event, r.n) for r in got) == sorted((f"{f}/p", e, by * i) for f, by in (("x", 1), ("y", 2)) for i, e in enumerate(events))
    (tmp_path / "z").write_text("events: A B\nfl=a\nfn=f\n1 2 3 4\n")
    with pytest.raises(ValueError):
        profile_files.read_cost_profiles(spark, str(tmp_path / "z"))
