"""Streams in many micro-batches against plain loops and the batch operators."""

import os
import random
import time

import pytest

from stowage.sources import traces
from stowage.streaming.traces import keyed_state, run_available, stream_attribute, stream_silent

EVENTS = "run_id string, seq long, kind string, addr long, size long, value long"
STORES = "run_id string, bench string, alloc_addr long, generation long, alloc_type string, offset long, value long, rn long"
LOG = """===ALLOC START===
Start 0x4000, size 8192
===ALLOC END===
0x4000 0x3fe3333333333333
0x4008 0xffffffffffffffff
===ALLOC START===
Start 0x9000, size 16
===ALLOC END===
0x9000 0x1
===FREE START===
Start 0x4000, size 8192
===FREE END===
0x4010 0x5
===ALLOC START===
Start 0x4000, size 8192
===ALLOC END===
0x4004 0x7
"""


def in_batches(spark, at, rows, schema, batches):
    """Rows as files that a stream takes one after another."""
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{at}/{i:03}")
    files = sorted(at.glob("*/*.parquet"))
    for i, f in enumerate(files):  # the order of files is that of their times
        os.utime(f, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/*")


def test_attributes_as_the_batch_does(spark, tmp_path):
    (tmp_path / "run.log").write_text(LOG)
    events = traces.read_trace_log(spark, str(tmp_path / "run.log")).where("kind <> 'FRAME'").select("run_id", "seq", "kind", "addr", "size", "value")
    rows = sorted(map(tuple, events.collect()), key=lambda r: r[1])
    out = run_available(stream_attribute(in_batches(spark, tmp_path / "in", rows, EVENTS, [rows[:4], rows[4:]])), "append")
    got = sorted((r.seq, r.status, r.generation, r.offset) for r in out.collect())
    assert [r[1:] for r in got] == [("ok", 1, 0), ("ok", 1, 8), ("ok", 1, 0), ("unattributed", None, None), ("ok", 2, 4)]


@pytest.mark.parametrize("area", [13, 20])
def test_random_events_in_many_batches(spark, tmp_path, area):
    """Blocks of bytes to many areas, freed, reused and left open; batches are shuffled inside."""
    rng, rows, live, blocks, want, generation = random.Random(area), [], {}, [], {}, {}
    for seq in range(1, 700):
        run = f"r{rng.randrange(2)}"
        roll = rng.random()
        addr = 4096 * rng.randint(1, 40)
        if roll < 0.15:
            size = rng.choice((64, 4096, 5000, 30_000))
            rows.append((run, seq, "ALLOC", addr, size, None))
            generation[run, addr] = generation.get((run, addr), 0) + 1
            live[run, addr] = (seq, size, generation[run, addr])
        elif roll < 0.22:
            rows.append((run, seq, "FREE", addr, 1, None))
            live.pop((run, addr), None)
        else:
            at = addr + rng.randrange(5000)
            rows.append((run, seq, "STORE", at, None, seq))
            held = [(*live[r, a], a) for r, a in live if r == run and a <= at < a + live[r, a][1]]
            want[seq] = ("ok", max(held)[3], max(held)[2]) if held else ("unattributed", None, None)
    cuts = [rows[i : i + 120] for i in range(0, len(rows), 120)]
    for part in cuts:
        rng.shuffle(part)
    out = run_available(stream_attribute(in_batches(spark, tmp_path / "in", rows, EVENTS, cuts), area), "append")
    assert {r.seq: (r.status, r.alloc_addr, r.generation) for r in out.collect()} == want


def test_late_stores_are_told_apart(spark, tmp_path):
    one = [("r", 1, "ALLOC", 4096, 100, None), ("r", 5, "STORE", 4100, None, 1)]
    two = [("r", 3, "STORE", 4100, None, 2), ("r", 6, "STORE", 4100, None, 3), ("r", 2, "STORE", 1 << 40, None, 4)]
    out = run_available(stream_attribute(in_batches(spark, tmp_path / "in", one + two, EVENTS, [one, two])), "append")
    assert {r.seq: r.status for r in out.collect()} == {5: "ok", 3: "late", 6: "ok", 2: "unattributed"}


@pytest.mark.parametrize("offsets", [4, 12])
def test_silent_stores_in_many_batches(spark, tmp_path, offsets):
    rng = random.Random(offsets)
    rows = [("r", "b", 4096 * rng.randint(1, 2), 1, "64bits", 0 if rng.random() < 0.7 else 8 * rng.randint(0, 9), rng.randint(0, 1), i // 2) for i in range(600)]
    cuts = [rows[i : i + 150] for i in range(0, 600, 150)]
    for part in cuts:
        rng.shuffle(part)
    out = run_available(stream_silent(in_batches(spark, tmp_path / "in", rows, STORES, cuts), offsets=offsets), "append")
    pairs = silent = 0
    cells = {}
    for r in sorted(rows, key=lambda r: (r[7], r[6])):
        cells.setdefault((r[2], r[5]), []).append(r[6])
    for own in cells.values():
        pairs += len(own) - 1
        silent += sum(a == b for a, b in zip(own, own[1:], strict=False))
    total = out.selectExpr("sum(stores_with_prev)", "sum(silent)", "sum(late)").first()
    assert tuple(total) == (pairs, silent, 0)


def test_late_silent_stores(spark, tmp_path):
    store = lambda rn, value, offset=0: ("r", "b", 4096, 1, "64bits", offset, value, rn)
    cuts = [[store(5, 1), store(6, 1)], [store(2, 1), store(7, 1), store(8, 2), store(1, 9, 8)]]
    out = run_available(stream_silent(in_batches(spark, tmp_path / "in", [], STORES, cuts)), "append").selectExpr("sum(stores_with_prev)", "sum(silent)", "sum(late)").first()
    assert tuple(out) == (3, 2, 1)


def test_cells_that_are_kept_for_a_time(spark, tmp_path):
    """With ttl the stream runs on by the clock; within the time, nothing is forgotten."""
    store = lambda rn, value: ("r", "b", 4096, 1, "64bits", 0, value, rn)
    source = in_batches(spark, tmp_path / "in", [], STORES, [[store(5, 1), store(6, 1)], [store(7, 1), store(8, 2)]])
    seen = []
    with keyed_state(spark):
        stream = stream_silent(source, ttl=3_600_000).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        query = stream.foreachBatch(lambda df, n: seen.extend(df.collect())).start()
    until = time.time() + 60
    while len(seen) < 2 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert sum(r.stores_with_prev for r in seen) == 3 and sum(r.silent for r in seen) == 2


def test_the_session_keeps_its_own_state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with keyed_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before
