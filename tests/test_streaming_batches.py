"""Streaming attribution: micro-batches of bounded size, work in proportion to events, values to their last bit."""

import time

import duckdb
import numpy as np

from stowage.plans import table_queries as q
from stowage.streaming.traces import newest_holders, run_available, stream_attribute

from test_streaming import EVENTS, in_batches

SMALL = "/root/testdata/sf0.001"


def test_registered_stream_in_several_batches(spark, monkeypatch):
    """A batch has a range of seq, the earlier first: nothing is late."""
    monkeypatch.setattr(q, "EVENTS", 2500)
    source = q.event_stream(spark, SMALL)
    out = run_available(stream_attribute(source), "append")
    seen = {r["at"] for r in out.selectExpr("regexp_extract(_metadata.file_path, 'batch=([0-9]+)', 1) as at").collect()}
    assert len(seen) == 3
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    columns = "seq", "addr", "alloc_addr", "generation", "offset", "status"
    want = con.sql(q.ORACLE_SQL["h01_stream_attribute"]).select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(tuple, out.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_values_keep_all_bits(spark, tmp_path):
    rows = [("r", 1, "ALLOC", 4096, 100, None), ("r", 2, "STORE", 4100, None, 0x3FE3333333333333), ("r", 2**60 + 1, "STORE", 4100, None, -(2**63)), ("r", 5, "FREE", 1 << 40, None, None)]
    out = run_available(stream_attribute(in_batches(spark, tmp_path / "in", rows, EVENTS, [rows])), "append")
    assert sorted((r.seq, r.value, r.generation) for r in out.collect()) == [(2, 0x3FE3333333333333, 1), (2**60 + 1, -(2**63), 1)]


def test_many_generations_at_one_address():
    """A store looks at the blocks that are live, not at all that ever were there."""
    n = 100_000
    blocks = [(10 * i, 8192, 4096, 10 * i + 10) for i in range(n)]
    seq = 10 * np.arange(n, dtype=np.int64) + 5
    began = time.time()
    owner = newest_holders(seq, np.full(n, 9000, np.int64), blocks, 2, 2)
    assert (owner == np.arange(n)).all() and time.time() - began < 20
