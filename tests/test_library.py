"""Registered queries against their SQL on the smallest tables, and ingest on a hand-written log."""

import duckdb
import pytest

from pyspark.sql import functions as F

from stowage.functions import bits as b
from stowage.plans import registry
from stowage.sources import traces

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LOG = """===ALLOC START===
Start 0x4000, size 8192
   at 0x4C2: malloc (m.c:1)
   by 0x10: main (a.c:1)
===ALLOC END===
0x4000 0x3fe3333333333333
0x4008 0xffffffffffffffff
junk line
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
   at 0x4C2: malloc (m.c:1)
===ALLOC END===
0x4004 0x7
"""


@pytest.fixture(scope="module")
def duck():
    """Connections by folder, the smallest tables first."""
    out = {}
    for folder in (SMALL, SMALL.replace("0.001", "0.01")):
        out[folder] = duckdb.connect()
        for t in TABLES:
            out[folder].execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return out


def plain(rows):
    out = []
    for r in rows:
        out.append(tuple(None if x is None or x != x else round(float(x), 7) if isinstance(x, float) else x for x in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    """On the smallest tables that give the query rows: some have a least number of stores."""
    for folder, con in duck.items():
        rel = con.sql(registry.ORACLE_SQL[name])
        columns = sorted(rel.columns)
        want = plain(rel.select(", ".join(f'"{c}"' for c in columns)).fetchall())
        if want:
            df = registry.QUERIES[name](spark, folder)
            assert sorted(df.columns) == columns
            assert plain(tuple(r) for r in df.select(*columns).collect()) == want
            return
    pytest.fail("empty tables prove nothing")


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_log(spark, tmp_path):
    (tmp_path / "run.log").write_text(LOG)
    trace, lost = traces.ingest_log(spark, "b", str(tmp_path / "run.log"))
    rows = sorted((r.generation, r.offset, r.value, r.alloc_type) for r in trace.collect())
    assert rows == [(1, 0, 0x3FE3333333333333, "64bits"), (1, 8, -1, "64bits"), (2, 4, 7, "32bits")]
    assert {r.alloc_stack for r in trace.where("generation = 1").collect()} == {"   at 0x4C2: malloc (m.c:1)\n   by 0x10: main (a.c:1)"}
    assert sorted(r.addr for r in lost.collect()) == [0x4010, 0x9000]
    with pytest.raises(ValueError):
        events = traces.read_trace_log(spark, str(tmp_path / "run.log"))
        traces.unattributed_stores(events.where("kind = 'STORE'"), trace.withColumnRenamed("rn", "seq"), strict=True)


def test_parquet_round_trip(spark, tmp_path):
    (tmp_path / "run.log").write_text(LOG)
    trace, _ = traces.ingest_log(spark, "b-1", str(tmp_path / "run.log"))
    traces.write_trace(trace, str(tmp_path / "t"))
    back = traces.all_stores(spark, str(tmp_path / "t"), views=True)
    assert sorted(map(tuple, back.select(*trace.columns).collect())) == sorted(map(tuple, trace.collect()))
    assert spark.table("b_1").count() == trace.count()
    assert traces.save_result(back.groupBy("bench").count(), str(tmp_path / "r")) == 1
    assert traces.save_result(back.groupBy("bench").count(), str(tmp_path / "r")) == 0


def test_stores_dir(spark, tmp_path):
    (tmp_path / "0x4a4b040_8192_32bits_1.stores").write_text("# at main\n0:0x1\n4:0xffffffffffffffff\njunk\n")
    (tmp_path / "other.txt").write_text("0:0x1\n")
    trace, bad = traces.read_stores_dir(spark, str(tmp_path))
    assert sorted((r.alloc_addr, r.offset, r.value, r.alloc_stack) for r in trace.collect()) == [(0x4A4B040, 0, 1, "at main"), (0x4A4B040, 4, -1, "at main")]
    assert bad.count() == 1


def test_unsigned_bits(spark):
    df = spark.createDataFrame([("18446744073709551615",), ("9223372036854775808",), ("5",)], "x string").selectExpr("cast(x as decimal(20,0)) as x")
    rows = df.select(b.from_unsigned("x").alias("s"), b.to_unsigned(b.from_unsigned("x")).alias("u"), b.hex_addr(b.from_unsigned("x")).alias("h"), b.from_hex(F.lit("ffffffffffffffff")).alias("n")).collect()
    assert [r.s for r in rows] == [-1, -(2**63), 5] and [int(r.u) for r in rows] == [2**64 - 1, 2**63, 5] and rows[0].h == "0xffffffffffffffff" and rows[0].n == -1
