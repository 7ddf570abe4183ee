"""Ordered work in tasks of a bounded number of rows, however few partitions the session has."""

import pytest

from pyspark.sql import functions as F

from stowage.operators import cells, ranges
from stowage.operators.mx import mantissa_sweep
from stowage.plans.fixtures import RN_BITS, trace

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view", ["hot", "li"])
def test_cells_in_more_tasks_than_the_session_has(spark, monkeypatch, view):
    t = trace(spark, SMALL, view)
    want = sorted(map(tuple, cells.cells(t, RN_BITS).collect()))
    monkeypatch.setattr(ranges, "ROWS", 500)
    df = cells.cells(t, RN_BITS)
    assert sorted(map(tuple, df.collect())) == want
    dealt = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x and "_range" in x]
    assert dealt and all("REPARTITION_BY_NUM" in x and ", 12)" in x for x in dealt)  # some 6,000 stores, dealt once


def test_few_rows_are_left_alone(spark):
    df = spark.range(10)
    assert ranges.dealt(df, "id") is df


def test_a_sweep_shuffles_its_elements_once(spark, monkeypatch):
    """Blocks neither meet their elements in a join nor are grouped at each width."""
    t = trace(spark, SMALL, "li").where("alloc_type = '64bits'")
    t = t.selectExpr("bench", "alloc_addr", "rn as idx", "value as bits")
    key = ["bench", "alloc_addr"]
    # Groups that blocks don't belong to as a whole have blocks counted by grouping; the same groups as part of the key do without.
    named = t.withColumn("part", F.col("bench"))
    want = sorted(map(tuple, mantissa_sweep(named, key, ["part"], (52, 10, 3), esz=8).collect()))
    monkeypatch.setattr(ranges, "ROWS", 300)
    df = mantissa_sweep(t, key, ["bench"], (52, 10, 3), esz=8)
    assert sorted(map(tuple, df.collect())) == want and len(want) >= 9
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2  # elements to blocks, then sums
