"""Places of rows in an order, for keys of any size, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import tasks_for, written


def in_order(df: DataFrame, run: str, *order: Column, name: str = "ordered") -> DataFrame:
    """`df` with `place` (long, from 0) of each row in its run by `order`, and `total`, the rows of the run.

    `run` is a column without nulls, `df` a frame that is cheap to read twice (a written table): the ranges are drawn from a
    sample of it. Rows are dealt by range of (run, order), counted per range, and numbered inside a range, so a run of any
    size is many tasks' work. `order` must tell rows apart, or equal rows must be interchangeable.
    """
    dealt = df.repartitionByRange(tasks_for(df), F.col(run), *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, name)
    parts = dealt.groupBy(run, "part").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(run).orderBy("part"))
    parts = parts.select(run, "part", (upto - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy(run)).alias("total"))
    nth = F.row_number().over(Window.partitionBy(run, "part").orderBy(*order)) - 1
    return dealt.withColumn("nth", nth).join(parts, [run, "part"]).withColumn("place", F.col("before") + F.col("nth")).drop("part", "nth", "before")
