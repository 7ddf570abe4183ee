"""Ordered work over keys of any size: a key is cut into ranges of its order, and one row per range is stitched to the ranges before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges are 2**RANGE_BITS long in the first column of the order.
RANGE_BITS = 20
#: Rows that a task of dealt() orders, about.
ROWS = 1 << 20


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """`df` dealt by `key` to so many tasks that each orders some ROWS rows, if the session's number of partitions is smaller than that.

    So what a task holds does not grow with the table. Keys have to be small, as ranges and blocks are. The rows are counted first, which costs Parquet
    tables a look at their footers.
    """
    tasks = -(-df.count() // ROWS)
    return df.repartition(tasks, *key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def before(*key: str) -> Window:
    """The ranges of a key before a row's own."""
    return Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def previous(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...], value: str, out: str, bits: int = RANGE_BITS) -> DataFrame:
    """`out`: the value of the row before within the key, by `order` (its first column a long)."""
    ranged = df.withColumn("_range", F.shiftright(order[0], bits))
    w = Window.partitionBy(*key, "_range").orderBy(*order)
    inside = ranged.withColumn("_inside", F.lag(F.struct(F.col(value).alias("v"))).over(w))
    ends = ranged.groupBy(*key, "_range").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*key).orderBy("_range"))).drop("_end")
    found = F.when(F.col("_inside").isNotNull(), F.col("_inside.v")).otherwise(F.col("_before"))
    return inside.join(ends, [*key, "_range"]).withColumn(out, found).drop("_range", "_inside", "_before")


def ranked(df: DataFrame, key: tuple[str, ...], order: str, bits: int = RANGE_BITS) -> DataFrame:
    """idx: place (from 0) of a row in its key by `order`, which is unique there; ranges are counted first, then ranked inside."""
    ranged = df.withColumn("_range", F.shiftright(order, bits))
    sizes = ranged.groupBy(*key, "_range").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before(*key)), F.lit(0))).drop("_n")
    inside = ranged.withColumn("_i", F.row_number().over(Window.partitionBy(*key, "_range").orderBy(order)) - 1)
    return inside.join(sizes, [*key, "_range"]).withColumn("idx", F.col("_base") + F.col("_i")).drop("_range", "_i", "_base")


def running(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...], bits: int = RANGE_BITS, **sums: Column) -> DataFrame:
    """Each of `sums` added up over the rows of the key up to a row's own, by `order` (its first column a long, unique as a whole)."""
    ranged = df.select("*", F.shiftright(order[0], bits).alias("_range"), *(x.alias(f"_{name}") for name, x in sums.items()))
    whole = ranged.groupBy(*key, "_range").agg(*(F.sum(f"_{name}").alias(f"_{name}") for name in sums))
    whole = whole.select(*key, "_range", *(F.coalesce(F.sum(f"_{name}").over(before(*key)), F.lit(0)).alias(f"_{name}_before") for name in sums))
    upto = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumns({name: F.sum(f"_{name}").over(upto) for name in sums}).join(whole, [*key, "_range"])
    return inside.withColumns({name: F.col(name) + F.col(f"_{name}_before") for name in sums}).drop("_range", *(f"_{n}" for n in sums), *(f"_{n}_before" for n in sums))


def latest_of(df: DataFrame, marks: DataFrame, key: tuple[str, ...], order: str, value: str, bits: int = RANGE_BITS) -> DataFrame:
    """Rows of `df` with the `value` of the last mark of their key before them (marks: key, order, value); null where there is none.

    Rows and marks are swept together, range by range; of the marks before a range only the last is needed, and it is joined to the range. A
    mark at a row's own place does not count.
    """
    in_range = F.shiftright(order, bits).alias("_range")
    rows = df.select("*", F.lit(None).cast(marks.schema[value].dataType).alias(value), F.lit(0).alias("_mark"))
    all_ = rows.unionByName(marks.select(*key, order, value, F.lit(1).alias("_mark")), allowMissingColumns=True).select("*", in_range)
    upto = Window.partitionBy(*key, "_range").orderBy(order, "_mark").rowsBetween(Window.unboundedPreceding, 0)
    inside = all_.withColumn("_inside", F.last(value, ignorenulls=True).over(upto)).where("_mark = 0")
    ends = marks.select(*key, order, value, in_range).groupBy(*key, "_range").agg(F.max_by(value, order).alias("_end"))
    ranges = df.select(*key, in_range).distinct().join(ends, [*key, "_range"], "full")
    ranges = ranges.select(*key, "_range", F.last("_end", ignorenulls=True).over(before(*key)).alias("_before"))
    return inside.join(ranges, [*key, "_range"]).withColumn(value, F.coalesce("_inside", "_before")).drop("_range", "_inside", "_before", "_mark")
