"""One row per cell: what most analyses need of a trace, from one pass over its stores.

A cell is one offset of one buffer. The table is many times smaller than the trace and holds no stack texts; write it once
(`write_cells`) and give it to the analyses of cells instead of the trace: they take either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions import bits as b
from stowage.operators.ranges import RANGE_BITS, dealt

BUFFER = ("run_id", "bench", "alloc_addr", "generation")
CELL = (*BUFFER, "offset")
FP = "alloc_type in ('64bits', '32bits')"


def is_cells(t: DataFrame) -> bool:
    return "writes" in t.columns


def ordered_cells(t: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """Every column of cells(): a cell's stores in the order of rn (ties by value), in ranges of 2**bits of rn.

    Tasks take some million stores each. A range is one row, with its first and last value; then the few ranges of a cell meet, and the first store of a range has
    the last value of the range before it as its predecessor. So a cell that holds most stores of a trace is many tasks' work, and
    no cell is treated in another way because of its size.
    """
    order = F.struct("rn", "value")
    x = b.normal_exp("alloc_type", "value")
    rows = t.select(*CELL, "alloc_type", "alloc_size", "value", "rn", F.shiftright("rn", bits).alias("_range"))
    rows = dealt(rows, "run_id", "offset", "_range")  # columns that are constants would have Spark deal them anew
    rows = rows.withColumn("_prev", F.lag("value").over(Window.partitionBy(*CELL, "_range").orderBy("rn", "value")))
    ranges = rows.groupBy(*CELL, "_range").agg(
        F.min("alloc_type").alias("alloc_type"), F.min("alloc_size").alias("alloc_size"), F.count("*").alias("writes"),
        F.count("_prev").alias("pairs"), F.count_if(F.col("_prev") == F.col("value")).alias("silent"),
        F.min_by("value", order).alias("_first"), F.max_by("value", order).alias("last"), F.max("rn").alias("last_rn"),
        F.count(x).alias("normal"), F.min(x).alias("min_exp"), F.max(x).alias("max_exp"),
    )
    ranges = ranges.withColumn("_before", F.lag("last").over(Window.partitionBy(*CELL).orderBy("_range")))
    return ranges.groupBy(*CELL).agg(
        F.min("alloc_type").alias("alloc_type"), F.min("alloc_size").alias("alloc_size"), F.sum("writes").alias("writes"),
        (F.sum("pairs") + F.count("_before")).alias("pairs"), (F.sum("silent") + F.count_if(F.col("_before") == F.col("_first"))).alias("silent"),
        F.max_by("last", "_range").alias("last"), F.max("last_rn").alias("last_rn"),
        F.sum("normal").alias("normal"), F.min("min_exp").alias("min_exp"), F.max("max_exp").alias("max_exp"),
    )


def cells(t: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """run_id, bench, alloc_addr, generation, offset, alloc_type, alloc_size; writes: stores; pairs: stores with a predecessor in the cell; silent: those
    that repeat it; last, last_rn: the last value and its place; normal, min_exp, max_exp: normal floating-point values and the extent of their exponents.

    A table of cells is given back as it is.
    """
    return t if is_cells(t) else ordered_cells(t, bits)


def write_cells(t: DataFrame, path: str, bits: int = RANGE_BITS) -> DataFrame:
    """The table of cells, written once under `path`, a folder per bench; benches of the trace that are there already are replaced."""
    cells(t, bits).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bench").parquet(path)
    return read_cells(t.sparkSession, path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cell_counts(t: DataFrame) -> DataFrame:
    """CELL, writes, alloc_type, alloc_size: from a trace without any order, so partial sums go through the shuffle."""
    columns = (*CELL, "writes", "alloc_type", "alloc_size")
    if is_cells(t):
        return t.select(*columns)
    return t.groupBy(*CELL).agg(F.count("*").alias("writes"), F.min("alloc_type").alias("alloc_type"), F.min("alloc_size").alias("alloc_size")).select(*columns)


def snapshot(t: DataFrame, *key: str) -> DataFrame:
    """The last value of every cell, or of another key that cells fall into; floating-point types only."""
    key = key or CELL
    value, rn = (F.col("last"), F.col("last_rn")) if is_cells(t) else (F.col("value"), F.col("rn"))
    rows = t.where(FP).select(*CELL, "alloc_type", value.alias("value"), rn.alias("rn"))
    if is_cells(t) and key == CELL:
        return rows.drop("rn")
    last = rows.groupBy(*key).agg(F.max_by(F.struct("value", "alloc_type"), F.struct("rn", "value")).alias("s"))
    return last.select(*key, "s.value", *(["s.alloc_type"] if "alloc_type" not in key else []))


def exponent_extents(t: DataFrame) -> DataFrame:
    """CELL, alloc_type, normal, min_exp, max_exp of floating-point cells: from a trace without any order."""
    if is_cells(t):
        return t.where(FP).select(*CELL, "alloc_type", "normal", "min_exp", "max_exp")
    x: Column = b.normal_exp("alloc_type", "value")
    return t.where(FP).groupBy(*CELL, "alloc_type").agg(F.count(x).alias("normal"), F.min(x).alias("min_exp"), F.max(x).alias("max_exp"))
