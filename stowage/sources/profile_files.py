"""Readers of profile files: line costs and heap points."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stowage.operators.profiles import decode_access_counts
from stowage.sources.saved import shared_folder
from stowage.sources.traces import carried, file_order, run_of


def load_cost_profiles(spark: SparkSession, at: str, *paths: str) -> DataFrame:
    """run, file, fn, line, event, n of files with `events:`, `fl=`, `fn=` and count lines, written below the folder `at`; missing trailing counts are 0.

    A run is a file, named by its path. One pass reads the files, writes the counts and the summaries, and observes what the
    checks need; sums are then taken from what was written. Raises if the runs name different events, if a line has more counts than
    there are events, or if a `summary:` line is not the sum of the counts; what was written stays for inspection.
    """
    last = lambda p: F.when(F.col("value").rlike(p), F.regexp_extract("value", p, 1))
    lines = carried(file_order(spark, *paths), events=last(r"^events:\s*(.*)$"), file=last(r"^fl=(.*)$"), fn=last(r"^fn=(.*)$")).withColumnRenamed("run_id", "run")
    words = lambda c: F.split(F.trim(c), r"\s+")
    is_count, is_summary = F.col("value").rlike(r"^\d+(\s+\d+)*\s*$"), F.col("value").rlike(r"^summary:")
    numbers = F.transform(words(F.regexp_replace("value", "^summary:", "")), lambda x: x.cast("long"))
    kept = lines.where(is_count | is_summary).select("run", "file", "fn", is_summary.alias("said"), words("events").alias("events"), numbers.alias("x"))
    kept = kept.withColumn("line", F.when(~F.col("said"), F.get("x", F.lit(0))).cast("int"))
    kept = kept.withColumn("x", F.when(F.col("said"), F.col("x")).otherwise(F.slice("x", F.lit(2), F.size("x"))))
    seen = Observation()
    named = F.array_join("events", " ")
    long_ = F.count_if(F.size("x") > F.size("events"))
    kept = kept.observe(seen, F.min(named).alias("first"), F.max(named).alias("last"), F.count_if(F.col("events").isNull()).alias("nameless"), long_.alias("long"))
    counts = F.transform("events", lambda e, i: F.struct(e.alias("event"), F.coalesce(F.get("x", i), F.lit(0)).alias("n")))
    kept.select("run", "file", "fn", "line", "said", F.explode(counts).alias("c")).select("run", "file", "fn", "line", "said", "c.*").write.parquet(at)
    if seen.get["first"] != seen.get["last"] or seen.get["nameless"]:
        raise ValueError("the profiles count different events")
    if seen.get["long"]:
        raise ValueError("a line has more counts than there are events")
    rows = spark.read.parquet(at)
    sums = rows.groupBy("run", "event").agg(F.sum(F.when(~F.col("said"), F.col("n"))).alias("n"), F.max(F.when(F.col("said"), F.col("n"))).alias("says"))
    if not sums.where("says <> coalesce(n, 0)").isEmpty():
        raise ValueError("a summary differs from the sum of the counts")
    return rows.where("not said").groupBy("run", "file", "fn", "line", "event").agg(F.sum("n").alias("n"))


def read_cost_profiles(spark: SparkSession, *paths: str) -> DataFrame:
    """load_cost_profiles() into the folder that the session names in spark.checkpoint.dir."""
    return load_cost_profiles(spark, f"{shared_folder(spark)}/costs-{uuid.uuid4().hex}", *paths)


#: The counters of a heap point.
POINT = ("tb", "tbk", "tl", "mb", "mbk", "gb", "gbk", "eb", "ebk", "rb", "wb")


def read_heap_points(spark: SparkSession, *paths: str) -> DataFrame:
    """run, the counters, acc (decoded) and fs as frame texts, outermost first, of JSON heap profiles."""
    fields = ", ".join(f"{c}: bigint" for c in POINT)
    schema = f"pps array<struct<{fields}, acc: array<int>, fs: array<int>>>, ftbl array<string>"
    df = spark.read.schema(schema).option("multiLine", "true").json(list(paths)).select(run_of(spark, paths).alias("run"), "ftbl", "pps")
    if not df.where("pps is null or ftbl is null").isEmpty():
        raise ValueError("a heap profile lacks its points or its frames")
    points = df.select("run", "ftbl", F.explode("pps").alias("p"))
    return points.select("run", *(F.coalesce(f"p.{c}", F.lit(0)).alias(c) for c in POINT), decode_access_counts("p.acc").alias("acc"),
        F.reverse(F.transform("p.fs", lambda i: F.get("ftbl", i))).alias("fs"))
