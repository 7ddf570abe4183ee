"""Readers and writers of traces: raw logs, per-allocation files, Parquet; attribution of stores to allocations."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions import bits as b
from stowage.functions.sites import view_name
from stowage.operators.ranges import RANGE_BITS, latest_of, running
from stowage.sources.saved import saved

PAGE = 12  # bits of the page by which stores meet allocations
MANY = 64  # pages beyond which an allocation is met by coarser buckets
SMALL, HUGE = PAGE, 22
NEVER = 2**63 - 1  # where allocations end that are open at the end of their run
SLICE = 8  # allocations that begin in one slice of a bucket's time


def folder_of(spark: SparkSession, paths: tuple[str, ...]) -> str:
    """The folder (as file names in _metadata have it, without scheme and host) by which the files of `paths` are named."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    folders = []
    for path in paths:
        whole = re.split(r"[*?\[{]", path, maxsplit=1)[0]
        at = hadoop.Path(whole or ".")
        files = at.getFileSystem(conf)
        name = files.makeQualified(at).toUri().getRawPath()
        is_folder = whole == path and files.exists(at) and files.getFileStatus(at).isDirectory()
        folders.append(f"{name.rstrip('/')}/" if is_folder or whole.endswith("/") else name)
    return os.path.commonprefix(folders).rpartition("/")[0] + "/"


def run_of(spark: SparkSession, paths: tuple[str, ...]) -> Column:
    """A row's file, by its path below the folder of all that is given (the whole path where it is not below it)."""
    path = F.regexp_replace("_metadata.file_path", r"^[^:/]+:(//[^/]*)?", "")
    folder = folder_of(spark, paths)
    return F.when(F.startswith(path, F.lit(folder)), F.substr(path, F.lit(len(folder) + 1))).otherwise(path)


def file_order(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """Lines of text files: run_id (the file's path below the folder of all that is given), at (the start of the line's split), seq (from 1 in each file), value.

    Lines are counted inside their split; one row per split is stitched to the splits before it, so a file of any size is many tasks'
    work. Neither names of folders nor numbers of partitions take part: files of one name in two folders are two runs. The counts
    are taken from the same shuffle as the lines, so the files are read once.
    """
    text = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(list(paths))
    lines = text.select(run_of(spark, paths).alias("run_id"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("mono"), "value")
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("run_id", "at").orderBy("mono")))
    before = Window.partitionBy("run_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("run_id", "at").agg(F.greatest(F.max("n"), F.count("value")).alias("lines"))
    splits = splits.select("run_id", "at", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    return lines.join(splits, ["run_id", "at"]).select("run_id", "at", (F.col("before") + F.col("n")).alias("seq"), "value")


def carried(lines: DataFrame, **columns: Column) -> DataFrame:
    """Lines of file_order() with the last value that each of the columns had up to a line, in ranges of a split as there."""
    so_far = Window.partitionBy("run_id", "at").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("run_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("*", *(F.last(x, ignorenulls=True).over(so_far).alias(name) for name, x in columns.items()))
    ends = lines.groupBy("run_id", "at").agg(*(F.max_by(name, "seq").alias(name) for name in columns))
    ends = ends.select("run_id", "at", *(F.last(name, ignorenulls=True).over(before).alias(f"{name}_before") for name in columns))
    lines = lines.join(ends, ["run_id", "at"])
    return lines.withColumns({name: F.coalesce(name, f"{name}_before") for name in columns}).drop(*(f"{name}_before" for name in columns))


def read_trace_log(spark: SparkSession, *paths: str) -> DataFrame:
    """A1: run_id, seq, kind (ALLOC, FREE, STORE, FRAME, other markers dropped), addr, size, value, frame, block.

    Block delimiters carry forward over a file; block is the seq of the opening delimiter. A line that fits none of the
    forms is dropped. seq is the order of splits in a file and of lines in a split.
    """
    lines = file_order(spark, *paths)
    marker = F.regexp_extract("value", r"^===(ALLOC|FREE) (START|END)===", 1)
    kind = F.when(F.col("value").contains("START"), marker).otherwise("")
    lines = carried(lines, state=F.when(F.col("value").startswith("==="), F.struct(kind.alias("kind"), F.col("seq").alias("block")))).where(~F.col("value").startswith("==="))
    head = r"^Start\s+0x([0-9a-fA-F]+),\s+size\s+(\d+)"
    store = r"^0x([0-9a-fA-F]+)\s+0x([0-9a-fA-F]+)"  # whatever follows the value is left alone
    inside = F.coalesce(F.col("state.kind"), F.lit(""))
    is_head, is_store = F.col("value").rlike(head) & (inside != ""), F.col("value").rlike(store) & (inside == "")
    kind = F.when(is_head, inside).when(is_store, "STORE").when(inside != "", "FRAME")
    hexed = lambda p, i: b.from_hex(F.regexp_extract("value", p, i))
    out = lines.select(
        "run_id", "seq", kind.alias("kind"), F.when(is_head, hexed(head, 1)).when(is_store, hexed(store, 1)).alias("addr"), F.when(is_head,
            F.regexp_extract("value", head, 2).try_cast("long")).alias("size"),
        F.when(is_store, hexed(store, 2)).alias("value"), F.when(kind == "FRAME", F.col("value")).alias("frame"), F.col("state.block").alias("block"), inside.alias("inside"),
    )
    return out.where("kind is not null")


def assemble_stacks(events: DataFrame) -> DataFrame:
    """A2: alloc_stack of every allocation block."""
    frames = events.where("kind = 'FRAME' and inside = 'ALLOC'").groupBy("run_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq",
        "frame"))), lambda x: x["frame"]), "\n").alias("alloc_stack"))
    return frames


def pair_lifetimes(events: DataFrame) -> DataFrame:
    """A3, A4: allocations with end_seq (null: open to the end of the file) and generation.

    A free ends the latest allocation at its start, if that is open; a further allocation at a live start ends it too.
    """
    w = Window.partitionBy("run_id", "addr").orderBy("seq")
    ends = events.where("kind in ('ALLOC', 'FREE')").withColumns({"end_seq": F.lead("seq").over(w)})
    allocs = ends.where("kind = 'ALLOC'").withColumn("generation", F.row_number().over(w).cast("long"))
    return allocs.join(assemble_stacks(events), ["run_id", "block"], "left").select("run_id", "seq", "end_seq", F.col("addr").alias("alloc_addr"),
        F.col("size").alias("alloc_size"), "generation", F.coalesce("alloc_stack", F.lit("")).alias("alloc_stack"))


def min_block_filter(allocs: DataFrame, least: int = 4096) -> DataFrame:
    """A9"""
    return allocs.where(F.col("alloc_size") >= least)


def bucket_of(address: Column, bits: Column) -> Column:
    """Pages for allocations of few pages, 4 MiB for larger ones."""
    return F.when(bits == SMALL, F.shiftright(address, SMALL)).otherwise(F.shiftright(address, HUGE))


BUCKET = ("run_id", "bits", "bucket")


def bucketed(allocs: DataFrame) -> DataFrame:
    """Allocations with the size of the buckets by which stores meet them."""
    end = F.col("alloc_addr") + F.col("alloc_size") - 1
    small = F.shiftright(end, SMALL) - F.shiftright("alloc_addr", SMALL) < MANY
    return allocs.where("alloc_size > 0").withColumn("bits", F.when(small, SMALL).otherwise(HUGE))


def time_slices(allocs: DataFrame, bits: int = RANGE_BITS, size: int = SLICE) -> DataFrame:
    """run_id, bits, bucket, seq, live: for every `size`-th allocation of a bucket, all that may hold a store from its seq on, up to the next slice.

    The order of a bucket's allocations cuts its time into slices, whatever their lifetimes are. `live` has the allocations that begin in the slice
    and those that reach into it: as blocks alive at one time don't overlap, few do. A long-lived allocation is in as many slices as others
    begin beside it.
    """
    who = ("alloc_seq", "end_seq", "alloc_addr", "alloc_size")
    end = F.col("alloc_addr") + F.col("alloc_size") - 1
    held = bucketed(allocs).select("run_id", "bits", F.col("seq").alias("alloc_seq"), *who[1:])
    held = held.withColumn("bucket", F.explode(F.sequence(bucket_of(F.col("alloc_addr"), F.col("bits")), bucket_of(end, F.col("bits")))))
    begin = F.struct(F.col("alloc_seq").alias("seq"), F.lit(1).alias("first"))
    finish = F.struct(F.coalesce("end_seq", F.lit(NEVER)).alias("seq"), F.lit(0).alias("first"))
    events = held.select(*BUCKET, *who, F.explode(F.array(begin, finish)).alias("x")).select(*BUCKET, *who, "x.*")
    events = running(events, BUCKET, ("seq", "first", "alloc_seq"), bits, begun=F.col("first"))
    # The slice of an event: an allocation's own where it begins, the last that it reaches into where it ends.
    at = F.floor((F.col("begun") - 1) / size)
    spans = events.groupBy(*BUCKET, *who).agg(F.min(at).alias("low"), F.max(F.when(F.col("first") == 0, at)).alias("high"))
    spans = spans.withColumn("slice", F.explode(F.sequence("low", "high")))
    own = F.min(F.when(F.col("slice") == F.col("low"), F.col("alloc_seq")))
    return spans.groupBy(*BUCKET, "slice").agg(own.alias("seq"), F.collect_list(F.struct(*who)).alias("live")).select(*BUCKET, "seq", "live")


def placed(stores: DataFrame, allocs: DataFrame) -> DataFrame:
    """Each store by its bucket: one row for each of the two kinds of bucket that the store's run has.

    The kinds, two rows a run at most, are broadcast: a join by run would send all stores of a run to one task.
    """
    kinds = bucketed(allocs).select("run_id", "bits").distinct()
    rows = stores.select("run_id", "seq", "addr", "value").join(F.broadcast(kinds), "run_id")
    return rows.withColumn("bucket", bucket_of(F.col("addr"), F.col("bits")))


def attribute_stores(stores: DataFrame, allocs: DataFrame, bits: int = RANGE_BITS, size: int = SLICE) -> DataFrame:
    """A5: each store with the newest allocation that is live at its seq and holds its address.

    A sweep over each bucket: stores and slices of time in one order of seq, in ranges of 2**bits of it, so that a page that takes most stores is
    many tasks' work. A store takes the slice before it, and looks at the few allocations of that slice; it is never multiplied by
    lifetimes. What an allocation is called and its stack are joined last: no shuffle of stores carries texts.
    """
    rows = placed(stores, allocs)
    near = latest_of(rows, time_slices(allocs, bits, size), BUCKET, "seq", "live", bits)
    holds = lambda a: (
        (F.col("addr") >= a["alloc_addr"]) & (F.col("addr") - a["alloc_addr"] < a["alloc_size"])
        & (a["alloc_seq"] < F.col("seq")) & (a["end_seq"].isNull() | (F.col("seq") < a["end_seq"]))
    )
    found = near.select("run_id", "seq", "addr", "value", F.array_max(F.filter("live", holds))["alloc_seq"].alias("alloc_seq")).where("alloc_seq is not null")
    newest = found.groupBy("run_id", "seq", "addr", "value").agg(F.max("alloc_seq").alias("alloc_seq"))
    names = allocs.select("run_id", F.col("seq").alias("alloc_seq"), "alloc_addr", "alloc_size", "generation", "alloc_stack")
    return newest.join(names, ["run_id", "alloc_seq"]).withColumn("offset", F.col("addr") - F.col("alloc_addr"))


def unattributed_stores(stores: DataFrame, attributed: DataFrame, strict: bool = False) -> DataFrame:
    """Stores in no live allocation; strict raises if there are any."""
    out = stores.join(attributed.select("run_id", "seq"), ["run_id", "seq"], "left_anti")
    if strict and not out.isEmpty():
        raise ValueError("there are stores in no live allocation")
    return out


def classify_alignment(attributed: DataFrame) -> DataFrame:
    """alloc_type from the alignment of all of a buffer's offsets."""
    key = ["run_id", "alloc_addr", "generation"]
    kinds = attributed.groupBy(*key).agg(F.bool_and(F.col("offset") % 8 == 0).alias("by8"), F.bool_and(F.col("offset") % 4 == 0).alias("by4"))
    return attributed.join(kinds.select(*key, F.when(F.col("by8"), "64bits").when(F.col("by4"), "32bits").otherwise("object").alias("alloc_type")), key)


def drop_unwritten(allocs: DataFrame, attributed: DataFrame) -> DataFrame:
    """A8"""
    return allocs.join(attributed.select("run_id", "alloc_addr", "generation").distinct(), ["run_id", "alloc_addr", "generation"], "left_semi")


def ingest_log(spark: SparkSession, bench: str, *paths: str, least: int = 4096) -> tuple[DataFrame, DataFrame]:
    """A raw log as a trace, and the stores that belong to no allocation.

    The log is read and parsed once: its events, the allocations and the attributed stores are tables in the folder of spark.checkpoint.dir.
    """
    events = saved(read_trace_log(spark, *paths), "events")
    stores = events.where("kind = 'STORE'").select("run_id", "seq", "addr", "value")
    allocs = saved(min_block_filter(pair_lifetimes(events), least), "allocations")
    attributed = saved(attribute_stores(stores, allocs), "attributed")
    trace = classify_alignment(attributed).select("run_id", F.lit(bench).alias("bench"), "alloc_addr", "alloc_size",
        "alloc_type", "generation", "alloc_stack", "offset", "value", F.col("seq").alias("rn"))
    return trace, unattributed_stores(stores, attributed)


NAME = r"0x([0-9a-fA-F]+)_(\d+)_(64bits|32bits|object)_(\d+)\.stores$"


def read_stores_dir(spark: SparkSession, path: str, bench: str = "") -> tuple[DataFrame, DataFrame]:
    """A10: per-allocation files as a trace, and the names of files that fit no pattern. Lines that fit none are ignored.

    A run is a folder, named by its path below `path` ("." for `path` itself); rn is the line's number in its file, so it orders a buffer's stores.
    """
    rows = file_order(spark, path, recursive=True).withColumnRenamed("run_id", "file")
    bad = rows.where(~F.col("file").rlike(NAME)).select("file").distinct()
    rows = rows.where(F.col("file").rlike(NAME))
    frame = F.regexp_replace("value", r"^#\s?", "").alias("frame")
    heads = rows.where("value like '#%'").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", frame))).alias("x"))
    heads = heads.select("file", F.array_join("x.frame", "\n").alias("alloc_stack"))
    body = r"^(\d+):0x([0-9a-fA-F]+)$"
    part = lambda i: F.regexp_extract("file", NAME, i)
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    trace = rows.where(F.col("value").rlike(body)).join(heads, "file", "left").select(
        F.when(folder == "", ".").otherwise(folder).alias("run_id"), F.lit(bench).alias("bench"), b.from_hex(part(1)).alias("alloc_addr"), part(2).cast("long").alias("alloc_size"),
        part(3).alias("alloc_type"), part(4).cast("long").alias("generation"), F.coalesce("alloc_stack", F.lit("")).alias("alloc_stack"),
        F.regexp_extract("value", body, 1).cast("long").alias("offset"), b.from_hex(F.regexp_extract("value", body, 2)).alias("value"), F.col("seq").alias("rn"),
    )
    return trace, bad


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet trace; unsigned columns become signed bits, rn is the row number in the file where none is stored."""
    df = spark.read.parquet(path)
    if "rn" not in df.columns:
        df = df.select("*", F.col("_metadata.row_index").alias("rn"), run_of(spark, (path,)).alias("run_id"))
    return df.select(*(b.from_unsigned(f.name).alias(f.name) if f.dataType.simpleString().startswith("decimal") else F.col(f.name).cast("long").alias(f.name) if f.name in ("generation",
        "offset", "value", "alloc_addr", "alloc_size") else F.col(f.name) for f in df.schema))


def write_trace(t: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Zstd Parquet, one folder per bench; only the benches written are replaced."""
    t.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("bench").parquet(path)


def all_stores(spark: SparkSession, path: str, views: bool = False) -> DataFrame:
    """All benches of a folder written by write_trace(); with views, also a view per bench and `all_stores`."""
    df = spark.read.parquet(path)
    if views:
        df.createOrReplaceTempView("all_stores")
        for row in df.select("bench").distinct().collect():  # a name per bench
            df.where(F.col("bench") == row.bench).createOrReplaceTempView(view_name(row.bench))
    return df


def stale_sources(spark: SparkSession, source: str, manifest: DataFrame | None, force: bool = False) -> DataFrame:
    """Files of `source` that are newer than the manifest (path, modified) says, or not in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", F.col("modificationTime").alias("modified"))
    if manifest is None or force:
        return files
    return files.join(manifest.select("path", F.col("modified").alias("seen")), "path", "left").where("seen is null or seen < modified").select("path", "modified")


def save_result(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Writes the benches that `path` has not yet, and says how many rows; what is finished is left alone.

    A call writes one folder, batch=<name>. A folder without the mark of a finished job does not count, and goes.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [x.getPath() for x in files.listStatus(top)] if files.exists(top) else []
    for folder in [x for x in folders if x.getName().startswith("batch=")]:
        if files.exists(hadoop.Path(folder, "_SUCCESS")):
            df = df.join(spark.read.format(fmt).option("header", "true").load(folder.toString()).select("bench").distinct(), "bench", "left_anti")
        else:
            files.delete(folder, True)
    at, rows = f"{path}/batch={uuid.uuid4().hex}", Observation()
    df.observe(rows, F.count("*").alias("n")).write.format(fmt).option("header", "true").save(at)
    if not rows.get["n"]:
        files.delete(hadoop.Path(at), True)
    return rows.get["n"]


def parse_site_listing(spark: SparkSession, *paths: str) -> DataFrame:
    """Addr, fn, bytes of the sites listed."""
    p = r"MXSITE 0x([0-9a-fA-F]+) (\S+) (\d+)"
    rows = spark.read.text(list(paths)).where(F.col("value").rlike(p))
    return rows.groupBy(b.from_hex(F.regexp_extract("value", p, 1)).alias("addr"), F.regexp_extract("value", p, 2).alias("fn")).agg(F.sum(F.regexp_extract("value", p, 3).cast("long")).alias("bytes"))


def parse_mem_reference_trace(spark: SparkSession, *paths: str) -> DataFrame:
    """run_id, seq, kind (I, L, S, M), addr, size."""
    p = r"^\s*([ILSM])\s+([0-9a-fA-F]+),(\d+)"
    rows = file_order(spark, *paths).where(F.col("value").rlike(p))
    return rows.select("run_id", "seq", F.regexp_extract("value", p, 1).alias("kind"), b.from_hex(F.regexp_extract("value",
        p, 2)).alias("addr"), F.regexp_extract("value", p, 3).cast("long").alias("size"))
