"""Spark helpers of the corpus operators: row keys, written tables, Arrow schemas."""

from __future__ import annotations

import contextlib
import ctypes
import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a batch that goes to Python; a row that is longer goes alone.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
    return path


def small_batches(spark: SparkSession) -> None:
    """Batches sent to Python have a few MB from now on, unless the session has its own bounds: whole texts are held on both sides.

    Frames that an operator returns run later, in the caller's session, so the setting stays.
    """
    for name, value in (("maxRecordsPerBatch", "4000"), ("maxBytesPerBatch", str(BATCH_BYTES))):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """For the plans run inside: shuffle files go when each ends, not when the driver's memory is next collected."""
    small_batches(spark)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def freed(run: Callable, keep: bool = False) -> Callable:
    """The function of mapInArrow, with the memory that a task no longer uses given back when it ends: workers live on between tasks.

    With `keep`, up to 64 MB that are freed stay for the next arrays until then, instead of being fetched again page by page.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if keep:
            with contextlib.suppress(AttributeError, OSError):
                for name, size in ((-3, 32 << 20), (-1, 64 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
                    ctypes.CDLL(None).mallopt(name, size)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return work


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Deletes tables of written() that no later plan reads."""
    for df in frames:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns named, plus rk_f and rk_r, which name each row: file and row number.

    The key is the same in every pass over the table, also after a task is run again. Frames that don't come
    straight from files are written to the shared folder first. Repeated rows keep different keys.
    """
    pick = [F.col(c) for c in columns]
    key = [F.xxhash64("_metadata.file_path").alias("rk_f"), F.col("_metadata.row_index").alias("rk_r")]
    try:
        return df.select(*pick, *key)
    except AnalysisException:
        return written(df.select(*pick), "rows").select(*pick, *key)


def tasks_for(df: DataFrame, mb: int = 64) -> int:
    """A number of partitions that follows the size of the tables read, at least the session's own.

    Only leaves of known size count: rows that come from Python have no size in the plan, so Spark takes its largest number.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, math.ceil(known / (mb << 20))))


def packed_texts(docs: DataFrame) -> DataFrame:
    """`packed` instead of `text`: each text compressed on its own, for a shuffle of whole texts (null stays null)."""
    schema = docs.drop("text").schema.add("packed", "binary")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            texts = [None if x is None else pack(x.encode()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(texts, pa.binary())], names)

    return docs.select(*names[:-1], "text").mapInArrow(freed(run), schema)


def unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with `text` again; a null counts as empty."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts = pa.array([b"" if x is None else unpack(x) for x in batch.column("packed").to_pylist()], pa.large_binary())
    names = [*(n for n in batch.schema.names if n != "packed"), "text"]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), texts], names)
