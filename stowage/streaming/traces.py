"""Streaming forms of the stateful computations: attribution, silent stores, counters.

State is kept per key in the state store, read and written entry by entry (RocksDB; `run_available` turns it on where a session has
another). Events may come in any order within a micro-batch. What comes a micro-batch too late is told apart, not guessed.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stowage.functions import bits as b
from stowage.operators.cells import BUFFER
from stowage.sources.saved import shared_folder

AREA = 12  # bits of the addresses that share a key
PAGE = 12  # bits of the addresses whose live blocks are looked through for a store
OFFSETS = 12  # bits of the offsets that share a key
NEVER = 2**63 - 1
PART = 1 << 16  # rows that are plain Python numbers at a time

LIFETIME = "run_id string, seq long, addr long, value long, generation long, end_seq long"
ATTRIBUTED = "run_id string, seq long, addr long, value long, alloc_addr long, alloc_size long, generation long, offset long, status string"
SILENT = "bench string, alloc_type string, stores_with_prev long, silent long, late long"


def longs(rows: Iterator[pd.DataFrame], *names: str) -> list[np.ndarray]:
    """Columns of a key's frames, which come in parts; none has a null, so 64 bits stay what they are."""
    parts = [[f[name].to_numpy(np.int64) for name in names] for f in rows]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


class Lifetimes(StatefulProcessor):
    """Per start address of a run: counts generations, and says when the block there begins and ends, in one row if a batch has both (end_seq NEVER: is open).

    A further allocation at a live start ends the block before it. Events before the last one of their address are dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.block = handle.getValueState("block", "generation long, alloc_seq long, size long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        generation, begun, size, last = self.block.get() if self.block.exists() else (0, -1, 0, -1)
        before = last
        seqs, sizes, begins = longs(rows, "seq", "size", "begins")
        order = np.argsort(seqs, kind="stable")
        for at in range(0, len(order), PART):
            part, out = order[at : at + PART], []
            for seq, asked, begin in zip(seqs[part].tolist(), sizes[part].tolist(), begins[part].tolist(), strict=True):
                if seq <= last:
                    continue
                last = seq
                if begun >= 0:
                    out.append((begun, size, generation, seq))
                    begun = -1
                if begin:
                    generation, begun, size = generation + 1, seq, asked
            yield self.lifetimes(key, out)
        if begun > before:
            yield self.lifetimes(key, [(begun, size, generation, NEVER)])
        self.block.update((generation, begun, size, last))

    @staticmethod
    def lifetimes(key: tuple, out: list[tuple]) -> pd.DataFrame:
        seq, size, generation, end = np.array(out, np.int64).reshape(-1, 4).T
        return pd.DataFrame({"run_id": key[0], "seq": seq, "addr": np.int64(key[1]), "value": size, "generation": generation, "end_seq": end})

    def close(self) -> None:
        pass


def newest_holders(seq: np.ndarray, addr: np.ndarray, blocks: list[tuple], low: int, high: int) -> np.ndarray:
    """For each store the place in `blocks` (alloc_seq, addr, size, end_seq; by alloc_seq) of the newest that is live at its seq and holds its address; -1: none.

    One sweep over time. Live blocks are kept by page, so a store looks at few of them: at one time they hardly overlap. `low` and `high` are the
    pages that stores may be in; a block is known in the part of these that it covers. At one seq a block's end comes before stores, its begin after.
    """
    begun, start, size, end = np.array(blocks, np.int64).reshape(-1, 4).T
    n, stores = len(begun), len(seq)
    times = np.concatenate([end, seq, begun])
    order = np.lexsort((np.repeat(np.arange(3, dtype=np.int8), [n, stores, n]), times))
    first, past = np.maximum(start >> PAGE, low).tolist(), (np.minimum((start + size - 1) >> PAGE, high) + 1).tolist()
    start, stop = start.tolist(), (start + size).tolist()
    owner, live = np.full(stores, -1, np.int64), {}
    for at in range(0, len(order), PART):
        part = order[at : at + PART]
        where = addr[np.clip(part - n, 0, max(stores - 1, 0))].tolist() if stores else [0] * len(part)
        places, owners = [], []
        for i, a in zip(part.tolist(), where, strict=True):
            if i < n:
                for page in range(first[i], past[i]):
                    live[page].pop(i)
            elif i < n + stores:
                for block in reversed(live.get(a >> PAGE, ())):
                    if start[block] <= a < stop[block]:
                        places.append(i - n)
                        owners.append(block)
                        break
            else:
                i -= n + stores
                for page in range(first[i], past[i]):
                    live.setdefault(page, {})[i] = None
        owner[places] = owners
    return owner


class Attribution(StatefulProcessor):
    """Per area of addresses: its live blocks, one entry each, and the last seq. Stores are those rows whose end_seq is negative."""

    def __init__(self, area: int = AREA):
        self.area = area

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "alloc_seq long", "addr long, size long, generation long")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run, area = key
        seq, addr, value, generation, end = longs(rows, "seq", "addr", "value", "generation", "end_seq")
        last = self.last.get()[0] if self.last.exists() else -1
        known = {k[0]: (*v, NEVER) for k, v in self.live.iterator()}
        is_block = end >= 0
        told = [x[is_block] for x in (seq, addr, value, generation, end)]
        blocks = known | dict(zip(told[0].tolist(), zip(*(x.tolist() for x in told[1:]), strict=True), strict=True))
        for begun, (*block, ended) in blocks.items():
            if ended == NEVER and begun not in known:
                self.live.updateValue((begun,), tuple(block))
            elif ended != NEVER and begun in known:
                self.live.removeKey((begun,))
        seen = max(last, *(int(x.max(initial=-1)) for x in (seq, np.where(end == NEVER, -1, end))))
        self.last.update((seen,))

        seq, addr, value = (x[~is_block] for x in (seq, addr, value))
        ordered = sorted(blocks)
        pages = (area << self.area) >> PAGE, ((area + 1 << self.area) - 1) >> PAGE
        owner = newest_holders(seq, addr, [(x, *blocks[x][:2], blocks[x][3]) for x in ordered], *pages)
        late = seq <= last
        owner[late] = -1
        names = np.array([blocks[x][:3] for x in ordered] or [(0, 0, 0)], np.int64)
        for at in range(0, len(seq), PART):
            part = slice(at, at + PART)
            none = owner[part] < 0
            of_block = names[np.maximum(owner[part], 0)].T
            columns = {"alloc_addr": of_block[0], "alloc_size": of_block[1], "generation": of_block[2], "offset": addr[part] - of_block[0]}
            out = pd.DataFrame({"run_id": run, "seq": seq[part], "addr": addr[part], "value": value[part]})
            for name, x in columns.items():
                out[name] = pd.arrays.IntegerArray(np.ascontiguousarray(x), none.copy())
            out["status"] = np.where(late[part], "late", np.where(none, "unattributed", "ok"))
            yield out

    def close(self) -> None:
        pass


def stream_attribute(events: DataFrame, area: int = AREA) -> DataFrame:
    """H1: events (run_id, seq, kind, addr, size, value) -> stores with their allocation.

    Two stateful steps: lifetimes by start address, where generations are counted; then stores and the lifetimes that reach into an area of 2**area
    bytes, by area. So a run's events are many keys' work, and a large block is known in each area that it covers (one row a page, where a store takes
    a row itself). A step is in proportion to its events.
    status: "ok"; "unattributed" (no live allocation); "late" (a batch after its area had passed its seq).
    """
    begins = (F.col("kind") == "ALLOC").cast("long").alias("begins")
    heap = events.where("kind in ('ALLOC', 'FREE')").select("run_id", "addr", "seq", begins, F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    lifetimes = heap.groupBy("run_id", "addr").transformWithStateInPandas(Lifetimes(), LIFETIME, "append", "none")
    last = F.col("addr") + F.col("value") - 1
    lifetimes = lifetimes.where("value > 0").withColumn("area", F.explode(F.sequence(F.shiftright("addr", area), F.shiftright(last, area))))
    stores = events.where("kind = 'STORE'").select(
        "run_id", F.shiftright("addr", area).alias("area"), "seq", "addr", F.coalesce("value", F.lit(0)).cast("long").alias("value"),
        F.lit(0).cast("long").alias("generation"), F.lit(-1).cast("long").alias("end_seq"),
    )
    both = stores.unionByName(lifetimes)
    return both.groupBy("run_id", "area").transformWithStateInPandas(Attribution(area), ATTRIBUTED, "append", "none")


class Silent(StatefulProcessor):
    """Per buffer and range of offsets: an entry per cell with its last store, kept for `ttl` after it was last written if that is set."""

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "offset long", "rn long, value long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["offset", "rn", "value"], kind="stable")
        offset, rn, value = (batch[c].to_numpy(np.int64) for c in ("offset", "rn", "value"))
        starts = np.flatnonzero(np.append(True, offset[1:] != offset[:-1]))
        ends = np.append(starts[1:], len(offset))
        pairs = silent = late = 0
        for low, high in zip(starts.tolist(), ends.tolist(), strict=True):  # one entry read and written for each cell of the batch
            cell = (int(offset[low]),)
            known = self.cells.getValue(cell) if self.cells.containsKey(cell) else None
            if known is not None:
                skipped = int(np.searchsorted(rn[low:high], known[0], "left"))
                late, low = late + skipped, low + skipped
                if low == high:
                    continue
                pairs, silent = pairs + 1, silent + int(known[1] == value[low])
            pairs, silent = pairs + high - low - 1, silent + int((value[low + 1 : high] == value[low : high - 1]).sum())
            self.cells.updateValue(cell, (int(rn[high - 1]), int(value[high - 1])))
        yield pd.DataFrame({"bench": [key[1]], "alloc_type": [batch["alloc_type"].iloc[0]], "stores_with_prev": [pairs], "silent": [silent], "late": [late]})

    def close(self) -> None:
        pass


def stream_silent(stores: DataFrame, ttl: int | None = None, offsets: int = OFFSETS) -> DataFrame:
    """H2: per batch and part of a buffer, how many stores had a predecessor in their cell and repeated it; sums of the rows are the totals.

    Stores of a batch are ordered by rn within their cell, whatever order they come in. A store before the last one that its cell has seen in
    earlier batches is counted as late, and compared with nothing. ttl (milliseconds) forgets cells that are not written any more; such a stream
    goes by the clock, so it has no end under a trigger of what is available.
    """
    rows = stores.select(*BUFFER, F.shiftright("offset", offsets).alias("part"), "alloc_type", "offset", "value", "rn")
    return rows.groupBy(*BUFFER, "part").transformWithStateInPandas(Silent(ttl), SILENT, "append", "none" if ttl is None else "processingTime")


def stream_summary(stores: DataFrame) -> DataFrame:
    """H3: running counters of C01, C05, C06 and C15 per bench; distinct allocations are estimated, as exact ones would need unbounded state."""
    o, v, high = F.col("offset"), F.col("value"), b.top_bits("value", 8)
    e, x = b.biased_exp("alloc_type", "value"), b.normal_exp("alloc_type", "value")
    return stores.groupBy("bench").agg(
        F.count("*").alias("stores"), F.approx_count_distinct(F.struct("run_id", "alloc_addr", "generation")).alias("allocations"),
        *(F.count_if(F.col("alloc_type") == kind).alias(f"stores_{name}") for kind, name in (("64bits", "64"), ("32bits", "32"), ("object", "object"))),
        F.count_if(v == 0).alias("zero"), F.count_if((v != 0) & (high == 0)).alias("nonzero_top_byte_zero"), F.count_if(high != 0).alias("nonzero_top_byte_nonzero"),
        F.count_if(o % 8 == 0).alias("aligned_8b"), F.count_if((o % 8 != 0) & (o % 4 == 0)).alias("aligned_4b_only"), F.count_if(o % 4 != 0).alias("unaligned"),
        F.count_if(b.is_normal("alloc_type", "value")).alias("normal"), F.count_if((e == 0) & (v != 0)).alias("denormal"), F.count_if(e == b.exp_special("alloc_type")).alias("inf_nan"),
        F.min(x).alias("min_exp"), F.max(x).alias("max_exp"),
    )


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """For streams started inside: a state store that keeps entries apart, unless the session names one itself."""
    own = spark.conf.get(PROVIDER, None)
    keep = own is not None and "HDFSBacked" not in own
    if not keep:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if not keep:
            spark.conf.unset(PROVIDER) if own is None else spark.conf.set(PROVIDER, own)


def run_available(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and gives its result as a table in the shared folder.

    A batch writes a folder of its own, so a batch that is run again after a failure replaces what it wrote before.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={n}")

    with keyed_state(spark):
        stream = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
        stream.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out").select(*df.columns)
