"""A Merkle manifest of a dataset, built as a postorder append log.

Rows are leaves; the leaves of a language, in order of doc_id, are a *run* with a tree of its own, and the roots of all runs are
the leaves of one more run. An aligned *builder* owns 2**levels consecutive leaves of a run and appends nodes in the order in which they are
completed. The place of any node in the run's log follows from the run's length alone (`position`), so siblings are found by
arithmetic with the sizes of subtrees, without links between nodes. The roots of a run's builders are the leaves of the next tier of builders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import in_order
from .shared import freed, keyed, tidy, written

LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def position(level: int, index: int, leaves: int) -> int:
    """The place, from 0, in the postorder log of a tree over so many leaves, of the index-th node (from 0) of a level.

    It is completed by its last leaf, m: m leaves and their completed parents (2 * m less the bits of m) come before that
    leaf, and the node's `level` descendants along its right edge come between.
    """
    last = min((index + 1) << level, leaves) - 1
    return 2 * last - last.bit_count() + level


def subtree_size(level: int, index: int, leaves: int) -> int:
    """Nodes of the subtree below a node, itself included."""
    first = index << level
    return position(level, index, leaves) - (2 * first - first.bit_count()) + 1


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def sibling_positions(leaf: int, leaves: int, levels: int | None = None) -> list[tuple[str, int]]:
    """('L' or 'R', place) of the siblings on the way up, level by level; ('N', -1) where a node has none.

    A left sibling ends where the subtree beside it begins; a right sibling is as many nodes further as it has itself.
    """
    out = []
    for level in range(height(leaves) if levels is None else levels):
        index, own = leaf >> level, position(level, leaf >> level, leaves)
        if index & 1:
            out.append(("L", own - subtree_size(level, index, leaves)))
        elif (index + 1) << level < leaves:
            out.append(("R", own + subtree_size(level, index + 1, leaves)))
        else:
            out.append(("N", -1))
    return out


def joined(*digests: bytes) -> bytes:
    """H: the hash of digests as hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """A builder's nodes in the order of their completion, up to the one node of the last level."""
    log: list[bytes] = []
    waiting: list[bytes | None] = [None] * (levels + 1)  # by level: a left child whose sibling is not complete yet

    def complete(node: bytes, level: int) -> None:
        log.append(node)
        while level < levels and waiting[level] is not None:
            node, waiting[level] = joined(waiting[level], node), None
            level += 1
            log.append(node)
        waiting[level] = node

    for leaf in leaves:
        complete(leaf, 0)
    for level in range(levels):  # what waits for a sibling that doesn't come
        if waiting[level] is not None:
            node, waiting[level] = joined(waiting[level]), None
            complete(node, level + 1)
    return log


def folded(leaf: bytes, steps: list[bytes]) -> bytes:
    """The root that a leaf and its siblings give; a step is a side, L, R or N, and the sibling's digest."""
    for step in steps:
        side, sibling = step[:1], step[1:]
        leaf = joined(sibling, leaf) if side == b"L" else joined(leaf, sibling) if side == b"R" else joined(leaf)
    return leaf


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(fields[c]) for c in FIELDS)), 256)


SEGMENT = "run string, builder long, leaves long, entries array<struct<doc_id:bigint,claimed:binary>>, log binary, root binary"


def build_tier(nodes: DataFrame, levels: int) -> DataFrame:
    """run, place, total, doc_id, digest, claimed -> a segment of the log for each builder.

    `log` holds the builder's nodes one after another, 32 bytes each. A run's only builder goes up to the run's root, others `levels` levels.
    """

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        total, digests = rows.column("total")[0].as_py(), rows.column("digest").to_pylist()
        log = append_log(digests, levels_up(total, levels))
        entries = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in ("doc_id", "claimed")], ["doc_id", "claimed"])
        entries = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), entries)
        one = [pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int64()), pa.array([total], pa.int64()), entries, pa.array([b"".join(log)], pa.binary()), pa.array([log[-1]], pa.binary())]
        return pa.Table.from_arrays(one, ["run", "builder", "leaves", "entries", "log", "root"])

    builder = F.shiftright("place", levels).alias("builder")
    return written(nodes.select("run", builder, "place", "total", "doc_id", "digest", "claimed").groupBy("run", "builder").applyInArrow(build, SEGMENT), "manifest")


def build_log(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The tiers of builders over the runs of `leaves` (run, place, total, doc_id, digest, claimed), the leaves' own first.

    Each tier has a 2**levels-th of the rows below it; a run leaves off at the tier where it has one builder.
    """
    tiers = [build_tier(leaves, levels)]
    while True:
        open_ = tiers[-1].where(F.col("leaves") > 1 << levels)
        if open_.isEmpty():
            return tiers
        up = F.ceil(F.col("leaves") / (1 << levels)).cast("long")
        none = F.lit(None)
        tiers.append(build_tier(open_.select("run", F.col("builder").alias("place"), up.alias("total"), none.cast("long").alias("doc_id"), F.col("root").alias("digest"), none.cast("binary").alias("claimed")), levels))


def levels_up(leaves: int, levels: int) -> int:
    """Levels that a builder goes up in a run of so many leaves."""
    return height(leaves) if leaves <= 1 << levels else levels


def own_leaves(builder: int, leaves: int, levels: int) -> int:
    return min(1 << levels, leaves - (builder << levels))


def own_steps(builder: int, leaves: int, log: bytes, levels: int) -> Iterator[list[bytes]]:
    """Of each of a builder's leaves, the steps from it up to the builder's root, read from the builder's part of the log."""
    up, count = levels_up(leaves, levels), own_leaves(builder, leaves, levels)
    for at in range(count):
        yield [side.encode() + (log[32 * p : 32 * p + 32] if p >= 0 else b"") for side, p in sibling_positions(at, count, up)]


def child_steps(segments: DataFrame, levels: int) -> DataFrame:
    """run, builder, steps: for each child builder of a tier's segments, its way up to the root (`tail` is the segment's own way)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for at, steps in enumerate(own_steps(r["builder"], r["leaves"], r["log"], levels)):
                    out.append({"run": r["run"], "builder": (r["builder"] << levels) + at, "tail": steps + r["tail"]})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("run", pa.string()), ("builder", pa.int64()), ("tail", pa.list_(pa.binary()))]))

    return segments.mapInArrow(freed(run), "run string, builder long, tail array<binary>")


def log_rows(tiers: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """run, level, position, digest: the runs' logs node by node, at the places that `position` gives in the whole run's log."""

    def rows_of(tier: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("run", pa.string()), ("level", pa.int32()), ("position", pa.int64()), ("digest", pa.binary())])
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    count = own_leaves(r["builder"], r["leaves"], levels)
                    for level in range(1 if tier else 0, levels_up(r["leaves"], levels) + 1):
                        for i in range(-(-count >> level)):
                            p = position(level, i, count)
                            whole = (r["builder"] << (levels - level)) + i
                            out.append({"run": r["run"], "level": level + tier * levels, "position": position(level + tier * levels, whole, r["run_leaves"]), "digest": r["log"][32 * p : 32 * p + 32]})
                yield pa.RecordBatch.from_pylist(out, schema)

        return freed(run)

    lengths = tiers[0].groupBy("run").agg(F.max("leaves").alias("run_leaves"))
    parts = [t.join(lengths, "run").mapInArrow(rows_of(k), "run string, level int, position long, digest binary") for k, t in enumerate(tiers)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prove(docs: DataFrame, claimed: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified: per row of `docs`, its proof in the manifest and what it proves.

    `claimed` has other values of some fields, as someone may present them: folded_root comes from the claimed row and the manifest's siblings, and
    verified says whether it is the root. `proof` lists the steps: a side (L, R, or N for none) and the sibling's 32 bytes.
    Rows of a language ascend by doc_id (null first); rows of one doc_id by their leaf; rows that are alike are leaves of their own. A null
    language is a run, the first one. A single run has the root of its own. No rows give no rows.
    """
    spark = docs.sparkSession
    plain = {c: F.col(c) for c in FIELDS}
    original = leaf_of(plain)
    other = leaf_of(plain | (claimed or {}))
    run = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    with tidy(spark):
        rows = keyed(docs, *FIELDS).select(run.alias("run"), "doc_id", original.alias("leaf"), other.alias("other"), "rk_f", "rk_r")
        rows = written(rows.select("run", F.col("doc_id").cast("long").alias("doc_id"), F.unhex("leaf").alias("digest"), F.when(F.col("leaf") != F.col("other"), F.unhex("other")).alias("claimed"), "rk_f", "rk_r"), "leaves")
        tiers = build_log(in_order(rows, "run", F.col("doc_id"), F.col("digest"), F.col("rk_f"), F.col("rk_r")), levels)
        tops = [t.where(F.col("leaves") <= 1 << levels).select("run", F.col("root").alias("subroot")) for t in tiers]
        subroots = tops[0]
        for t in tops[1:]:
            subroots = subroots.unionByName(t)
        subroots = written(subroots.withColumn("all", F.lit("all")), "subroots")
        none = F.lit(None)
        ordered = written(in_order(subroots, "all", F.col("run")), "runs")
        over = build_log(ordered.select(F.lit("all").alias("run"), "place", "total", none.cast("long").alias("doc_id"), F.col("subroot").alias("digest"), none.cast("binary").alias("claimed")), levels)
        start = over[-1].withColumn("tail", F.array().cast("array<binary>"))
        for below in (*reversed(over[:-1]), None):
            steps = child_steps(start, levels)
            if below is not None:
                start = below.join(steps, ["run", "builder"])
        top = over[-1].select(F.col("root").alias("top"))
        ways = ordered.join(steps.select(F.col("builder").alias("place"), "tail"), "place").select("run", "subroot", "tail")
        ways = written(ways.crossJoin(F.broadcast(top)), "ways")  # one root
        down = None
        for k in range(len(tiers) - 1, -1, -1):
            ended = tiers[k].where(F.col("leaves") <= 1 << levels).join(ways.select("run", "tail"), "run")
            segments = ended if down is None else ended.unionByName(tiers[k].where(F.col("leaves") > 1 << levels).join(down, ["run", "builder"]))
            if k:
                down = written(child_steps(segments, levels), "ways_down")
        segments = segments.join(ways.select("run", "subroot", "top"), "run")

    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(pa.binary())), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out = []
                count = own_leaves(r["builder"], r["leaves"], levels)
                for at, (entry, steps) in enumerate(zip(r["entries"], own_steps(r["builder"], r["leaves"], r["log"], levels), strict=True)):
                    p = 32 * position(0, at, count)
                    leaf, steps = r["log"][p : p + 32], steps + r["tail"]
                    got = folded(entry["claimed"] or leaf, steps)
                    out.append((entry["doc_id"], leaf.hex(), r["subroot"].hex(), r["top"].hex(), steps, joined(*(s[1:] for s in steps)).hex(), got.hex(), got == r["top"]))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return segments.mapInArrow(freed(proofs), "doc_id long, leaf string, subroot string, root string, proof array<binary>, proof_sha256 string, folded_root string, verified boolean")
