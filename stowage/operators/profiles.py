"""Operators on profile tables: line costs, call graphs, heap snapshots and heap points.

A cost profile is long: run, file, fn, line, event, n. A call table is caller, callee, calls, n. Heap snapshots are run,
snapshot, time, heap, extra, stacks; heap points have a stack of frames and additive counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import bits as b
from stowage.operators.stores import r9, top
from stowage.sources.saved import saved


def merge_profiles(p: DataFrame) -> DataFrame:
    """the counts of all runs added up."""
    return p.groupBy("file", "fn", "line", "event").agg(F.sum("n").alias("n"))


def diff_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """after - before per file and function; lines of different versions don't correspond, so they are summed."""
    signed = after.select("file", "fn", "event", "n").unionByName(before.select("file", "fn", "event", (-F.col("n")).alias("n")))
    return signed.groupBy("file", "fn", "event").agg(F.sum("n").alias("n")).withColumn("line", F.lit(0))


def rename_profiles(p: DataFrame, file_pattern: tuple[str, str] | None = None, fn_pattern: tuple[str, str] | None = None) -> DataFrame:
    """search and replace in names, so that versions line up before they are grouped."""
    for column, pattern in (("file", file_pattern), ("fn", fn_pattern)):
        if pattern:
            p = p.withColumn(column, F.regexp_replace(column, *pattern))
    return p


def profile_rollup(p: DataFrame, event: str, by: str = "file:fn", threshold: float = 0.1) -> DataFrame:
    """inner totals of at least `threshold` percent of all, under outer totals; shares and running shares of the outer ones."""
    outer, inner = by.split(":")
    rows = p.where(F.col("event") == event).groupBy(outer, inner).agg(F.sum("n").alias("inner_n"))
    outers = rows.groupBy(outer).agg(F.sum("inner_n").alias("outer_n"))
    total = outers.agg(F.sum("outer_n").alias("total"))
    kept = rows.crossJoin(F.broadcast(total)).where(100 * F.abs("inner_n") >= threshold * F.abs("total"))
    order = Window.partitionBy().orderBy(F.desc(F.abs("outer_n")), outer).rowsBetween(Window.unboundedPreceding, 0)
    ranked = outers.join(kept.select(outer).distinct(), outer, "left_semi").withColumn("cum_n", F.sum("outer_n").over(order))  # at most 100 / threshold rows pass
    return kept.join(ranked, outer).select(outer, inner, "outer_n", "inner_n", r9(100 * b.ratio("inner_n", "total")).alias("inner_pct"),
        r9(100 * b.ratio("outer_n", "total")).alias("outer_pct"), r9(100 * b.ratio("cum_n", "total")).alias("cum_pct"))


def line_costs(p: DataFrame) -> DataFrame:
    """F6"""
    return p.groupBy("file", "line", "event").agg(F.sum("n").alias("n"))


def attribution_summary(p: DataFrame, event: str, readable: DataFrame, threshold: float = 0.1) -> DataFrame:
    """counts by how far they can be attributed; `readable` has file and stale of the sources at hand."""
    rows = p.where(F.col("event") == event).join(readable.select("file", "stale"), "file", "left")
    total = p.where(F.col("event") == event).agg(F.sum("n").alias("total"))
    files = rows.groupBy("file").agg(F.sum("n").alias("file_n"))
    rows = rows.join(files, "file").crossJoin(F.broadcast(total))
    small = 100 * F.abs("file_n") < threshold * F.abs("total")
    known, line = F.col("file") != "???", F.col("line") > 0
    kind = (
        F.when(~known, "unidentified_file").when(small, "below_threshold").when(F.col("stale").isNull(), "unreadable")
        .when(~line, "known_file_no_line").when(F.col("stale"), "stale_source").otherwise("annotated")
    )
    return rows.groupBy(kind.alias("class")).agg(F.sum("n").alias("n"))


def call_costs(self_costs: DataFrame, calls: DataFrame) -> DataFrame:
    """per function its own cost, and with what it calls (calls: caller, callee, calls, n)."""
    own = self_costs.groupBy("fn").agg(F.sum("n").alias("self_n"))
    called = calls.where("caller <> callee").groupBy(F.col("caller").alias("fn")).agg(F.sum("n").alias("called_n"))
    out = own.join(called, "fn", "full_outer")
    return out.select("fn", F.coalesce("self_n", F.lit(0)).alias("self_n"), (F.coalesce("self_n", F.lit(0)) + F.coalesce("called_n", F.lit(0))).alias("inclusive_n"))


def functions_to_threshold(costs: DataFrame, column: str, percent: float = 99.0) -> DataFrame:
    """F8: functions by falling cost while what comes before is under `percent` of all."""
    order = Window.partitionBy().orderBy(F.desc(column), "fn").rowsBetween(Window.unboundedPreceding, -1)  # one row per function
    total = F.sum(column).over(Window.partitionBy())
    rows = costs.withColumns({"before": F.coalesce(F.sum(column).over(order), F.lit(0)), "total": total})
    return rows.where(100 * F.col("before") < percent * F.col("total")).select("fn", column, r9(100 * F.col(column) / F.col("total")).alias("pct"))


def caller_callee_tree(calls: DataFrame) -> DataFrame:
    """each function's callers and callees, by falling cost."""
    edges = calls.groupBy("caller", "callee").agg(F.sum("calls").alias("calls"), F.sum("n").alias("n"))
    up = edges.select(F.col("callee").alias("fn"), F.lit("caller").alias("role"), F.col("caller").alias("other"), "calls", "n")
    down = edges.select(F.col("caller").alias("fn"), F.lit("callee").alias("role"), F.col("callee").alias("other"), "calls", "n")
    rank = F.row_number().over(Window.partitionBy("fn", "role").orderBy(F.desc("n"), "other"))
    return up.unionByName(down).withColumn("rank", rank)


def heap_snapshots(m: DataFrame) -> DataFrame:
    """totals of every snapshot; the peak is the first of the largest."""
    rows = m.withColumn("total", F.col("heap") + F.col("extra") + F.col("stacks"))
    peak = rows.groupBy("run").agg(F.max_by("snapshot", F.struct("total", -F.col("snapshot"))).alias("peak"))
    return rows.join(peak, "run").select("run", "snapshot", "time", "total", (F.col("snapshot") == F.col("peak")).alias("is_peak"))


def heap_tree_significant(nodes: DataFrame, threshold: float = 1.0) -> DataFrame:
    """nodes (run, snapshot, parent, path, bytes, total) of at least `threshold` percent; small siblings become one row "in n places"."""
    small = 100 * F.col("bytes") < threshold * F.col("total")
    own = nodes.where(~small).select("run", "snapshot", "parent", "path", "bytes", F.lit(1).cast("long").alias("places"))
    rest = nodes.where(small).groupBy("run", "snapshot", "parent").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("places"))
    return own.unionByName(rest.withColumn("path", F.lit("(below threshold)")).select("run", "snapshot", "parent", "path", "bytes", "places"))


def decode_access_counts(acc) -> Column:
    """counts of accesses by offset; a negative entry repeats the value after it, and 0xffff means "too many" (null)."""
    step = lambda s, x: F.when(x < 0, F.struct((-x).alias("times"), s["out"].alias("out"))).otherwise(F.struct(F.lit(1).alias("times"),
        F.concat(s["out"], F.array_repeat(F.when(x < 0xFFFF, x), s["times"])).alias("out")))
    return F.aggregate(F.transform(b.c(acc), lambda x: x.cast("int")), F.struct(F.lit(1).alias("times"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])


#: Levels of the prefix tree that one job adds up.
LEVELS_A_JOB = 8


def prefix_hashes(fs) -> Column:
    """128 bits for every prefix of an array of frames, as two longs; each from the hash of the prefix before it and the next frame."""
    step = lambda s, frame: F.struct(
        F.xxhash64(s["h1"], frame).alias("h1"), F.xxhash64(s["h2"], F.lit(1), frame).alias("h2"),
        F.concat(s["out"], F.array(F.struct(F.xxhash64(s["h1"], frame).alias("h1"), F.xxhash64(s["h2"], F.lit(1), frame).alias("h2")))).alias("out"),
    )
    zero = F.lit(0).cast("long")
    first = F.struct(zero.alias("h1"), zero.alias("h2"), F.array().cast("array<struct<h1:bigint,h2:bigint>>").alias("out"))
    return F.aggregate(b.c(fs), first, step, lambda s: s["out"])


def prefix_nodes(stacks: DataFrame) -> DataFrame:
    """depth, h1, h2, p1, p2 (the parent's hash), stack (the hash of one stack that has the prefix): a row per different prefix.

    `stacks` are different stacks with the hashes of their prefixes. Only hashes are shuffled; the frames stay with the stacks.
    """
    all_ = stacks.select("hs", F.posexplode("hs").alias("i", "h"), F.element_at("hs", -1).alias("leaf"))
    parent = F.get("hs", F.col("i") - 1)
    rows = all_.select((F.col("i") + 1).alias("depth"), "h.h1", "h.h2", parent["h1"].alias("p1"), parent["h2"].alias("p2"), F.col("leaf.h1").alias("stack"))
    return rows.groupBy("depth", "h1", "h2", "p1", "p2").agg(F.min("stack").alias("stack"))


def heap_prefix_tree(points: DataFrame, counters: list[str], compress: bool = False) -> DataFrame:
    """counters added up at every prefix of the points' stacks (fs: outermost frame first).

    Level by level from the longest stacks: a level's nodes are added up by parent, and meet the parents' own points. A level has
    no more rows than it has different prefixes, and nodes go by hashes. LEVELS_A_JOB levels run as one job and are written to the folder of
    spark.checkpoint.dir. Prefixes become arrays of frames at the end, once per node. Points without frames are in no node.
    compress drops prefixes with a single child and no points of their own: the radix form of the tree.
    """
    spark = points.sparkSession
    sums = points.where(F.size("fs") > 0).groupBy("fs").agg(*(F.sum(c).alias(c) for c in counters))  # equal stacks first
    stacks = saved(sums.withColumn("hs", prefix_hashes("fs")), "stacks")
    nodes = saved(prefix_nodes(stacks), "nodes")
    leaf = F.element_at("hs", -1)
    own = stacks.select(leaf["h1"].alias("h1"), leaf["h2"].alias("h2"), F.size("fs").alias("depth"), *counters)
    deepest = own.agg(F.max("depth")).first()[0] or 0
    done: list[DataFrame] = []
    below = None
    key = ["h1", "h2"]
    for top_ in range(deepest, 0, -LEVELS_A_JOB):
        part = []
        for depth in range(top_, max(0, top_ - LEVELS_A_JOB), -1):
            level = nodes.where(F.col("depth") == depth)
            given = own.where(F.col("depth") == depth).select(*key, *counters, F.lit(0).alias("children"), F.lit(True).alias("own"))
            if below is not None:
                up = below.groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2"))
                up = up.agg(*(F.sum(c).alias(c) for c in counters), F.count("*").cast("int").alias("children"), F.lit(False).alias("own"))
                given = given.unionByName(up)
            total = given.groupBy(*key).agg(*(F.sum(c).alias(c) for c in counters), F.sum("children").alias("children"), F.max("own").alias("own"))
            below = total.join(level, key)
            part.append(below)
        whole = part[0]
        for df in part[1:]:
            whole = whole.unionByName(df)
        whole = saved(whole, "levels")
        done.append(whole)
        below = whole.where(F.col("depth") == max(1, top_ - LEVELS_A_JOB + 1))
    if not done:
        return spark.createDataFrame([], points.select(F.col("fs").alias("prefix"), *counters).schema)
    tree = done[0]
    for df in done[1:]:
        tree = tree.unionByName(df)
    if compress:
        tree = tree.where(F.col("own") | (F.col("children") != 1))
    texts = stacks.select(leaf["h1"].alias("stack"), "fs", "hs")
    named = tree.join(texts, "stack").where(F.get("hs", F.col("depth") - 1) == F.struct("h1", "h2"))  # 64 bits find a stack, 128 say that it is right
    return named.select(F.slice("fs", F.lit(1), F.col("depth")).alias("prefix"), *counters)


def heap_metrics(nodes: DataFrame) -> DataFrame:
    """tb, tbk, tl: bytes, blocks and lifetimes; rb, wb: bytes read and written."""
    return nodes.select("prefix", r9(b.ratio("tb", "tbk")).alias("avg_size"), r9(b.ratio("tl", "tbk")).alias("avg_lifetime"),
        r9(b.ratio("rb", "tb")).alias("reads_per_byte"), r9(b.ratio("wb", "tb")).alias("writes_per_byte"))


def heap_presets(total: dict[str, float], short_lived: float) -> dict[str, Column]:
    """name -> condition of a significant node, by the totals of the profile and its bound of a short life. The thresholds."""
    of = lambda c, p: F.col(c) >= p * total[c]
    per = lambda a, x, test: F.coalesce(test(b.ratio(a, x)), F.lit(False))
    read, wrote = F.col("rb") != 0, F.col("wb") != 0
    low = per("rb", "tb", lambda x: x <= 0.4) | per("wb", "tb", lambda x: x <= 0.4)
    high = per("rb", "tb", lambda x: x >= 1000) | per("wb", "tb", lambda x: x >= 1000)
    return {
        "total_bytes": of("tb", 0.01),
        "total_blocks": of("tbk", 0.01),
        "total_blocks_tiny": of("tbk", 0.005) & per("tb", "tbk", lambda x: x <= 16),
        "total_blocks_short_lived": of("tbk", 0.005) & per("tl", "tbk", lambda x: x <= short_lived),
        "total_bytes_zero_reads_or_writes": of("tb", 0.005) & ~(read & wrote),
        "total_blocks_zero_reads_or_writes": of("tbk", 0.005) & ~(read & wrote),
        "total_bytes_low_access": of("tb", 0.005) & read & wrote & low,
        "total_blocks_low_access": of("tbk", 0.005) & read & wrote & low,
        "at_peak_bytes": of("gb", 0.01),
        "at_end_bytes": of("eb", 0.01),
        "reads_bytes": of("rb", 0.01),
        "reads_bytes_high_access": of("rb", 0.005) & high,
        "writes_bytes": of("wb", 0.01),
        "writes_bytes_high_access": of("wb", 0.005) & high,
    }


def heap_preset_nodes(points: DataFrame, counters: list[str], short_lived: float) -> DataFrame:
    """preset, prefix: the significant nodes of every preset, without their ancestors."""
    total = points.agg(*(F.sum(c).alias(c) for c in counters)).first().asDict()
    presets = heap_presets({c: n or 0 for c, n in total.items()}, short_lived)
    tree = heap_prefix_tree(points, counters)
    names = F.filter(F.array(*(F.when(condition, F.lit(name)) for name, condition in presets.items())), lambda x: x.isNotNull())
    return tree.select(F.explode(names).alias("preset"), "prefix")


def heap_significant(tree: DataFrame, condition: Column) -> DataFrame:
    """the nodes that meet the condition and all their ancestors."""
    hit = tree.where(condition).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("prefix")), lambda i: F.slice("prefix", 1, i))).alias("prefix")).distinct()
    return tree.join(hit, "prefix", "left_semi")


def interval_vectors(events: DataFrame, interval: int, bits: int = 20) -> DataFrame:
    """F16: instructions per thread, interval of executed instructions, and block (events: run, thread, seq, block, n_instr).

    The running count is taken in ranges of seq and completed by the sums of the ranges before.
    """
    key = ["run", "thread"]
    rows = events.withColumn("_r", F.shiftright("seq", bits))
    sums = rows.groupBy(*key, "_r").agg(F.sum("n_instr").alias("_s"))
    sums = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(*key).orderBy("_r")) - F.col("_s")).drop("_s")
    inside = F.sum("n_instr").over(Window.partitionBy(*key, "_r").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_instr")
    rows = rows.withColumn("_in", inside).join(sums, [*key, "_r"]).withColumn("interval", F.floor((F.col("_before") + F.col("_in")) / interval))
    return rows.groupBy(*key, "interval", "block").agg(F.sum("n_instr").alias("weight"))


def live_heap_timeline(allocs: DataFrame, bits: int = 20) -> DataFrame:
    """live bytes and blocks after every allocation and free (allocs: run_id, seq, end_seq or null, size).

    Sums run in ranges of seq and are completed by those of the ranges before, so one long run is many tasks' work.
    """
    on = allocs.select("run_id", "seq", F.col("size").alias("d"), F.lit(1).cast("long").alias("k"))
    off = allocs.where("end_seq is not null").select("run_id", F.col("end_seq").alias("seq"), (-F.col("size")).alias("d"), F.lit(-1).cast("long").alias("k"))
    rows = on.unionByName(off).withColumn("_r", F.shiftright("seq", bits))
    before = Window.partitionBy("run_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("run_id", "_r").agg(F.sum("d").alias("d"), F.sum("k").alias("k")).select("run_id", "_r", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in "dk"))
    w = Window.partitionBy("run_id", "_r").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)  # what happens at one seq happens at once
    inside = rows.select("run_id", "_r", "seq", F.sum("d").over(w).alias("d"), F.sum("k").over(w).alias("k"))
    return inside.join(sums, ["run_id", "_r"]).select("run_id", "seq", (F.col("d") + F.col("_d")).alias("live_bytes"), (F.col("k") + F.col("_k")).alias("live_blocks"))


def peak_composition(allocs: DataFrame, k: int = 20) -> DataFrame:
    """what is live at each run's first peak, by site."""
    peak = live_heap_timeline(allocs).groupBy("run_id").agg(F.max_by("seq", F.struct("live_bytes", -F.col("seq"))).alias("peak"))
    live = allocs.join(peak, "run_id").where((F.col("seq") <= F.col("peak")) & (F.col("end_seq").isNull() | (F.col("end_seq") > F.col("peak"))))
    sites = live.groupBy("run_id", "site").agg(F.sum("size").alias("bytes"), F.count("*").alias("blocks"))
    return top(sites, k, "run_id", F.desc("bytes"), "site")
