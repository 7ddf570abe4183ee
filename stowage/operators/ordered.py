"""Analyses that depend on the order of stores, on neighbouring offsets, or on blocks of them.

One buffer, and one cell of it, may hold most rows of a trace. So both are cut into ranges, windows run inside a range, and one row
per range is stitched to the range before. Analyses of cells (cells.py) take a trace or its table of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import bits as b
from stowage.functions.sites import alloc_site
from stowage.operators.cells import BUFFER, CELL, FP, cell_counts, cells, exponent_extents, snapshot
from stowage.operators.ranges import RANGE_BITS, previous, ranked
from stowage.operators.stores import TYPED, buffer_feasibility, per_site, r9, top


def silent_stores(t: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    out = cells(t, bits).groupBy(*TYPED).agg(F.sum("pairs").alias("stores_with_prev"), F.sum("silent").alias("silent"))
    return out.withColumn("silent_frac", r9(b.ratio("silent", "stores_with_prev")))


def buffer_silent(t: DataFrame, keep_all: bool = False, bits: int = RANGE_BITS) -> DataFrame:
    kind = F.min("alloc_type").alias("alloc_type"), F.min("alloc_size").alias("alloc_size")
    out = cells(t, bits).groupBy(*BUFFER).agg(*kind, F.sum("writes").alias("stores"), F.sum("pairs").alias("pairs"), F.sum("silent").alias("silent"))
    return (out if keep_all else out.where("pairs > 0")).withColumn("silent_frac", r9(b.ratio("silent", "pairs")))


def bit_patterns(t: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    t = t.where(FP).select(*BUFFER, "alloc_type", "value", "rn")
    pairs = previous(t, BUFFER, ("rn", "value"), "value", "prev", bits)
    e, m = b.biased_exp("alloc_type", "value"), b.mantissa("alloc_type", "value")
    some = F.col("prev").isNotNull()
    return pairs.groupBy(*TYPED).agg(F.count("*").alias("total"), F.count_if(F.col("value") == 0).alias("zero_values"),
        F.count_if(e == 0).alias("exp_zero"), F.count_if(m == 0).alias("mantissa_zero"), F.count("prev").alias("pairs"),
        F.count_if(some & (F.col("prev") == F.col("value"))).alias("bit_identical"), r9(F.sum(b.hamming("alloc_type",
        "value", "prev")) / F.count("prev")).alias("mean_hamming"))


def write_concentration(t: DataFrame, shares: tuple[int, ...] = (50, 80, 90, 95, 99)) -> DataFrame:
    """How many buffers, largest first, hold a share of a bench's stores; counts of counts instead of a sort of all buffers."""
    each = t.groupBy(*BUFFER).agg(F.count("*").alias("n")).groupBy("bench", "n").agg(F.count("*").alias("m"))
    w = Window.partitionBy("bench").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("bench")
    each = each.withColumns({"rank": F.coalesce(F.sum("m").over(w), F.lit(0)), "sum": F.coalesce(F.sum(F.col("m") * F.col("n")).over(w), F.lit(0)), "total": F.sum(F.col("m") * F.col("n")).over(all_)})
    first = lambda p: F.min(F.when(100 * (F.col("sum") + F.col("n") * F.col("m")) >= p * F.col("total"), F.col("rank") + F.greatest(F.lit(1),
        F.ceil((p * F.col("total") - 100 * F.col("sum")) / (100 * F.col("n"))))))
    return each.groupBy("bench").agg(F.max("total").alias("total_stores"), F.sum("m").alias("total_buffers"), *(first(p).alias(f"top_for_{p}pct") for p in shares))


def block_extents(t: DataFrame, size: int) -> DataFrame:
    """Exponent extent and number (n) of the normal values of every block of `size` cells of a buffer in offset order (last values, rank // size)."""
    cells = snapshot(t)
    index = ranked(cells, BUFFER, "offset")
    x = b.normal_exp("alloc_type", "value")
    return index.groupBy(*BUFFER, F.floor(F.col("idx") / size).alias("block")).agg(F.min("alloc_type").alias("alloc_type"), F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def at_sizes(blocks: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Blocks of sizes[0] as blocks of every size (multiples of it), in one pass: counts and extents merge."""
    rows = blocks.withColumn("block_size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("block", F.expr(f"block div (block_size div {sizes[0]})"))
    return rows.groupBy(*BUFFER, "block_size", "block").agg(F.min("alloc_type").alias("alloc_type"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def mx_feasibility(t: DataFrame, block: int = 32, spread: int = 8) -> DataFrame:
    """A block of fewer than two normal values fits, and has no part in the mean and the median."""
    s = F.col("hi") - F.col("lo")
    fits, wide = (F.col("n") < 2) | (s <= spread), F.when(F.col("n") >= 2, s)
    return block_extents(t, block).groupBy(*TYPED).agg(F.count("*").alias("blocks"), F.count_if(fits).alias("viable_blocks"),
        b.share(fits).alias("viable_frac"), r9(F.sum(wide) / F.count(wide)).alias("mean_spread"), F.percentile(wide,
        0.5).alias("median_spread"), F.max(s).alias("max_spread"))


def mx_block_sweep(t: DataFrame, sizes: tuple[int, ...] = (8, 16, 32, 64, 128)) -> DataFrame:
    """One ranking at the smallest size; larger blocks are merged from smaller ones. Shares of blocks, as mx_feasibility() judges them."""
    s = F.col("hi") - F.col("lo")
    small, wide = F.col("n") < 2, F.when(F.col("n") >= 2, s)
    blocks = at_sizes(block_extents(t, sizes[0]), sizes).groupBy(*TYPED, "block_size")
    return blocks.agg(F.count("*").alias("blocks"), b.share(small | (s <= 4)).alias("viable_spread4"), b.share(small | (s <= 8)).alias("viable_spread8"),
        r9(F.sum(wide) / F.count(wide)).alias("mean_spread"))


def mx_scale_sharing(t: DataFrame, sizes: tuple[int, ...] = (16, 32, 64)) -> DataFrame:
    """Different scales (largest exponents) per block of a buffer: small where blocks share them. Blocks without a normal value have no scale."""
    blocks = at_sizes(block_extents(t, sizes[0]), sizes).where("hi is not null")
    own = blocks.groupBy(*BUFFER, "block_size").agg(F.min("alloc_type").alias("alloc_type"), F.count("*").alias("k"), F.count_distinct("hi").alias("d"))
    shared = F.col("d") / F.col("k")
    return own.groupBy(*TYPED, "block_size").agg(F.sum("k").alias("blocks"), F.sum("d").alias("distinct_scales_total"),
        r9(F.sum("d") / F.sum("k")).alias("overall_scale_share"), r9(F.avg(shared)).alias("mean_buffer_share"), r9(F.percentile(shared,
        0.5)).alias("median_buffer_share"))


def gini_of(counts: DataFrame, key: tuple[str, ...], x: str) -> DataFrame:
    """n, total and gini of x per key, from counts of counts: equal values need no order."""
    each = counts.groupBy(*key, x).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*key).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    r = F.coalesce(F.sum("m").over(w), F.lit(0))
    each = each.withColumn("ix", F.col(x) * (F.col("m") * r + F.expr("m * (m + 1) div 2")))
    total = each.groupBy(*key).agg(F.sum("m").alias("n"), F.sum(F.col(x) * F.col("m")).alias("total"), F.sum("ix").alias("ix"))
    return total.withColumn("gini", (2 * F.col("ix") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("total"))).drop("ix")


def intra_buffer_gini(t: DataFrame, exact: bool = True) -> DataFrame:
    counts = cell_counts(t.where(FP)).withColumnRenamed("writes", "x")
    g = gini_of(counts, (*BUFFER, "alloc_type"), "x").where("n > 1")
    median = F.percentile("gini", 0.5) if exact else F.percentile_approx("gini", 0.5)
    return g.groupBy(*TYPED).agg(F.count("*").alias("buffers"), r9(F.avg("gini")).alias("mean_gini"), r9(median).alias("median_gini"),
        r9(F.min("gini")).alias("min_gini"), r9(F.max("gini")).alias("max_gini"), r9(F.sum(F.col("gini") * F.col("total")) / F.sum("total")).alias("weighted_gini"))


def hot_offsets(t: DataFrame, buffers: int = 10, offsets: int = 5) -> DataFrame:
    cells = cell_counts(t)
    own = cells.groupBy(*BUFFER).agg(F.sum("writes").alias("all"))
    bench = own.groupBy("bench").agg(F.sum("all").alias("bench_all"))
    chosen = top(own, buffers, "bench", F.desc("all"), "alloc_addr", "generation", "run_id").join(bench, "bench")
    rows = cells.join(chosen, list(BUFFER))
    rank = F.row_number().over(Window.partitionBy(*BUFFER).orderBy(F.desc("writes"), "offset"))
    rows = rows.withColumn("_r", rank).where(F.col("_r") <= offsets)
    return rows.select("bench", "alloc_addr", "generation", "alloc_type", "alloc_size", "offset", "writes", r9(100 * F.col("writes") / F.col("all")).alias("pct_of_buffer"),
        r9(100 * F.col("writes") / F.col("bench_all")).alias("pct_of_bench"))


def spatial_delta(t: DataFrame) -> DataFrame:
    """Neighbouring cells of a buffer, last values: how many bits differ (up to 8, up to 16), and the bits of the numeric difference."""
    pairs = previous(snapshot(t), BUFFER, ("offset",), "value", "prev").where("prev is not null")
    d, h = b.log_delta("value", "prev"), b.hamming("alloc_type", "value", "prev")
    return pairs.groupBy(*TYPED).agg(F.count("*").alias("pairs"), F.count_if(F.col("value") == F.col("prev")).alias("bit_identical"),
        F.count_if(h <= 8).alias("delta_le_8b"), F.count_if(h <= 16).alias("delta_le_16b"), r9(F.sum(h) / F.count("*")).alias("mean_hamming"),
        r9(F.sum(d) / F.count("*")).alias("mean_log_delta"))


def stacks_of_buffers(t: DataFrame) -> DataFrame:
    """BUFFER, alloc_stack: the distinct pairs; a buffer has one stack."""
    return t.select(*BUFFER, "alloc_stack").distinct().dropDuplicates(list(BUFFER))


def site_silent(t: DataFrame, k: int = 20, min_pairs: int = 1000, bits: int = RANGE_BITS, stacks: DataFrame | None = None) -> DataFrame:
    """Stores of all types; buffers whose stores never meet a value count with their stores. A table of cells needs the buffers' stacks beside it."""
    buffers = buffer_silent(t, keep_all=True, bits=bits)
    rows = buffers.join(stacks_of_buffers(t) if stacks is None else stacks, list(BUFFER))  # stacks meet buffers, and are never carried through a window
    sites = per_site(rows, ("bench",), *(F.sum(c).alias(c) for c in ("stores", "pairs", "silent")))
    sites = top(sites.where(F.col("pairs") >= min_pairs), k, "bench", F.desc("pairs"), "site")
    return sites.withColumn("silent_frac", r9(b.ratio("silent", "pairs")))


#: exact_quantile() looks at so many bits of a value at a time.
DIGIT = 21


def exact_quantile(rows: DataFrame, key: tuple[str, ...], x: str, q: float) -> DataFrame:
    """key, total, below, edge: the least value of x at whose rank a share q of the key's rows is reached, and how many rows are below it.

    x is a long from 0 to 2**63 - 1. Rows are counted by the top 21 bits of x, then, of the range that holds the rank, by the next 21 bits, then
    by the last: partial counts go through the shuffle, and no task orders more than 2**21 counts of a key, however many values it has.
    """
    edges = rows.select(*key).distinct().withColumns({"total": F.lit(None).cast("long"), "below": F.lit(0).cast("long"), "edge": F.lit(0).cast("long")})
    for level, shift in enumerate((2 * DIGIT, DIGIT, 0)):
        digit = F.shiftright(x, shift)
        part = rows
        if level:
            part = rows.join(edges.select(*key, "edge"), list(key)).where(F.shiftright(x, shift + DIGIT) == F.col("edge"))
        counts = part.groupBy(*key, digit.alias("digit")).agg(F.count("*").alias("m"))
        upto = F.sum("m").over(Window.partitionBy(*key).orderBy("digit"))
        if level:
            counts = counts.join(edges.select(*key, "total", "below"), list(key))
        else:
            counts = counts.withColumns({"total": F.sum("m").over(Window.partitionBy(*key)), "below": F.lit(0).cast("long")})
        counts = counts.withColumn("upto", F.col("below") + upto)
        reached = counts.where(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")))
        edges = reached.groupBy(*key).agg(F.min("total").alias("total"), F.min(F.col("upto") - F.col("m")).alias("below"), F.min("digit").alias("edge"))
    return edges


def outlier_channels(t: DataFrame, q: float = 0.999, k: int = 20, least: int = 1000, exact: bool = True) -> DataFrame:
    """Per stack and type, stores other than zero whose magnitude reaches the q quantile and the offsets they are at; added up by site.

    exact: the quantile is the value at rank ceil(q * n); otherwise it is a sketch of bounded size. Stacks go by two hashes; their texts are
    joined to the sums. An offset is an outlier's if its largest magnitude reaches the quantile, so one row per offset does.
    """
    ids = (F.xxhash64("alloc_stack").alias("s1"), F.xxhash64(F.lit(1), "alloc_stack").alias("s2"))
    key = (*TYPED, "s1", "s2")
    rows = t.where(FP).where("value <> 0").select(*TYPED, *ids, "offset", b.magnitude("alloc_type", "value").alias("x"))
    stacks = t.select("alloc_stack").distinct().select(*ids, "alloc_stack")
    offsets = rows.groupBy(*key, "offset").agg(F.count("*").alias("m"), F.max("x").alias("most"))
    if exact:
        edges = exact_quantile(rows, key, "x", q)
        outliers = F.max(F.col("total") - F.col("below"))
    else:
        edges = rows.groupBy(*key).agg(F.percentile_approx("x", q, 100_000).alias("edge"))
        over = rows.join(edges, list(key)).groupBy(*key).agg(F.count_if(F.col("x") >= F.col("edge")).alias("over"))
        edges = edges.join(over, list(key))
        outliers = F.max("over")
    per_stack = offsets.join(edges, list(key)).groupBy(*key).agg(
        F.sum("m").alias("n"), outliers.alias("n_outlier_999"), F.count("*").alias("distinct_offsets"), F.count_if(F.col("most") >= F.col("edge")).alias("outlier_offsets"),
    )
    names = ("n_outlier_999", "distinct_offsets", "outlier_offsets")
    sites = per_site(per_stack.join(stacks, ["s1", "s2"]), TYPED, F.sum("n").alias("total"), *(F.sum(x).alias(x) for x in names))
    sites = top(sites.where(F.col("total") >= least), k, "bench", F.desc("total"), "alloc_type", "site")
    return sites.withColumn("channel_frac", r9(b.ratio("outlier_offsets", "distinct_offsets")))


def exponent_stability(t: DataFrame, k: int = 20, least: int = 100, exact: bool = True, stacks: DataFrame | None = None) -> DataFrame:
    """Exponent ranges of the cells with two normal values or more; of a site, the mean of its stacks' medians and the largest of their 95th percentiles.

    exact: percentiles are interpolated, on counts of ranges; otherwise they are sketches.
    """
    r, m = F.col("range"), F.col("m")
    own = exponent_extents(t).where("normal >= 2").withColumn("range", F.col("max_exp") - F.col("min_exp"))
    own = own.groupBy(*BUFFER, "alloc_type", "range").agg(F.count("*").alias("m"))  # buffers first: stacks are joined to few rows
    own = own.join(stacks_of_buffers(t) if stacks is None else stacks, list(BUFFER)).groupBy(*TYPED, "alloc_stack", "range").agg(F.sum("m").alias("m"))
    q = (lambda p: F.percentile("range", p, m)) if exact else (lambda p: F.percentile_approx(r, p))
    sums = F.sum("m").alias("n"), F.sum(F.when(r == 0, m).otherwise(0)).alias("same"), F.sum(r * m).alias("ranges")
    each = own.groupBy(*TYPED, "alloc_stack").agg(*sums, q(0.5).alias("median"), q(0.95).alias("p95"))
    out = per_site(
        each, TYPED, F.sum("n").alias("distinct_offsets"), r9(F.sum("same") / F.sum("n")).alias("frac_constant_exp"), r9(F.sum("ranges") / F.sum("n")).alias("mean_exp_range"),
        r9(F.avg("median")).alias("median_exp_range"), r9(F.max("p95")).alias("p95_exp_range"),
    )
    return top(out.where(F.col("distinct_offsets") >= least), k, "bench", F.desc("distinct_offsets"), "alloc_type", "site")


def cacheline_homogeneity(t: DataFrame) -> DataFrame:
    """Physical lines (generations collapsed); shares are of lines with two slots or more, mean_slots_per_line of all lines."""
    last = snapshot(t, "run_id", "bench", "alloc_type", "alloc_addr", "offset")
    parts = {"high32": b.top_bits("value", 32), "high16": b.top_bits("value", 16), "high8": b.top_bits("value", 8), "exp": b.biased_exp("alloc_type", "value")}
    same = ((F.min(x) == F.max(x)).alias(n) for n, x in parts.items())
    lines = last.groupBy("run_id", "bench", "alloc_type", "alloc_addr", b.line_id("offset").alias("line")).agg(F.count("*").alias("slots"), *same)
    many = F.col("slots") > 1
    shares = (r9(b.ratio(F.count_if(many & F.col(n)), F.count_if(many))).alias(f"frac_homog_{n}") for n in parts)
    return lines.groupBy(*TYPED).agg(F.count_if(many).alias("lines"), F.count_if(~many).alias("trivial_lines"), r9(F.avg("slots")).alias("mean_slots_per_line"), *shares)


def zoom(per_buffer: DataFrame, t: DataFrame, bench: str, order: str, k: int = 22) -> DataFrame:
    """The k largest buffers of one bench, with their site. The buffers are chosen first: stacks are read for k of them."""
    first = top(per_buffer.where(F.col("bench") == bench), k, None, F.desc(order), "alloc_addr", "generation", "run_id")
    stacks = stacks_of_buffers(t.where(F.col("bench") == bench))
    return first.join(stacks, list(BUFFER)).withColumn("site", alloc_site("alloc_stack")).drop("alloc_stack")


def zoom_silent(t: DataFrame, bench: str, k: int = 22, bits: int = RANGE_BITS) -> DataFrame:
    """With the aggregate of all the bench's buffers, chosen or not: silent over pairs."""
    buffers = buffer_silent(t, bits=bits)
    whole = buffers.where(F.col("bench") == bench).groupBy("bench").agg(r9(b.ratio(F.sum("silent"), F.sum("pairs"))).alias("bench_silent_frac"))
    return zoom(buffers, t, bench, "pairs", k).join(whole, "bench")


def zoom_feasibility(t: DataFrame, bench: str, k: int = 22, fmt: str = "bf16") -> DataFrame:
    fits = buffer_feasibility(t).withColumnRenamed(f"pct_{fmt}", "pct_fit").select(*BUFFER, "alloc_type", "alloc_size", "total", "pct_fit")
    return zoom(fits, t, bench, "total", k)
