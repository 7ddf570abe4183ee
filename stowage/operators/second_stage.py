"""Operators on results of the analyses: shares, selections, labels and the energy model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import bits as b
from stowage.operators.stores import r9, top

BUFFER_KEY = ("run_id", "bench", "alloc_addr", "generation")


def cumulative_share(tops: DataFrame, totals: DataFrame) -> DataFrame:
    """The share of a bench's stores held by its first, second, ... buffers."""
    order = Window.partitionBy("bench").orderBy(F.desc("stores"), "alloc_addr", "generation")
    cum = F.sum("stores").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = tops.select("bench", "alloc_addr", "generation", "stores").withColumns({"rank": F.row_number().over(order), "cum_stores": cum})
    rows = rows.join(totals.select("bench", F.col("stores").alias("all")), "bench")
    return rows.select("bench", "rank", "cum_stores", r9(F.col("cum_stores") / F.col("all")).alias("cum_frac"))


def size_ccdf(sizes: DataFrame) -> DataFrame:
    """Allocations of a size bucket or above."""
    w = Window.partitionBy("bench").orderBy(F.desc("size_bucket_bytes")).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.select("bench", "size_bucket_bytes", F.sum("allocations").over(w).alias("at_least"))


def write_regime(coverage: DataFrame, cover: float = 0.5, writes: float = 10.0) -> DataFrame:
    """D3"""
    dense, hot = F.col("avg_coverage") >= cover, F.col("avg_writes_per_slot") >= writes
    return coverage.select("bench", "alloc_type", F.when(dense & hot, "dense-hot").when(dense, "dense-cold").when(hot, "sparse-hot").otherwise("sparse-cold").alias("regime"))


def weighted_bench_aggregate(buffers: DataFrame, value: str, weight: str) -> DataFrame:
    """D4"""
    known = F.col(value).isNotNull()
    return buffers.groupBy("bench").agg(r9(b.ratio(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(known, F.col(weight))))).alias("aggregate"), F.sum(weight).alias("weight"))


def top_buffers_above_floor(buffers: DataFrame, weight: str, floor: int = 1000, k: int = 400) -> DataFrame:
    """The k heaviest of a bench above the floor; of all where none is above it."""
    above = F.max(F.col(weight) >= floor).over(Window.partitionBy("bench"))
    rows = buffers.withColumn("_any", above).where(~F.col("_any") | (F.col(weight) >= floor)).drop("_any")
    return top(rows, k, "bench", F.desc(weight), "alloc_addr", "generation", "run_id")


def coverage_of_selection(selected: DataFrame, all_: DataFrame, weight: str) -> DataFrame:
    """D6"""
    one = selected.groupBy("bench").agg(F.count("*").alias("k"), F.sum(weight).alias("w"))
    two = all_.groupBy("bench").agg(F.count("*").alias("buffers"), F.sum(weight).alias("weight"))
    return two.join(one, "bench", "left").select("bench", F.coalesce("k", F.lit(0)).alias("selected"), "buffers", r9(b.ratio(F.coalesce("w", F.lit(0)), "weight")).alias("weight_share"))


def buffer_required_bits(ranges: DataFrame) -> DataFrame:
    """0 where no store has an exponent."""
    return ranges.select(*BUFFER_KEY, F.when(F.col("min_e").isNull(), F.lit(0).cast("long")).otherwise(b.required_exp_bits("min_e", "max_e", 1)).alias("required_bits"))


def share_near_aggregate(buffers: DataFrame, value: str, weight: str, eps: float = 0.05) -> DataFrame:
    """The weight whose value is within eps of the bench's weighted mean."""
    joined = buffers.where(F.col(value).isNotNull()).join(weighted_bench_aggregate(buffers, value, weight).select("bench", "aggregate"), "bench")
    near = F.when(F.abs(F.col(value) - F.col("aggregate")) <= eps, F.col(weight)).otherwise(0)
    return joined.groupBy("bench").agg(r9(b.ratio(F.sum(near), F.sum(weight))).alias("near_share"))


def convertible_buffers(fits: DataFrame, ranges: DataFrame, share: str = "pct_bf16", low: int = -126, high: int = 127) -> DataFrame:
    """Every store fits the mantissa and the exponents fit the window; buffers of zeros only are told apart."""
    rows = fits.where(F.col(share) == 1.0).select(*BUFFER_KEY, "alloc_type").join(ranges.select(*BUFFER_KEY, "total", "n_zero", "n_special", "min_e", "max_e"), list(BUFFER_KEY))
    verdict = F.when(F.col("n_zero") == F.col("total"), "all_zero").when((F.col("n_special") == 0) & (F.col("min_e") >= low) & (F.col("max_e") <= high), "convertible").otherwise("range")
    return rows.withColumn("verdict", verdict).groupBy("bench", "alloc_type", "verdict").agg(F.count("*").alias("buffers"), F.sum("total").alias("stores"))


def top_n_per_group(df: DataFrame, n: int, group: str, *order: Column | str) -> DataFrame:
    """D10"""
    return top(df, n, group, *order)


def gini_quality_flag(gini: DataFrame) -> DataFrame:
    """What should not happen with a full buffer key."""
    bad = (F.col("min_gini") < 0) | (F.col("max_gini") > 1)
    return gini.select("bench", "alloc_type", bad.alias("out_of_range"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean_gini"))).alias("clipped_mean"))


def buffer_dense_rank(hot: DataFrame) -> DataFrame:
    """D12"""
    return hot.select("bench", "alloc_addr", "generation", "offset", F.dense_rank().over(Window.partitionBy("bench").orderBy("alloc_addr", "generation")).alias("buffer_rank"))


def sweep_is_flat(sharing: DataFrame, metric: str = "overall_scale_share") -> DataFrame:
    """D13"""
    return sharing.groupBy("bench", "alloc_type").agg((F.count_distinct(metric) <= 1).alias("is_flat"))


def silent_impact_rank(sites: DataFrame, k: int = 12) -> DataFrame:
    """Over all benches, stores times their silent share."""
    rows = sites.select("bench", "site", r9(F.col("stores") * F.col("silent_frac")).alias("impact"))
    return top(rows, k, None, F.desc("impact"), "bench", "site")


def exp_bits_histogram(sites: DataFrame) -> DataFrame:
    """Per type, stores by required width, and the share of the type's stores that needs no more."""
    rows = sites.groupBy("alloc_type", "required_e_bits").agg(F.sum("total").alias("stores"))
    up_to = F.sum("stores").over(Window.partitionBy("alloc_type").orderBy("required_e_bits"))  # a row per type and width, 64 at most
    return rows.select("alloc_type", "required_e_bits", "stores", r9(up_to / F.sum("stores").over(Window.partitionBy("alloc_type"))).alias("cum_share"))


def exp_bits_shares(sites: DataFrame, widths: tuple[int, ...] = (4, 5, 8, 11)) -> DataFrame:
    """Per type, the share of stores whose site needs at most so many exponent bits. The widths of common formats."""
    fits = lambda w: F.sum(F.when(F.col("required_e_bits") <= w, F.col("total")).otherwise(0)) / F.sum("total")
    return sites.groupBy("alloc_type").agg(F.sum("total").alias("stores"), *(r9(fits(w)).alias(f"le_{w}_bits") for w in widths))


def residual_class_share(classes: DataFrame) -> DataFrame:
    """What zeros and the classes of its own width leave of a floating-point type's stores, within 0 and 1; to 8 digits, as the shares have 9."""
    share = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    own = lambda name: F.when(F.col("alloc_type") == "64bits", share(f"frac_{name}_f64")).otherwise(share(f"frac_{name}_f32"))
    known = share("frac_zero") + own("normal") + own("subnormal") + own("inf_nan")
    rows = classes.where("alloc_type in ('64bits', '32bits')")
    return rows.select("bench", "alloc_type", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - known)), 8).alias("other"))


def scaling_granularity(stability: DataFrame) -> DataFrame:
    """D17"""
    x = F.col("frac_constant_exp")
    return stability.select("bench", "alloc_type", "site", F.when(x >= 0.8, "per-channel").when(x <= 0.2, "per-token").otherwise("mixed").alias("granularity"))


def outlier_scaling_class(channels: DataFrame) -> DataFrame:
    """D18"""
    x = F.col("channel_frac")
    return channels.select("bench", "alloc_type", "site", F.when(x <= 0.05, "per-channel").when(x >= 0.5, "per-tensor").otherwise("mixed").alias("scaling"))


def dominant_site_share(profile: DataFrame) -> DataFrame:
    """Benches in the order of their first site's share."""
    first = top(profile, 1, "bench", F.desc("stores"), "site").select("bench", "site", F.col("pct_of_bench").alias("share"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("share"), "bench")))  # one row per bench


def single_slot_share(lines: DataFrame, within_total: bool = True) -> DataFrame:
    """Trivial lines over lines, or over both where `lines` counts the others only."""
    total = F.col("lines") if within_total else F.col("lines") + F.col("trivial_lines")
    return lines.select("bench", "alloc_type", r9(b.ratio("trivial_lines", total)).alias("single_slot_share"))


def class_fractions(counts: DataFrame, *columns: str) -> DataFrame:
    """D21"""
    key = [c for c in ("bench", "alloc_type") if c in counts.columns]
    return counts.select(*key, *(r9(F.col(c) / F.greatest(F.col("total"), F.lit(1))).alias(c) for c in columns), F.row_number().over(Window.partitionBy().orderBy(F.desc("total"), *key)).alias("rank"))


def delta_bands(deltas: DataFrame) -> DataFrame:
    """Shares of pairs that are identical, within 8 bits, within 16, beyond."""
    part = lambda x: r9(F.greatest(F.lit(0.0), b.ratio(x, "pairs")))
    i, e, s = F.col("bit_identical"), F.col("delta_le_8b"), F.col("delta_le_16b")
    return deltas.select("bench", "alloc_type", part(i).alias("identical"), part(e - i).alias("within_8b"), part(s - e).alias("within_16b"), part(F.col("pairs") - s).alias("beyond"))


#: Grid of silent shares from which a buffer is checked before every store: 0.05 to 0.95.
THRESHOLDS = tuple(i / 20 for i in range(1, 20))


def gated(buffers: DataFrame, thresholds: tuple[float, ...], least: int) -> DataFrame:
    """bench, threshold, s, c, t: silent stores and all stores of the buffers checked, and all stores of all buffers.

    Checked are buffers of at least `least` pairs whose silent share reaches the threshold. Buffers are summed by bench and by the
    highest threshold they reach before the grid is joined, so the grid meets at most a row per bench and threshold.
    """
    grid = F.array(*map(F.lit, thresholds))
    level = F.when(F.col("pairs") >= least, F.size(F.filter(grid, lambda t: t <= F.col("silent") / F.col("pairs")))).otherwise(0)
    sums = buffers.groupBy("bench", level.alias("level")).agg(F.sum("stores").alias("stores"), F.sum("silent").alias("silent"))
    rows = sums.select("*", F.posexplode(grid).alias("need", "threshold"))
    on = F.col("level") > F.col("need")
    return rows.groupBy("bench", "threshold").agg(F.sum(F.when(on, F.col("silent")).otherwise(0)).alias("s"), F.sum(F.when(on, F.col("stores")).otherwise(0)).alias("c"), F.sum("stores").alias("t"))


def silent_energy_sweep(buffers: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, ratios: tuple[int, ...] = (2, 5, 10), least: int = 1000) -> DataFrame:
    """Net saving (S * k - C) / (T * k) if a write costs k reads and the buffers gated() chooses are read before every store."""
    total = gated(buffers, thresholds, least).groupBy("threshold").agg(*(F.sum(c).alias(c) for c in "sct"))
    rows = total.select("*", F.explode(F.array(*map(F.lit, ratios))).alias("ratio"))
    return rows.select("threshold", "ratio", r9((F.col("s") * F.col("ratio") - F.col("c")) / (F.col("t") * F.col("ratio"))).alias("net_saving"))


def best_thresholds(buffers: DataFrame, ratio: int = 5, thresholds: tuple[float, ...] = THRESHOLDS, least: int = 1000) -> DataFrame:
    """Per bench the threshold of the largest saving (the lowest of ties), and the saving, zero at least."""
    rows = gated(buffers, thresholds, least).withColumn("net", r9((F.col("s") * ratio - F.col("c")) / (F.col("t") * ratio)))
    return top(rows, 1, "bench", F.desc("net"), "threshold").select("bench", "threshold", F.greatest(F.lit(0.0), "net").alias("net_saving"))
