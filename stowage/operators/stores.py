"""Analyses of a store trace that need no order of stores beyond grouping: DataFrame in, DataFrame out.

A trace has run_id, bench, alloc_addr, alloc_size, alloc_type, generation, alloc_stack, offset, value, rn. One job covers all
benches: they are part of every key. Site analyses aggregate by stack text first, so the stack is parsed once per
distinct text and not once per store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import bits as b
from stowage.functions.sites import alloc_site, site3
from stowage.operators.cells import BUFFER, CELL, FP, cell_counts, snapshot

TYPED = ("bench", "alloc_type")


def r9(x) -> Column:
    return F.round(x, 9)


def top(df: DataFrame, k: int, by: str | None, *order) -> DataFrame:
    """The first k rows (of each `by`) in the order given, which must break all ties."""
    if by is None:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def per_site(rows: DataFrame, key: tuple[str, ...], *aggregates: Column) -> DataFrame:
    """Rows with alloc_stack -> aggregates per key and site, for stacks that have one.

    Whether a site is empty is asked of a maximum, after the grouping: a filter on the site itself would be pushed below every aggregation,
    into the scan, and stacks would be parsed once per store.
    """
    named = F.max(F.length("site")).alias("_named")
    sites = rows.withColumn("site", alloc_site("alloc_stack")).groupBy(*key, "site").agg(*aggregates, named)
    return sites.where("_named > 0").drop("_named")


def summary(t: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("alloc_type") == kind)
    buffers = t.groupBy(*BUFFER).agg(F.count("*").alias("n"), of("64bits").alias("w"), of("32bits").alias("h"), of("object").alias("o"), F.count_if(F.col("value") == 0).alias("z"))
    total = buffers.groupBy("bench").agg(F.sum("n").alias("stores"), F.count("*").alias("allocations"), F.sum("w").alias("stores_64"),
        F.sum("h").alias("stores_32"), F.sum("o").alias("stores_object"), F.sum("z").alias("z"))
    return total.withColumn("frac_zero_value", r9(F.col("z") / F.col("stores"))).drop("z")


def top_allocations(t: DataFrame, k: int = 20) -> DataFrame:
    own = cell_counts(t).groupBy(*BUFFER).agg(F.min("alloc_size").alias("alloc_size"), F.min("alloc_type").alias("alloc_type"), F.sum("writes").alias("stores"), F.count("*").alias("unique_offsets"))
    own = top(own, k, "bench", F.desc("stores"), "alloc_addr", "generation", "run_id")
    return own.select("bench", "alloc_addr", "alloc_size", "alloc_type", "generation", "stores", "unique_offsets", r9(b.ratio("stores", "alloc_size")).alias("stores_per_byte"))


def size_distribution(t: DataFrame) -> DataFrame:
    own = t.groupBy(*BUFFER).agg(F.min("alloc_size").alias("alloc_size"))
    return own.groupBy("bench", b.pow2_bucket("alloc_size").alias("size_bucket_bytes")).agg(F.count("*").alias("allocations"))


def hot_stack_sites(t: DataFrame, k: int = 15) -> DataFrame:
    """Over all benches; total_bytes adds alloc_size once per store, distinct_bytes once per buffer."""
    own = t.groupBy("alloc_stack", *BUFFER).agg(F.count("*").alias("n"), F.min("alloc_size").alias("size"))
    by_stack = own.groupBy("bench", "alloc_stack").agg(F.sum("n").alias("n"), F.count("*").alias("a"), F.sum(F.col("n") * F.col("size")).alias("s"), F.sum("size").alias("d"))
    sites = by_stack.groupBy("bench", site3("alloc_stack").alias("site3")).agg(F.sum("n").alias("stores"), F.sum("a").alias("allocs"),
        F.sum("s").alias("total_bytes"), F.sum("d").alias("distinct_bytes"))
    return top(sites, k, None, F.desc("stores"), "bench", "site3")


def value_patterns(t: DataFrame) -> DataFrame:
    v, high = F.col("value"), b.top_bits("value", 8)
    e = F.shiftrightunsigned("value", 52).bitwiseAND(F.lit(2047))
    return t.groupBy(*TYPED).agg(F.count_if(v == 0).alias("zero"), F.count_if((v != 0) & (high == 0)).alias("nonzero_top_byte_zero"),
        F.count_if(high != 0).alias("nonzero_top_byte_nonzero"), F.count_if(e.between(1, 2046)).alias("exp_field_normal_f64"),
        F.count("*").alias("total"))


def alignment(t: DataFrame) -> DataFrame:
    o = F.col("offset")
    return t.groupBy(*TYPED).agg(F.count_if(o % 8 == 0).alias("aligned_8b"), F.count_if((o % 8 != 0) & (o % 4 == 0)).alias("aligned_4b_only"),
        F.count_if(o % 4 != 0).alias("unaligned"), F.count("*").alias("total"))


def reused_allocations(t: DataFrame, k: int = 20) -> DataFrame:
    """Addresses with more than one generation; avg_size is the sizes of all stores over max_generation, avg_size_distinct the mean of the buffers."""
    own = t.groupBy(*BUFFER).agg(F.count("*").alias("n"), F.min("alloc_size").alias("size"))
    sums = F.max("generation").alias("max_generation"), F.sum("n").alias("stores"), F.sum(F.col("n") * F.col("size")).alias("s"), F.sum("size").alias("d"), F.count("*").alias("buffers")
    out = own.groupBy("bench", "run_id", "alloc_addr").agg(*sums).where("max_generation > 1")
    out = top(out, k, None, F.desc("max_generation"), F.desc("stores"), "bench", "alloc_addr", "run_id")
    means = r9(F.col("s") / F.col("max_generation")).alias("avg_size"), r9(F.col("d") / F.col("buffers")).alias("avg_size_distinct")
    return out.select("bench", "alloc_addr", "max_generation", "stores", *means)


def coverage(t: DataFrame) -> DataFrame:
    own = cell_counts(t.where(FP)).groupBy(*BUFFER).agg(F.min("alloc_type").alias("alloc_type"), F.min("alloc_size").alias("size"), F.count("*").alias("slots"), F.sum("writes").alias("writes"))
    own = own.select(*TYPED, b.ratio(F.col("slots") * b.slot_bytes("alloc_type"), "size").alias("cover"), b.ratio("writes", "slots").alias("per_slot"))
    return own.groupBy(*TYPED).agg(F.count("*").alias("allocations"), r9(F.avg("cover")).alias("avg_coverage"), r9(F.min("cover")).alias("min_coverage"),
        r9(F.max("cover")).alias("max_coverage"), r9(F.avg("per_slot")).alias("avg_writes_per_slot"))


def fit_shares(fmts=tuple(b.FORMATS)) -> list[Column]:
    """Shares of stores that keep their value in each format; one as wide as the stores keeps all."""
    return [r9(F.coalesce(F.avg(b.fits_format(f, "alloc_type", "value").cast("int")), F.lit(1.0))).alias(f"pct_{f}") for f in fmts]


def fit_counts(fmts=tuple(b.FORMATS)) -> list[Column]:
    return [F.sum(b.fits_format(f, "alloc_type", "value").cast("int")).alias(f"n_{f}") for f in fmts]


def format_feasibility(t: DataFrame) -> DataFrame:
    return t.where(FP).groupBy(*TYPED).agg(F.count("*").alias("total"), *fit_shares())


def buffer_feasibility(t: DataFrame) -> DataFrame:
    kind = F.min("alloc_type").alias("alloc_type"), F.min("alloc_size").alias("alloc_size")
    return t.where(FP).groupBy(*BUFFER).agg(*kind, F.count("*").alias("total"), *fit_shares())


def site_feasibility(t: DataFrame, k: int = 20, least: int = 1000) -> DataFrame:
    by_stack = t.where(FP).groupBy(*TYPED, "alloc_stack").agg(F.count("*").alias("n"), *fit_counts())
    sites = per_site(by_stack, TYPED, F.sum("n").alias("total"), *(F.sum(f"n_{f}").alias(f"n_{f}") for f in b.FORMATS)).where(F.col("total") >= least)
    sites = top(sites, k, "bench", F.desc("total"), "alloc_type", "site")
    return sites.select(*TYPED, "site", "total", *(r9(b.ratio(f"n_{f}", "total")).alias(f"pct_{f}") for f in b.FORMATS))


def exponent_range(t: DataFrame, e4m3: tuple[int, int] = (-9, 8), e5m2: tuple[int, int] = (-16, 15)) -> DataFrame:
    """A zero is a store of all bits 0; any other with exponent field 0, a negative zero too, counts as denormal."""
    e, x = b.biased_exp("alloc_type", "value"), b.normal_exp("alloc_type", "value")
    inside = lambda w: r9(F.count_if(x.between(*w)) / F.count("*"))
    out = t.where(FP).groupBy(*TYPED).agg(
        F.count("*").alias("total"), b.share(F.col("value") == 0).alias("frac_zero"), b.share((e == 0) & (F.col("value") != 0)).alias("frac_denormal"),
        r9(F.count_if(e == b.exp_special("alloc_type")) / F.count("*")).alias("frac_inf_nan"), F.min(x).alias("min_exp"), F.max(x).alias("max_exp"), r9(F.sum(x) / F.count(x)).alias("mean_exp"),
        inside(e4m3).alias("frac_in_e4m3_range"), inside(e5m2).alias("frac_in_e5m2_range"),
    )
    return out


def site_profile(t: DataFrame, k: int = 15) -> DataFrame:
    """Stores of all types; pct_of_bench is the percentage of all stores of the bench that have a site, not of the k shown.

    mean_alloc_size weighs by stores. Trailing zeros are of floating-point stores; a stack's mean stands for all its stores, 0 where it has none.
    """
    zeros = b.trailing_zeros("alloc_type", "value")
    own = t.groupBy("alloc_stack", *BUFFER).agg(F.count("*").alias("n"), F.min("alloc_size").alias("size"), F.sum(zeros).alias("tz"), F.count(zeros).alias("k"))
    by_stack = own.groupBy("bench", "alloc_stack").agg(F.sum("n").alias("n"), F.count("*").alias("a"), F.sum(F.col("n") * F.col("size")).alias("s"), F.sum("tz").alias("tz"), F.sum("k").alias("k"))
    by_stack = by_stack.withColumn("tz", F.col("n") * F.coalesce(F.col("tz") / F.nullif("k", F.lit(0)), F.lit(0.0)))
    sites = per_site(by_stack, ("bench",), F.sum("n").alias("stores"), F.sum("a").alias("buffers"), F.sum("s").alias("s"), F.sum("tz").alias("tz"))
    sites = sites.withColumn("all", F.sum("stores").over(Window.partitionBy("bench")))
    sites = top(sites, k, "bench", F.desc("stores"), "site")
    return sites.select("bench", "site", "stores", r9(100 * F.col("stores") / F.col("all")).alias("pct_of_bench"), "buffers",
        r9(F.col("s") / F.col("stores")).alias("mean_alloc_size"), r9(F.col("tz") / F.col("stores")).alias("mean_trailing_z"))


def bdi_compression(t: DataFrame) -> DataFrame:
    """Last values per cache line: how many lines of two slots or more have a range that fits 8, 16 or 32 bits (null: no such line), and their mean range."""
    u = b.unsigned_order("value")
    lines = snapshot(t).groupBy(*BUFFER, b.line_id("offset").alias("line")).agg(F.min("alloc_type").alias("alloc_type"),
        F.count("*").alias("slots"), b.unsigned_range(F.min(u), F.max(u)).alias("range"))
    many = F.col("slots") > 1
    small = lambda k: r9(b.ratio(F.count_if(many & (F.col("range") < F.lit(1 << k).cast("decimal(20,0)"))), F.count_if(many)))
    mean = r9(F.avg(F.when(many, F.col("range").cast("double")))).alias("mean_range")
    return lines.groupBy(*TYPED).agg(F.count("*").alias("lines"), F.count_if(F.col("slots") == 1).alias("trivial_lines"), *(small(k).alias(f"bdi{k}_frac") for k in (8, 16, 32)), mean)


def fpc_patterns(t: DataFrame) -> DataFrame:
    zero = F.col("value") == 0
    flags = {"zero": zero, **{f"sign{k}": b.fits_signed(k, "alloc_type", "value") for k in (4, 8, 16, 32)}, "high_zero_low16": b.high_zero_low16("value"),
        "repeating_byte": b.repeating_byte("alloc_type", "value")}
    any_ = F.lit(False)
    for f in flags.values():
        any_ |= f
    return t.where(FP).groupBy(*TYPED).agg(F.count("*").alias("total"), *(b.share(f).alias(f"pct_{n}") for n, f in flags.items()), b.share(any_).alias("pct_any_pattern"))


def site_required_exp_bits(t: DataFrame, k: int = 20, least: int = 1000) -> DataFrame:
    """Of stores that are not zero; stacks without a normal value and stores without a site are left out."""
    x = b.normal_exp("alloc_type", "value")
    by_stack = t.where(FP).where("value <> 0").groupBy(*TYPED, "alloc_stack").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n")).where("lo is not null")
    sites = per_site(by_stack, TYPED, F.min("lo").alias("min_e"), F.max("hi").alias("max_e"), F.sum("n").alias("total")).where(F.col("total") >= least)
    sites = top(sites, k, "bench", F.desc("total"), "alloc_type", "site")
    return sites.select(*TYPED, "site", "min_e", "max_e", (F.col("max_e") - F.col("min_e") + 1).alias("exp_range"), b.required_exp_bits("min_e", "max_e").alias("required_e_bits"), "total")


def bit_plane_entropy(t: DataFrame) -> DataFrame:
    """64 sums in one pass, then a row for each bit."""
    sums = t.where(FP).groupBy(*TYPED).agg(F.count("*").alias("total"), *(F.sum(b.bit("value", i)).alias(f"b{i}") for i in range(64)))
    rows = sums.select(*TYPED, "total", F.posexplode(F.array(*(f"b{i}" for i in range(64)))).alias("bit_pos", "ones"))
    p = F.col("ones") / F.col("total")
    return rows.select(*TYPED, "total", "bit_pos", r9(p).alias("p_one"), r9(b.binary_entropy(p)).alias("entropy"))


def posit_fit(t: DataFrame) -> DataFrame:
    """Of stores that are not zero, specials included; mean_abs_exp is of normal ones only. The middle band holds the high one."""
    e, x = b.unbiased_exp("alloc_type", "value"), b.normal_exp("alloc_type", "value")
    return t.where(FP).where("value <> 0").groupBy(*TYPED).agg(
        F.count("*").alias("total"), r9(F.sum(F.abs(x)) / F.count(x)).alias("mean_abs_exp"), b.share(F.abs(e) <= 4).alias("frac_high_precision"), b.share(F.abs(e) <= 16).alias("frac_mid_precision"),
        b.share(F.abs(e) > 30).alias("frac_extreme"), r9(F.avg(b.posit_useful_bits(e))).alias("mean_posit_useful_bits"),
    )


def trace_volume(t: DataFrame) -> DataFrame:
    own = t.groupBy("alloc_stack", *BUFFER).agg(F.count("*").alias("n"), F.min("alloc_size").alias("size"))
    total = own.groupBy("bench").agg(F.sum("n").alias("stores"), F.sum("size").alias("bytes_addressed"), F.count("*").alias("buffers"),
        F.count_distinct("alloc_stack").alias("call_sites"), F.count_distinct("size").alias("distinct_sizes"))
    return total.withColumn("buffers_per_site", r9(b.ratio("buffers", "call_sites")))


def trace_robustness(t: DataFrame) -> DataFrame:
    """buffers_reused counts addresses with more than one generation."""
    kind = lambda k: F.count_if(F.col("alloc_type") == k)
    own = t.groupBy(*BUFFER).agg(F.min("alloc_size").alias("size"), F.max("offset").alias("o"), F.min("alloc_type").alias("alloc_type"))
    one = own.groupBy("bench").agg(F.min("size").alias("min_size"), F.percentile("size", 0.5).alias("median_size"), F.max("size").alias("max_size"),
        F.max("generation").alias("max_generation"), F.count_distinct("alloc_type").alias("distinct_alignment_classes"),
        kind("64bits").alias("buffers_64"), kind("32bits").alias("buffers_32"), kind("object").alias("buffers_object"),
        F.max("o").alias("max_offset"))
    two = own.groupBy("bench", "run_id", "alloc_addr").agg(F.max("generation").alias("g")).groupBy("bench").agg(F.count_if(F.col("g") > 1).alias("buffers_reused"))
    return one.join(two, "bench")


def exponent_classes(t: DataFrame) -> DataFrame:
    """Shares of all stores of a type; the classes of the other width are 0."""
    e, columns = b.biased_exp("alloc_type", "value"), []
    for name, kind in (("f64", "64bits"), ("f32", "32bits")):
        bits = F.col("value") if name == "f64" else b.low32("value")
        of = lambda x, kind=kind: b.share(F.coalesce((F.col("alloc_type") == kind) & x, F.lit(False)))
        columns += [of((bits != 0) & b.is_normal("alloc_type", "value")).alias(f"frac_normal_{name}"), of((bits != 0) & (e == 0)).alias(f"frac_subnormal_{name}"),
            of(e == b.exp_special("alloc_type")).alias(f"frac_inf_nan_{name}")]
    return t.groupBy(*TYPED).agg(F.count("*").alias("stores"), b.share(F.col("value") == 0).alias("frac_zero"), *columns)


def buffer_exp_range(t: DataFrame) -> DataFrame:
    """n_special counts what is neither zero nor normal: denormals, negative zeros, infinities, NaN."""
    x, zero = b.normal_exp("alloc_type", "value"), F.col("value") == 0
    kind = F.min("alloc_type").alias("alloc_type"), F.min("alloc_size").alias("alloc_size")
    special = F.count_if(~zero & x.isNull()).alias("n_special")
    return t.where(FP).groupBy(*BUFFER).agg(*kind, F.count("*").alias("total"), F.count_if(zero).alias("n_zero"), special, F.min(x).alias("min_e"), F.max(x).alias("max_e"))


def frequent_values(t: DataFrame, ks: tuple[int, ...] = (1, 8, 64, 256, 1024)) -> DataFrame:
    """Counts of counts: values with the same count need no order among them, and the window holds distinct counts only."""
    each = t.where(FP).groupBy(*TYPED, "value").agg(F.count("*").alias("n")).groupBy(*TYPED, "n").agg(F.count("*").alias("m"))
    w = Window.partitionBy(*TYPED).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
    took = lambda k: F.sum(F.col("n") * F.greatest(F.lit(0), F.least(F.lit(k) - F.col("before"), F.col("m"))))
    total = F.sum(F.col("n") * F.col("m"))
    return each.groupBy(*TYPED).agg(total.alias("total_stores"), F.sum("m").alias("distinct_values"), *(r9(took(k) / total).alias(f"top{k}_frac") for k in ks))
