"""Block floating-point (MX) re-encoding of float bits, in native bit arithmetic.

Rows are elements of tensors: a key, an index in the key, and raw float bits of `esz` bytes. Elements come in blocks of
`block`; each block shares a power-of-two scale, and each element keeps `mbits` mantissa bits in an exponent
range [emin, emax]. The arithmetic is on integers throughout: shifts, rounding and reassembly are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import bits as b
from stowage.operators.ranges import dealt

ONE = lambda x: F.lit(x).cast("long")
FLOATS = {4: (8, 23, 127), 8: (11, 52, 1023)}  # bytes: bits of exponent and mantissa, bias


def shl(x: Column, n: Column) -> Column:
    """x << n; n may be anything from 0 up (the JVM takes shifts modulo 64)."""
    return F.when(n >= 64, ONE(0)).otherwise(F.call_function("shiftleft", x, F.least(n, ONE(63)).cast("int")))


def shr(x: Column, n: Column) -> Column:
    return F.when(n >= 64, ONE(0)).otherwise(F.call_function("shiftrightunsigned", x, F.least(n, ONE(63)).cast("int")))


def block_scales(df: DataFrame, key: list[str], idx: str = "idx", bits: str = "bits", esz: int = 4, emax: int = 8, scale_bits: int = 8, block: int = 32) -> DataFrame:
    """`df` with the parts of its floats, the shared exponent of their blocks, block_nan and scale_clamped; none of it depends on the mantissa's width.

    Elements go through one shuffle to their blocks, in tasks of some million elements; `_first` marks one element of each block.
    """
    width, mant, bias = FLOATS[esz]
    special = (1 << width) - 1
    limit = (1 << (scale_bits - 1)) - 1
    v = F.col(bits)
    df = dealt(df.withColumn("_block", F.floor(F.col(idx) / block)), *key, "_block")
    of_block = Window.partitionBy(*key, "_block").orderBy(idx)
    whole = of_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({
        "_e": F.shiftrightunsigned(v, mant).bitwiseAND(ONE(special)), "_m": v.bitwiseAND(ONE((1 << mant) - 1)), "_sign": v.bitwiseAND(ONE(1 << 31 if esz == 4 else b.FLIP))
    })
    e, m = F.col("_e"), F.col("_m")
    finite = (e < special) & ((e > 0) | (m > 0))
    # |v| = sig * 2**unit, sig an integer; lead = floor(log2 |v|), subnormals too
    df = df.withColumns({"_sig": F.when(e > 0, m.bitwiseOR(ONE(1 << mant))).otherwise(m), "_unit": F.greatest(e, ONE(1)) - bias - mant})
    df = df.withColumn("_lead", F.when(finite, F.length(F.bin("_sig")).cast("long") - 1 + F.col("_unit")))
    df = df.withColumns({"_top": F.max("_lead").over(whole), "_bad": F.max((F.col("_e") == special).cast("int")).over(whole), "_first": F.row_number().over(of_block) == 1})
    shared = F.col("_top") - emax
    return df.withColumns({"block_nan": (F.col("_bad") == 1) | F.coalesce(shared > limit, F.lit(False)), "scale_clamped": F.coalesce(shared < -limit,
        F.lit(False)), "_shared": F.greatest(shared, ONE(-limit))})


def mx_round(df: DataFrame, key: list[str], idx: str = "idx", bits: str = "bits", esz: int = 4, mbits: int | Column = 3,
    emax: int = 8, emin: int = -6, scale_bits: int = 8, block: int = 32, sites: DataFrame | None = None) -> DataFrame:
    """`df` with mx_bits and the flags changed, flushed, saturated, block_nan, scale_clamped.

    The shared exponent of a block is the largest floor(log2 |v|) less emax. A block with an infinity or NaN, or with a
    scale above its range, becomes NaN; one with a scale below it is clamped; one of zeros stays. Ties round away from
    zero, what is too small becomes a zero of its sign, and the top binade ends at 1.75 * 2**emax (1.111 is NaN there) for
    emax 8 with 3 mantissa bits, else at the largest significand. With `sites`, only rows whose `site` is in it change.
    """
    width, mant, bias = FLOATS[esz]
    special = (1 << width) - 1
    nan_bits = (special << mant) | (1 << (mant - 1))
    v = F.col(bits)
    keep = mbits if isinstance(mbits, Column) else ONE(mbits)
    if "_shared" not in df.columns:
        df = block_scales(df, key, idx, bits, esz, emax, scale_bits, block)
    # quantum: the value of the last mantissa bit kept, as a power of two
    df = df.withColumn("_q", F.greatest(F.col("_lead"), F.col("_shared") + emin) - keep)
    drop = F.col("_q") - F.col("_unit")
    half = shl(ONE(1), F.greatest(drop - 1, ONE(0)))
    rounded = F.when(drop <= 0, F.col("_sig")).when(drop > mant + 2, ONE(0)).otherwise(shr(F.col("_sig") + half, drop))
    df = df.withColumn("_r", rounded).withColumn("_qq", F.when(drop <= 0, F.col("_unit")).otherwise(F.col("_q")))
    # saturation: r * 2**qq above top significand at the top binade
    top_sig = shl(ONE(1), keep + 1) - 1 - F.when((keep == 3) & (F.lit(emax) == 8), ONE(1)).otherwise(ONE(0))
    at_top = F.col("_shared") + emax - keep
    over = (drop > 0) & (F.col("_qq") == at_top) & (F.col("_r") > top_sig)
    # not rounded (drop <= 0) means fewer bits than kept: it can still lie above the top significand
    wide = (drop <= 0) & (F.col("_lead") == F.col("_shared") + emax) & (F.col("_sig") > shl(top_sig, F.greatest(at_top - F.col("_unit"), ONE(0)))) & (at_top >= F.col("_unit"))
    df = df.withColumn("saturated", F.coalesce(over | wide, F.lit(False)) & ~F.col("block_nan"))
    df = df.withColumns({"_r": F.when(F.col("saturated"), top_sig).otherwise(F.col("_r")), "_qq": F.when(F.col("saturated"), at_top).otherwise(F.col("_qq"))})
    # back to bits: r * 2**qq, normal or subnormal, overflow to infinity
    length = F.length(F.bin("_r")).cast("long")
    exp = length - 1 + F.col("_qq") + bias
    normal = F.shiftleft(exp, mant).bitwiseOR(F.when(length - 1 <= mant, shl(F.col("_r"), F.greatest(mant - length + 1,
        ONE(0)))).otherwise(shr(F.col("_r"), F.greatest(length - 1 - mant, ONE(0)))).bitwiseAND(ONE((1 << mant) - 1)))
    low = F.col("_qq") - (1 - bias - mant)
    sub = F.when(low >= 0, shl(F.col("_r"), F.greatest(low, ONE(0)))).otherwise(shr(F.col("_r"), F.greatest(-low, ONE(0))))
    magnitude = F.when(F.col("_r") == 0, ONE(0)).when(exp >= special, ONE(special << mant)).when(exp >= 1, normal).otherwise(sub)
    out = F.when(F.col("block_nan"), ONE(nan_bits)).when(F.col("_lead").isNull(), v).otherwise(F.col("_sign").bitwiseOR(magnitude))
    chosen = F.lit(True)
    if sites is not None:
        df = df.join(sites.select("site").distinct().withColumn("_chosen", F.lit(True)), "site", "left")
        chosen = F.coalesce("_chosen", F.lit(False))
    df = df.withColumn("mx_bits", F.when(chosen, out).otherwise(v))
    flushed = chosen & ~F.col("block_nan") & F.col("_lead").isNotNull() & (F.col("_r") == 0)
    df = df.withColumns({"changed": F.col("mx_bits") != v, "flushed": flushed, "saturated": F.col("saturated") & chosen})
    return df.drop(*(c for c in df.columns if c.startswith("_")))


def mx_summary(rounded: DataFrame, key: list[str], by: list[str], idx: str = "idx", block: int = 32) -> DataFrame:
    """Counters per group: stores, values changed, flushed and saturated, blocks, blocks made NaN, scales clamped.

    Where `rounded` has block_first (an element of each block), it stands for its block, and blocks need no grouping of their own.
    """
    if "block_first" in rounded.columns:
        first = F.col("block_first")
        return rounded.groupBy(*by).agg(F.count("*").alias("stores"), *(F.count_if(F.col(c)).alias(f"values_{c}") for c in ("changed", "flushed", "saturated")),
            F.count_if(first).alias("blocks"), F.count_if(first & F.col("block_nan")).alias("blocks_nan"), F.count_if(first & F.col("scale_clamped")).alias("scales_clamped"))
    blocks = rounded.groupBy(*dict.fromkeys([*by, *key]), F.floor(F.col(idx) / block).alias("_b")).agg(F.count("*").alias("n"),
        *(F.sum(F.col(c).cast("long")).alias(c) for c in ("changed", "flushed", "saturated")), F.max(F.col("block_nan").cast("long")).alias("nan"),
        F.max(F.col("scale_clamped").cast("long")).alias("low"))
    return blocks.groupBy(*by).agg(F.sum("n").alias("stores"), *(F.sum(c).alias(f"values_{c}") for c in ("changed", "flushed",
        "saturated")), F.count("*").alias("blocks"), F.sum("nan").alias("blocks_nan"), F.sum("low").alias("scales_clamped"))


def mantissa_sweep(df: DataFrame, key: list[str], by: list[str], widths: tuple[int, ...] = (23, 16, 10, 7, 3), **options) -> DataFrame:
    """Counters for every mantissa width; the input is read, and its blocks' scales are found, once for all widths."""
    scales = {k: v for k, v in options.items() if k in ("idx", "bits", "esz", "emax", "scale_bits", "block")}
    rows = block_scales(df, key, **scales).withColumn("mbits", F.explode(F.array(*map(F.lit, widths))))
    if set(by) <= set(key):  # a block is in one group
        rows = rows.withColumn("block_first", F.col("_first"))
    return mx_summary(mx_round(rows, key, mbits=F.col("mbits").cast("long"), **options), key, [*by, "mbits"])
