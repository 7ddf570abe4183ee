"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix, in DataFrame functions.

How many rows of each partition go to each shard is drawn first, exactly as a uniform permutation would have it: each
count is hypergeometric given those before. Each partition then permutes its rows and deals them out by these
counts, and each shard permutes what it gets. Counts are drawn on two levels (groups of partitions, then the
partitions of each group side by side), so that no task draws for more than `GROUP` partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keyed, written

ROWS = 4096  # expected rows of a partition, and of a part of a shard
GROUP = 512


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_factorial(n: Column) -> Column:
    """Exact sums below 10, Stirling's series above (error under 1e-10)."""
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(10)))
    x = F.greatest(n, F.lit(10)).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n < 10, F.get(small, n.cast("int"))).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """How many of `draws` from good + bad are good, from u uniform in [0, 1): the distribution is walked from its mode outwards."""

    def walk(s: Column) -> Column:
        g, b, d, mode = s["g"], s["b"], s["d"], s["mode"]
        start = F.exp(log_choose(g, mode) + log_choose(b, d - mode) - log_choose(g + b, d))
        spread = F.sqrt(d * (g / F.greatest(g + b, F.lit(1))) * (b / F.greatest(g + b, F.lit(1))) + 1)
        steps = F.least(F.greatest(F.least(g, d) - mode, mode - F.greatest(F.lit(0), d - b), F.lit(1)), F.ceil(12 * spread) + 20)
        first = F.struct((s["u"] - start).alias("u"), start.alias("up"), start.alias("down"), F.when(s["u"] < start, mode).otherwise(F.lit(-1).cast("long")).alias("x"))

        def step(a: Column, i: Column) -> Column:
            hi, lo = mode + i - 1, mode - i + 1
            up = a["up"] * F.greatest(g - hi, F.lit(0)) * F.greatest(d - hi, F.lit(0)) / ((hi + 1) * F.greatest(b - d + hi + 1, F.lit(1)))
            down = a["down"] * F.greatest(lo, F.lit(0)) * F.greatest(b - d + lo, F.lit(0)) / ((g - lo + 1) * (d - lo + 1))
            found = F.when(a["x"] >= 0, a["x"]).when(a["u"] < up, hi + 1).when(a["u"] < up + down, lo - 1).otherwise(F.lit(-1).cast("long"))
            return F.struct((a["u"] - up - down).alias("u"), up.alias("up"), down.alias("down"), found.alias("x"))

        # Rounding can leave u past the last step: the mode then.
        return F.aggregate(F.sequence(F.lit(1).cast("long"), steps.cast("long")), first, step, lambda a: F.when(a["x"] >= 0, a["x"]).otherwise(mode))

    mode = F.least(F.floor((draws + 1) * ((good + 1) / (good + bad + 2))), good, draws)
    mode = F.greatest(mode, draws - bad).cast("long")
    return let(F.struct(u.alias("u"), good.cast("long").alias("g"), bad.cast("long").alias("b"), draws.cast("long").alias("d"), mode.alias("mode")), walk)


def uniform(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def draw_matrix(sizes: Column, room: Column, name: Column, seed: int) -> Column:
    """An array (per size) of arrays (per shard): sizes are dealt out over the room of the shards, both used up."""

    def one(state: Column, i: Column) -> Column:
        def shard(s: Column, j: Column) -> Column:
            good = F.get(state["room"], j)
            x = hypergeometric(uniform(name, i, j, F.lit(seed)), good, s["pool"] - good, s["left"])
            return let(x, lambda v: F.struct((s["left"] - v).alias("left"), (s["pool"] - good).alias("pool"), F.concat(s["row"], F.array(v)).alias("row")))

        first = F.struct(F.get(sizes, i).alias("left"), F.aggregate(state["room"], F.lit(0).cast("long"), lambda a, b: a + b).alias("pool"), F.array().cast("array<bigint>").alias("row"))
        row = F.aggregate(F.sequence(F.lit(0), F.size(state["room"]) - 1), first, shard, lambda s: s["row"])
        return let(row, lambda r: F.struct(F.zip_with(state["room"], r, lambda a, b: a - b).alias("room"), F.concat(state["rows"], F.array(r)).alias("rows")))

    first = F.struct(room.alias("room"), F.array().cast("array<array<bigint>>").alias("rows"))
    return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), first, one, lambda s: s["rows"])


def uniform_shards(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: per row of `docs`; shard sizes are at most one apart, slots gapless from 0.

    Any arrangement of the rows is as likely as any other, up to the seed; the same rows in the same files give the
    same shards, also when tasks are run again. Rows have keys of their own, so repeated rows, equal texts and nulls are
    dealt out like any others; a null text has size 1. No rows give no rows.
    """
    rows = keyed(docs, "doc_id", "text")
    rows = rows.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64("rk_f", "rk_r", F.lit(seed)).alias("key"), "rk_f", "rk_r")
    total = rows.count()
    parts = max(1, math.ceil(total / ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(parts)).cast("int"))

    each = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("part") / GROUP).cast("int"))
    groups = each.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("own"), F.sum("n").alias("n"))
    top = groups.agg(F.array_sort(F.collect_list(F.struct("group", "n"))).alias("g"))
    room = F.array(*(F.lit(total // shards + (i < total % shards)).cast("long") for i in range(shards)))
    top = top.select("g.group", draw_matrix(F.col("g.n"), room, F.lit(-1), seed).alias("room")).select(F.explode(F.arrays_zip("group", "room")).alias("x")).select("x.*")
    quota = groups.join(top, "group").select("own.part", draw_matrix(F.col("own.n"), F.col("room"), F.col("group"), seed).alias("quota")).select(F.explode(F.arrays_zip("part", "quota")).alias("x")).select("x.*")
    ends = quota.select("part", F.transform("quota", lambda q, i: F.aggregate(F.slice("quota", 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b)).alias("ends"))

    local = rows.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("key", F.lit(2)), "rk_f", "rk_r")) - 1)
    dealt = local.join(ends, "part").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("nth"))))
    bits = max(0, (total // shards // ROWS).bit_length())
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", F.xxhash64("key", F.lit(3)).alias("order"), "rk_f", "rk_r").withColumn("bin", F.shiftrightunsigned("order", 64 - bits) if bits else F.lit(0).cast("long"))
    dealt = written(dealt, "dealt")
    bins = dealt.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    bins = bins.select("shard", "bin", (F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("before"))
    again = Window.partitionBy("shard", "bin").orderBy("order", "rk_f", "rk_r")
    return dealt.withColumn("nth", F.row_number().over(again) - 1).join(bins, ["shard", "bin"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).alias("slot"))
