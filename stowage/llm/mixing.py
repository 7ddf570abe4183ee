"""Mixing sources to target weights by entropy balancing, in DataFrame functions.

Each document gets a rate, the copies of it that the mix takes on average. Among all rates up to `most` that give every source its
target of words, those nearest to one copy each (in relative entropy) are exponentially tilted: rate = exp(tilt * size / mean size of
the source), cut at `most`. The tilts solve the convex dual, here by Newton iterations: each evaluates the dual's gradient and curvature of
every source over the counts of (source, size), and a step that leaves the bracket known to hold the solution is halved into it.
Rates are then rounded to copies, so that what one size takes too much or too little is made up by the next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import in_order
from .shared import drop_written, keyed, tidy, written

#: Words are separated by these.
SEPARATORS = r"[\x20\x09-\x0D]+"
LANE = 4096  # expected rows of a part of one (source, size)
CHUNK_BITS = 10  # sizes that are rounded one after another: 2**10 consecutive ones
STEPS = 4  # Newton steps in one job
UNIT = 1024  # words are rounded in parts of 1 / UNIT
NARROW = 1e-9  # brackets narrower than this part of their ends are closed


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")).cast("long")


def source_targets(sources: DataFrame, most: int) -> DataFrame:
    """key, source_size, n, mean, least -> the same with `target`: weights 1, 2, 3, repeating in the order of keys, share the total of all sizes.

    A target stops at `most` times the source's size; what is over is shared by weight among the others, until none is above. Each round
    is an aggregation that leaves two numbers; there are as many rounds as the rule asks for.
    """
    ordered = in_order(sources, "all", F.col("key"), name="sources")
    open_ = written(ordered.withColumn("weight", F.col("place") % 3 + 1).withColumn("limit", F.col("source_size") * most).drop("place", "total"), "weights")
    total = open_.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rate = math.inf
    while True:  # the rate per weight only falls behind limits that it exceeds, so a source that is at its limit stays there
        at_limit = F.col("limit") <= rate * F.col("weight") if math.isfinite(rate) else F.lit(False)
        held, weight = open_.agg(F.sum(F.when(at_limit, F.col("limit"))), F.sum(F.when(~at_limit, F.col("weight")))).first()
        new = (total - (held or 0)) / weight if weight else math.inf
        if new == rate or not weight:
            break
        rate = new
    target = F.least(F.col("limit").cast("double"), F.lit(rate) * F.col("weight")) if math.isfinite(rate) else F.col("limit").cast("double")
    return open_.withColumn("target", target)


def rate_of(tilt: Column, size: Column, mean: Column, most: int) -> Column:
    """exp(tilt * size / mean), cut at `most`. The JVM's strict exponential: the same on every machine."""
    return F.exp(F.least(tilt * (size / mean), F.lit(math.log(most))))


def newton_step(cells: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """One step of every source. Sums are of decimals, so they don't depend on the order in which tasks end."""
    exact = lambda x: F.sum(x.cast("decimal(38,6)"))
    x = F.col("size") / F.col("mean")
    words = F.col("m") * F.col("size") * rate_of(F.col("tilt"), F.col("size"), F.col("mean"), most)
    free = F.col("tilt") * x < math.log(most)
    sums = cells.join(state.select("key", "mean", "tilt"), "key").groupBy("key").agg(exact(words).alias("words"), exact(F.when(free, words * x)).alias("curve"))
    out = state.join(sums, "key").withColumns({"words": F.col("words").cast("double"), "curve": F.coalesce("curve", F.lit(0)).cast("double")})
    over = F.col("words") > F.col("target")
    out = out.withColumns({"low": F.when(over, F.col("low")).otherwise(F.col("tilt")), "high": F.when(over, F.col("tilt")).otherwise(F.col("high"))})
    newton = F.col("tilt") + (F.col("target") - F.col("words")) / F.col("curve")
    middle = (F.col("low") + F.col("high")) / 2
    inside = (F.col("curve") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
    near = (F.abs(F.col("words") - F.col("target")) <= F.greatest(F.lit(0.5), 1e-7 * F.col("target"))) | (F.col("high") - F.col("low") <= NARROW * (F.abs("low") + F.abs("high")))
    out = out.withColumn("next", F.when(F.col("done") | near, F.col("tilt")).when(inside, newton).otherwise(middle)).withColumn("done", F.col("done") | near)
    return out.withColumn("tilt", F.col("next")).drop("words", "curve", "next")


def solve(cells: DataFrame, sources: DataFrame, most: int, steps: int = 200) -> DataFrame:
    """key, mean, target, tilt per source with words: the dual's solution."""
    ratio = F.log(F.col("target") / F.col("source_size"))
    far = F.col("mean") / F.col("least")  # tilts at which even the shortest document is past the mean rate that is asked for
    start = sources.where("source_size > 0").withColumns({"tilt": F.lit(0.0), "low": F.least(ratio * far, F.lit(0.0)) - 1e-9, "high": (math.log(most) * far + 1e-9).cast("double"), "done": F.lit(False)})
    full = F.col("target") >= F.col("limit")
    state = written(start.withColumn("tilt", F.when(full, F.col("high")).otherwise(F.col("tilt"))).withColumn("done", full), "tilts")
    for _ in range(steps // STEPS):
        new = state
        for _ in range(STEPS):
            new = newton_step(cells, new, most)
        new = written(new, "tilts")
        drop_written(state)
        state = new
        if state.where("not done").isEmpty():
            break
    return state


def round_chunk(cells: Column, carry: Column, most: int) -> Column:
    """Copies of every cell of an array by falling size, and the carry after the last: what was taken too little so far, in 1 / UNIT words."""

    def one(state: Column, cell: Column) -> Column:
        asked, one_copy = state["carry"] + cell["want"], cell["size"] * UNIT
        copies = F.floor((2 * asked + one_copy) / (2 * one_copy)).cast("long")
        copies = F.least(F.greatest(copies, F.lit(0).cast("long")), cell["m"] * most)
        return F.struct((asked - copies * one_copy).alias("carry"), F.concat(state["out"], F.array(F.struct(cell["size"].alias("size"), cell["m"].alias("m"), copies.alias("copies")))).alias("out"))

    first = F.struct(carry.cast("long").alias("carry"), F.array().cast("array<struct<size:bigint,m:bigint,copies:bigint>>").alias("out"))
    return F.aggregate(cells, first, one)


def round_copies(cells: DataFrame, solved: DataFrame, most: int) -> DataFrame:
    """key, size, m, copies: whole copies of all documents of a source and size together.

    Sizes are rounded one after another inside ranges of 2**CHUNK_BITS sizes, from the longest down; what the ranges leave over goes into the range of
    the source's shortest documents. So a source misses its target by half of a short document, unless limits leave no room.
    """
    rate = rate_of(F.col("tilt"), F.col("size"), F.col("mean"), most)
    wanted = cells.where("size > 0").join(solved.select("key", "mean", "tilt"), "key").withColumn("want", F.round(F.col("m") * F.col("size") * rate * UNIT).cast("long"))
    cell = F.struct((-F.col("size")).alias("order"), "size", "m", "want")
    chunks = wanted.groupBy("key", F.shiftright("size", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    last = F.col("chunk") == F.min("chunk").over(Window.partitionBy("key"))
    chunks = written(chunks.withColumn("last", last), "chunks")
    above = chunks.where("not last").select("key", round_chunk(F.col("cells"), F.lit(0), most).alias("x"))
    carry = above.groupBy("key").agg(F.sum("x.carry").alias("carry"))
    lowest = chunks.where("last").join(carry, "key", "left").select("key", round_chunk(F.col("cells"), F.coalesce("carry", F.lit(0)), most).alias("x"))
    return above.unionByName(lowest).select("key", F.explode("x.out").alias("x")).select("key", "x.*")


def mix(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: per row of `docs`, how often the mix takes it.

    size is the number of words (null text: 0), taken = copies * size, copies at most `most`. A null source is a source, the last one. Documents of
    one source and size share a rate; which of them get the odd copies is up to a hash of doc_id and text, so that the same rows give
    the same mix, however they are stored. Repeated rows are documents of their own; documents without words are never taken, sources without
    words have target 0. No rows give no rows.
    """
    spark = docs.sparkSession
    name = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    sized = keyed(docs, "doc_id", "source", "text").select("doc_id", name.alias("key"), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("order"), "rk_f", "rk_r")
    with tidy(spark):
        sized = written(sized, "sized")
        rows = sized.count()
        cells = written(sized.groupBy("key", "size").agg(F.count("*").alias("m")), "cells")
        words = F.col("m") * F.col("size")
        sources = cells.groupBy("key").agg(F.sum(words).alias("source_size"), (F.sum(words) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("m"))), F.lit(1))).alias("mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
        sources = source_targets(written(sources.withColumn("all", F.lit(0)), "sources"), most)
        solved = solve(cells, sources, most)
        copies = written(round_copies(cells, solved, most), "copies")
        # Which documents of a (source, size): those that come first in an order by hash, counted in lanes.
        lanes = max(1, math.ceil(rows / LANE))
        sized = sized.withColumn("lane", F.pmod("order", F.lit(lanes)))
        each = sized.groupBy("key", "size", "lane").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("key", "size").orderBy("lane")) - F.col("n")
        each = each.withColumn("before", before).join(copies, ["key", "size"], "left")
        each = each.select("key", "size", "lane", "before", F.expr("coalesce(copies div m, 0)").alias("all"), F.coalesce(F.col("copies") % F.col("m"), F.lit(0)).alias("odd"))
        nth = F.row_number().over(Window.partitionBy("key", "size", "lane").orderBy("order", "rk_f", "rk_r")) - 1
        taken = sized.withColumn("nth", nth).join(each, ["key", "size", "lane"])
        taken = taken.withColumn("copies", F.col("all") + F.when(F.col("before") + F.col("nth") < F.col("odd"), 1).otherwise(0))
        taken = taken.join(sources.select("key", "source_size", "target"), "key")
        return taken.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
