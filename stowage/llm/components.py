"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written


def _least(edges: DataFrame) -> DataFrame:
    """u -> the least of u's neighbours and u. A partial minimum per task keeps a node of very many links cheap."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the links (a, b); root is the least node of its component.

    Each round is two joins and minimums on links, never a group gathered whole: the links of a node of any degree stay
    spread, and the round's result is written to the shared folder. Loops, repeated links and either direction are
    fine; links with a null end are left out; no links give no rows. Ends by raising if the rounds don't suffice.
    """
    edges = written(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = written(small, "links")
        # Every component is a star once no node has two smaller ends and no smaller end has one of its own.
        roots = after.select(F.col("v").alias("u")).distinct()
        unsettled = after.groupBy("u").count().where("count > 1").select("u").union(after.join(roots, "u", "left_semi").select("u")).limit(1).count()
        drop_written(edges)
        edges = after
        if not unsettled:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("the components did not settle")
