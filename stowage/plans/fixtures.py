"""Trace views derived from the given tables, for Spark and (the same rows) for DuckDB.

li: two runs of four benches that share addresses; emb: dense tensors; ev: one store per event, in two runs; hot: two runs of one buffer each, in which one
cell takes most stores; mix: li, emb and ev together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rn of the views is spread over numbers of some 60 bits; ranges of 2**RN_BITS of it hold some thousand stores.
RN_BITS = 44


def f64_bits(x) -> Column:
    """The bits of a double, in the JVM."""
    return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x).cast("long")


def f32_bits(x) -> Column:
    return F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


FRAMES = ("solve_grid", "__phys_MOD_alloc_state", "std::vector<int, A>::grow(int)", "read_input", "???", "main")
STACKS = tuple(f"   at 0x4C2: malloc (vg_replace_malloc.c:381)\n   by 0x10: {name} (src.c:10)\n   by 0x20: main (main.c:5)" for name in FRAMES)
MAIN = "   by 0x10: main (main.c:5)"
_STACKS = " ".join("WHEN {} THEN '{}'".format(i, s.replace("\n", "' || chr(10) || '")) for i, s in enumerate(STACKS))
_DUCK64 = "CAST(CAST({x} AS BIT) AS BIGINT)"
_DUCK32 = "(CAST(CAST(CAST({x} AS BIT) AS INTEGER) AS BIGINT) & 4294967295)"
_QUANTITY = _DUCK64.format(x="CAST(CASE WHEN l_partkey % 2 = 0 THEN l_quantity ELSE l_discount END AS DOUBLE)")
_TAX = _DUCK32.format(x="CAST(l_tax AS FLOAT)")
_RN = "((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 1048576 + l_partkey) * 4096 + l_suppkey"

DUCK = {
    "li": f"""
SELECT run_id, bench, alloc_addr, alloc_size, alloc_type, generation, CASE k % 6 {_STACKS} END AS alloc_stack, "offset",
       CASE alloc_type WHEN '64bits' THEN {_QUANTITY}
                       WHEN '32bits' THEN CASE WHEN l_partkey % 3 = 0 THEN CAST(l_linenumber AS BIGINT) ELSE {_TAX} END
                       ELSE CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE CAST(l_orderkey AS BIGINT) END END AS value, rn
FROM (SELECT *, 'r' || (l_orderkey % 2) AS run_id, concat(l_returnflag, l_linestatus) AS bench, CAST(65536 * (k + 1) AS BIGINT) AS alloc_addr, CAST(512 * (1 + k % 5) AS BIGINT) AS alloc_size,
             CASE WHEN k % 4 = 0 THEN 'object' WHEN k % 4 = 1 THEN '32bits' ELSE '64bits' END AS alloc_type, CAST(1 + l_linenumber % 3 AS BIGINT) AS generation,
             CAST(CASE WHEN k % 4 = 0 THEN (l_partkey * 7) % 509 WHEN k % 4 = 1 THEN 4 * (l_partkey % 128) ELSE 8 * (l_partkey % 64) END AS BIGINT) AS "offset",
             {_RN} AS rn
      FROM (SELECT *, l_suppkey % 32 AS k FROM lineitem))
""",
    "hot": f"""
SELECT 'r' || (l_orderkey % 2) AS run_id, 'hot' AS bench, CAST(65536 AS BIGINT) AS alloc_addr, CAST(4096 AS BIGINT) AS alloc_size, '64bits' AS alloc_type, CAST(1 AS BIGINT) AS generation,
       '{MAIN}' AS alloc_stack, CAST(CASE WHEN l_partkey % 10 = 0 THEN 8 * (l_suppkey % 64) ELSE 256 END AS BIGINT) AS "offset",
       {_DUCK64.format(x="CAST(l_linenumber % 3 AS DOUBLE)")} AS value, {_RN} AS rn
FROM lineitem
""",
    "emb": f"""
SELECT 'r0' AS run_id, 'label_' || label AS bench, CAST(65536 + vec_id * 256 AS BIGINT) AS alloc_addr, CAST(256 AS BIGINT) AS alloc_size, '32bits' AS alloc_type, CAST(1 AS BIGINT) AS generation,
       '{MAIN}' AS alloc_stack, CAST(4 * pos AS BIGINT) AS "offset", {_DUCK32.format(x="x")} AS value, CAST(vec_id * 64 + pos AS BIGINT) AS rn
FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings)
""",
    "ev": f"""
SELECT 'r' || (event_id % 2) AS run_id, event_type AS bench, CAST(65536 * (user_id % 16 + 1) AS BIGINT) AS alloc_addr, CAST(256 AS BIGINT) AS alloc_size, '64bits' AS alloc_type, CAST(1 AS BIGINT) AS generation,
       '{MAIN}' AS alloc_stack, CAST(8 * (event_id % 16) AS BIGINT) AS "offset", {_DUCK64.format(x="CAST(floor(value / 50) AS DOUBLE)")} AS value, CAST(event_id AS BIGINT) AS rn
FROM events
""",
}
DUCK["mix"] = " UNION ALL ".join(f"({DUCK[view]})" for view in ("li", "emb", "ev"))


def number(x) -> Column:
    return F.lit(x).cast("long")


def trace(spark: SparkSession, sf_dir: str, view: str = "li") -> DataFrame:
    """A store trace: run_id, bench, alloc_addr, alloc_size, alloc_type, generation, alloc_stack, offset, value, rn."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if view == "mix":
        return trace(spark, sf_dir, "li").unionByName(trace(spark, sf_dir, "emb")).unionByName(trace(spark, sf_dir, "ev"))
    if view == "emb":
        rows = read("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
        vec, pos = F.col("vec_id").cast("long"), F.col("pos").cast("long")
        return rows.select(
            F.lit("r0").alias("run_id"), F.concat(F.lit("label_"), "label").alias("bench"), (65536 + vec * 256).alias("alloc_addr"), number(256).alias("alloc_size"),
            F.lit("32bits").alias("alloc_type"), number(1).alias("generation"), F.lit(MAIN).alias("alloc_stack"), (4 * pos).alias("offset"),
            f32_bits(F.col("x").cast("float")).alias("value"), (vec * 64 + pos).alias("rn"),
        )
    if view == "ev":
        e = read("events")
        event = F.col("event_id").cast("long")
        return e.select(
            F.concat(F.lit("r"), (event % 2).cast("string")).alias("run_id"), F.col("event_type").alias("bench"), (65536 * (F.col("user_id").cast("long") % 16 + 1)).alias("alloc_addr"), number(256).alias("alloc_size"),
            F.lit("64bits").alias("alloc_type"), number(1).alias("generation"), F.lit(MAIN).alias("alloc_stack"), (8 * (event % 16)).alias("offset"),
            f64_bits(F.floor(F.col("value") / 50).cast("double")).alias("value"), event.alias("rn"),
        )
    order, part, line = (F.col(f"l_{c}").cast("long") for c in ("orderkey", "partkey", "linenumber"))
    run = F.concat(F.lit("r"), (order % 2).cast("string")).alias("run_id")
    rn = (((order * 8 + line) * 1048576 + part) * 4096 + F.col("l_suppkey")).alias("rn")
    if view == "hot":
        offset = F.when(part % 10 == 0, 8 * (F.col("l_suppkey").cast("long") % 64)).otherwise(256)
        return read("lineitem").select(
            run, F.lit("hot").alias("bench"), number(65536).alias("alloc_addr"), number(4096).alias("alloc_size"), F.lit("64bits").alias("alloc_type"), number(1).alias("generation"),
            F.lit(MAIN).alias("alloc_stack"), offset.alias("offset"), f64_bits((line % 3).cast("double")).alias("value"), rn,
        )
    k = F.col("k")
    kind = F.when(k % 4 == 0, "object").when(k % 4 == 1, "32bits").otherwise("64bits")
    wide = f64_bits(F.when(part % 2 == 0, F.col("l_quantity")).otherwise(F.col("l_discount")).cast("double"))
    narrow = F.when(part % 3 == 0, line).otherwise(f32_bits(F.col("l_tax").cast("float")))
    value = F.when(kind == "64bits", wide).when(kind == "32bits", narrow).otherwise(F.when(part % 4 == 0, 0).otherwise(order))
    offset = F.when(k % 4 == 0, (part * 7) % 509).when(k % 4 == 1, 4 * (part % 128)).otherwise(8 * (part % 64))
    return read("lineitem").withColumn("k", F.col("l_suppkey").cast("long") % 32).select(
        run, F.concat("l_returnflag", "l_linestatus").alias("bench"), (65536 * (k + 1)).alias("alloc_addr"), (512 * (1 + k % 5)).alias("alloc_size"),
        kind.alias("alloc_type"), (1 + line % 3).alias("generation"), F.get(F.array(*map(F.lit, STACKS)), (k % 6).cast("int")).alias("alloc_stack"),
        offset.cast("long").alias("offset"), value.alias("value"), rn,
    )
