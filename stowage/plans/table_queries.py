"""Profile, ingest and streaming operators registered over the given tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from stowage.operators import profiles as p
from stowage.plans import fixtures
from stowage.sources import traces
from stowage.sources.saved import saved, shared_folder
from stowage.streaming import traces as streaming


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def costs(spark, sf_dir):
    """Two runs of a line-level profile: odd and even orders."""
    l = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("run"), (F.col("l_orderkey") % 2).cast("string")).alias("run"),
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("string").alias("file"), F.concat("l_returnflag", "l_linestatus").alias("fn"),
        F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"))  # noqa: E741
    events = F.explode(F.array(F.struct(F.lit("quantity").alias("event"), F.col("quantity").alias("n")), F.struct(F.lit("price").alias("event"), F.col("price").alias("n")))).alias("x")
    return l.select("run", "file", "fn", "line", events).select("run", "file", "fn", "line", "x.*")


COSTS = """WITH costs AS (SELECT 'run' || (l_orderkey % 2) AS run, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS VARCHAR) AS file, l_returnflag || l_linestatus AS fn, CAST(l_linenumber AS INTEGER) AS line,
 unnest(['quantity', 'price']) AS event, unnest([CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)]) AS n FROM lineitem) """


def calls(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").cast("long").alias("n"))  # noqa: E741
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("caller"), F.col("l_returnflag").alias("callee")).agg(F.count("*").alias("calls"),
        F.sum("n").alias("n"))


CALLS = """
WITH calls AS (SELECT o_orderpriority AS caller, l_returnflag AS callee, count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT)) AS
       BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), own AS (SELECT l_returnflag AS fn, CAST(sum(l_linenumber)
       AS BIGINT) AS n FROM lineitem GROUP BY ALL) """


def own_costs(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("fn")).agg(F.sum("l_linenumber").cast("long").alias("n"))


def snapshots(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("run"), F.col("event_id").cast("long").alias("snapshot"), F.col("event_id").cast("long").alias("time"),
        (F.col("user_id").cast("long") * 100).alias("heap"), (F.col("event_id").cast("long") % 17).alias("extra"), F.lit(3).cast("long").alias("stacks"))


def readable(spark, sf_dir):
    """The files whose source is at hand, some of them newer than the profile."""
    number = F.col("file").cast("int")
    return costs(spark, sf_dir).select("file").distinct().where(number % 3 != 0).select("file", (number % 5 == 0).alias("stale"))


def heap_nodes(spark, sf_dir):
    rows = costs(spark, sf_dir).where("event = 'quantity'").groupBy("run", F.lit(0).alias("snapshot"), F.col("fn").alias("parent"), F.col("file").alias("path")).agg(F.sum("n").alias("bytes"))
    return rows.join(rows.groupBy("run").agg(F.sum("bytes").alias("total")), "run")


def heap_points(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    fs = F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return l.select(F.slice(fs, 1, (1 + F.col("l_orderkey") % 3).cast("int")).alias("fs"), F.col("l_quantity").cast("long").alias("tb"),
        F.lit(1).cast("long").alias("tbk"), (F.col("l_linenumber").cast("long") * 100).alias("tl"), (F.col("l_quantity").cast("long") * (F.col("l_orderkey").cast("long") % 2)).alias("gb"),
        (F.col("l_quantity").cast("long") * (F.col("l_partkey").cast("long") % 3)).alias("eb"), (F.col("l_partkey").cast("long") % 50).alias("rb"),
        (F.col("l_suppkey").cast("long") % 9).alias("wb"))


COUNTERS = ["tb", "tbk", "tl", "gb", "eb", "rb", "wb"]
POINTS = """
WITH points AS (SELECT [l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)][1 : 1 + l_orderkey % 3] AS fs, CAST(l_quantity AS
       BIGINT) AS tb, 1 AS tbk, l_linenumber * 100 AS tl, CAST(l_quantity AS BIGINT) * (l_orderkey % 2) AS gb, CAST(l_quantity AS BIGINT) *
       (l_partkey % 3) AS eb, l_partkey % 50 AS rb, l_suppkey % 9 AS wb FROM lineitem), tree AS (SELECT fs[1 : i] AS prefix, """ + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTERS) + " FROM points, range(1, 4) r(i) WHERE i <= len(fs) GROUP BY ALL) "


def named(df):
    return df.withColumn("prefix", F.array_join("prefix", "/"))


def block_events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.lit("r").alias("run"), (F.col("user_id") % 4).cast("int").alias("thread"), F.col("event_id").cast("long").alias("seq"),
        F.col("event_type").alias("block"), (1 + F.col("user_id").cast("long") % 7).alias("n_instr"))


def allocations(spark, sf_dir):
    """Allocations at 16 addresses, one after another at each."""
    o = read(spark, sf_dir, "orders")
    events = o.select(F.lit("r0").alias("run_id"), (F.col("o_orderkey").cast("long") * 10).alias("seq"), F.lit("ALLOC").alias("kind"),
        ((F.col("o_custkey").cast("long") % 16) * 8192).alias("addr"), (4096 + (F.col("o_orderkey").cast("long") % 5) * 1500).alias("size"),
        F.lit(None).cast("string").alias("frame"), F.col("o_orderkey").cast("long").alias("block"), F.lit("ALLOC").alias("inside"))
    return traces.pair_lifetimes(events)


def stores(spark, sf_dir):
    """One store per order line number."""
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").cast("long").alias("part"), F.min("l_suppkey").cast("long").alias("supp"))  # noqa: E741
    return l.select(F.lit("r0").alias("run_id"), (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("seq"),
        ((F.col("part") * 37 % 18) * 8192 + F.col("supp") * 977 % 8192).alias("addr"), F.col("part").alias("value"))


INGEST = """WITH allocs AS (SELECT o_orderkey * 10 AS seq, lead(o_orderkey * 10) OVER w AS end_seq, (o_custkey % 16) * 8192 AS alloc_addr, 4096 + (o_orderkey % 5) * 1500 AS alloc_size, row_number() OVER w AS generation
 FROM orders WINDOW w AS (PARTITION BY o_custkey % 16 ORDER BY o_orderkey)),
stores AS (SELECT l_orderkey * 10 + l_linenumber AS seq, (min(l_partkey) * 37 % 18) * 8192 + min(l_suppkey) * 977 % 8192 AS addr FROM lineitem GROUP BY l_orderkey, l_linenumber),
near AS (SELECT s.seq, s.addr, a.* EXCLUDE (seq), a.seq AS alloc_seq FROM stores s JOIN (SELECT *, unnest([alloc_addr // 8192, alloc_addr
      // 8192 + 1]) AS page FROM allocs) a ON s.addr // 8192 = a.page AND s.addr >= alloc_addr AND s.addr < alloc_addr + alloc_size AND a.seq
      < s.seq AND (end_seq IS NULL OR s.seq < end_seq)),
met AS (SELECT seq, addr, arg_max(alloc_addr, alloc_seq) AS alloc_addr, arg_max(generation, alloc_seq) AS generation FROM near GROUP BY ALL) """


def attributed(spark, sf_dir):
    return traces.attribute_stores(saved(stores(spark, sf_dir), "stores"), saved(allocations(spark, sf_dir), "allocations"))


#: Events that a micro-batch of event_stream() has, about.
EVENTS = 1 << 23


def in_order(spark, at):
    """Gives the files below `at` times in the order of their names, a second apart, and says whether their file system keeps them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda: sorted(((x.getPath().getName(), x) for x in files.listStatus(folder) if x.getPath().getName().startswith("part-")), key=lambda x: x[0])
    parts = listed()
    began = int(time.time() - len(parts)) * 1000
    for i, (_, part) in enumerate(parts):
        files.setTimes(part.getPath(), began + 1000 * i, -1)
    times = [part.getModificationTime() for _, part in listed()]
    return all(a < b for a, b in zip(times, times[1:], strict=False))


def event_stream(spark, sf_dir):
    """A stream of all allocations and stores, in files of the shared folder.

    A file has a range of seq, and a micro-batch is one file, the earlier first: what a step holds of a batch does not grow with the tables. Where a file system
    gives files no times, all files are one batch.
    """
    o = read(spark, sf_dir, "orders")
    blocks = o.select(
        F.lit("r0").alias("run_id"), (F.col("o_orderkey").cast("long") * 10).alias("seq"), F.lit("ALLOC").alias("kind"), ((F.col("o_custkey").cast("long") % 16) * 8192).alias("addr"),
        (4096 + (F.col("o_orderkey").cast("long") % 5) * 1500).alias("size"), F.lit(None).cast("long").alias("value"),
    )
    writes = stores(spark, sf_dir).select("run_id", "seq", F.lit("STORE").alias("kind"), "addr", F.lit(None).cast("long").alias("size"), "value")
    at = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    parts = -(-(o.count() + read(spark, sf_dir, "lineitem").count()) // EVENTS)
    events = blocks.unionByName(writes)
    (events.repartitionByRange(parts, "seq") if parts > 1 else events).write.parquet(at)
    source = spark.readStream.schema(spark.read.parquet(at).schema)
    if parts > 1 and in_order(spark, at):
        source = source.option("maxFilesPerTrigger", 1)
    return source.parquet(at)


def timeline_input(spark, sf_dir):
    a = allocations(spark, sf_dir)
    return a.select("run_id", "seq", "end_seq", F.col("alloc_size").alias("size"), F.concat(F.lit("site"), F.col("alloc_addr").cast("string")).alias("site"))


def stream(spark, sf_dir, view):
    """A streaming trace of the table's files."""

    class Streams:
        class read:
            @staticmethod
            def parquet(path):
                # As a pattern: a stream takes no path of a single file, and a table may be one.
                return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")

    return fixtures.trace(Streams, sf_dir, view)


BIG = "CAST(sum({0}) AS BIGINT) AS {0}"
ROLLUP = """, kept AS (SELECT * FROM (SELECT file, fn, CAST(sum(n) AS BIGINT) AS inner_n, CAST(sum(sum(n)) OVER (PARTITION BY file) AS BIGINT) AS outer_n, sum(sum(n)) OVER () AS total FROM costs WHERE event = 'price' GROUP BY file, fn) WHERE 100 * inner_n >= 0.15 * total),
outers AS (SELECT file, sum(outer_n) OVER (ORDER BY outer_n DESC, file ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT DISTINCT file, outer_n FROM kept))
SELECT file, fn, outer_n, inner_n, round(100 * inner_n / total, 9) AS inner_pct, round(100 * outer_n / total, 9) AS outer_pct, round(100 * cum / total, 9) AS cum_pct FROM kept JOIN outers USING (file)"""
SHORT_LIVED = 400.0
#: preset -> condition of its nodes, on the tree's counters and their totals (tb_all ...).
PRESET_SQL = {
    "total_bytes": "tb >= 0.01 * tb_all",
    "total_blocks": "tbk >= 0.01 * tbk_all",
    "total_blocks_tiny": "tbk >= 0.005 * tbk_all AND tb / tbk <= 16",
    "total_blocks_short_lived": f"tbk >= 0.005 * tbk_all AND tl / tbk <= {SHORT_LIVED}",
    "total_bytes_zero_reads_or_writes": "tb >= 0.005 * tb_all AND (rb = 0 OR wb = 0)",
    "total_blocks_zero_reads_or_writes": "tbk >= 0.005 * tbk_all AND (rb = 0 OR wb = 0)",
    "total_bytes_low_access": "tb >= 0.005 * tb_all AND rb <> 0 AND wb <> 0 AND (rb / tb <= 0.4 OR wb / tb <= 0.4)",
    "total_blocks_low_access": "tbk >= 0.005 * tbk_all AND rb <> 0 AND wb <> 0 AND (rb / tb <= 0.4 OR wb / tb <= 0.4)",
    "at_peak_bytes": "gb >= 0.01 * gb_all",
    "at_end_bytes": "eb >= 0.01 * eb_all",
    "reads_bytes": "rb >= 0.01 * rb_all",
    "reads_bytes_high_access": "rb >= 0.005 * rb_all AND (rb / tb >= 1000 OR wb / tb >= 1000)",
    "writes_bytes": "wb >= 0.01 * wb_all",
    "writes_bytes_high_access": "wb >= 0.005 * wb_all AND (rb / tb >= 1000 OR wb / tb >= 1000)",
}
PRESETS = (
    ", sums AS (SELECT " + ", ".join(f"sum({c}) AS {c}_all" for c in ("tb", "tbk", "tl", "gb", "eb", "rb", "wb")) + " FROM tree WHERE len(prefix) = 1) "
    + " UNION ALL ".join(f"SELECT '{name}' AS preset, array_to_string(prefix, '/') AS prefix FROM tree, sums WHERE {condition}" for name, condition in PRESET_SQL.items())
)
DEFS = {
    "f02_merge_profiles": (lambda s, d: p.merge_profiles(costs(s, d)), COSTS + "SELECT file, fn, line, event, CAST(sum(n) AS BIGINT) AS n FROM costs GROUP BY ALL"),
    "f03_diff_profiles": (lambda s, d: p.diff_profiles(costs(s, d).where("run = 'run0'"), costs(s, d).where("run = 'run1'")), COSTS + """
SELECT file, fn, event, CAST(sum(CASE run WHEN 'run1' THEN n ELSE -n END) AS BIGINT) AS n, 0 AS line
       FROM costs GROUP BY file, fn, event"""),
    "f04_rename_profiles": (lambda s, d: p.merge_profiles(p.rename_profiles(costs(s, d), (r"^(\d{4})\d\d$", "$1"), ("^[NR]", "X"))), COSTS + """
SELECT regexp_replace(file, '^(\\d{4})\\d\\d$', '\\1') AS file, regexp_replace(fn, '^[NR]', 'X') AS fn, line, event, CAST(sum(n) AS
       BIGINT) AS n FROM costs GROUP BY ALL"""),
    "f05_profile_rollup": (lambda s, d: p.profile_rollup(costs(s, d), "price", "file:fn", 0.15), COSTS + ROLLUP),
    "f06_line_costs": (lambda s, d: p.line_costs(costs(s, d)), COSTS + "SELECT file, line, event, CAST(sum(n) AS BIGINT) AS n FROM costs GROUP BY ALL"),
    "f06_attribution_summary": (lambda s, d: p.attribution_summary(costs(s, d), "price", readable(s, d), 1.0), COSTS + """,
files AS (SELECT file, CAST(file AS INTEGER) % 5 = 0 AS stale FROM (SELECT DISTINCT file FROM costs) WHERE CAST(file AS INTEGER) % 3 <> 0),
own AS (SELECT file, line, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY file) AS of_file, sum(sum(n)) OVER () AS total FROM costs WHERE event = 'price' GROUP BY file, line)
SELECT CASE WHEN 100 * of_file < 1.0 * total THEN 'below_threshold' WHEN stale IS NULL THEN 'unreadable' WHEN stale THEN 'stale_source' ELSE 'annotated' END AS class, CAST(sum(n) AS BIGINT) AS n
FROM own LEFT JOIN files USING (file) GROUP BY 1"""),
    "f07_call_costs": (lambda s, d: p.call_costs(own_costs(s, d), calls(s, d)), CALLS + """
SELECT fn, CAST(coalesce(own.n, 0) AS BIGINT) AS self_n, CAST(coalesce(own.n, 0) + coalesce(c.n, 0) AS BIGINT) AS inclusive_n
       FROM own FULL JOIN (SELECT caller AS fn, sum(n) AS n FROM calls GROUP BY caller) c USING (fn)"""),
    "f08_functions_to_threshold": (lambda s, d: p.functions_to_threshold(costs(s, d).where("event = 'price'").groupBy(F.col("file").alias("fn")).agg(F.sum("n").alias("n")), "n", 60.0), COSTS + """
SELECT fn, n, round(100 * n / total, 9) AS pct FROM (SELECT *, sum(n) OVER () AS total, sum(n) OVER (ORDER BY n DESC, fn ROWS UNBOUNDED
       PRECEDING) - n AS before FROM (SELECT file AS fn, CAST(sum(n) AS BIGINT) AS n FROM costs WHERE event = 'price'
       GROUP BY file)) WHERE 100 * before < 60 * total"""),
    "f09_caller_callee_tree": (lambda s, d: p.caller_callee_tree(calls(s, d)), CALLS + """
SELECT *, CAST(row_number() OVER (PARTITION BY fn, role ORDER BY n DESC, other) AS INTEGER) AS rank
       FROM (SELECT callee AS fn, 'caller' AS role, caller AS other, calls, n FROM calls UNION ALL SELECT caller, 'callee', callee, calls,
       n FROM calls)"""),
    "f10_heap_snapshots": (lambda s, d: p.heap_snapshots(snapshots(s, d)), """
SELECT run, snapshot, snapshot AS time, total, snapshot = arg_max(snapshot, total * 1000000000 - snapshot) OVER (PARTITION BY run) AS
       is_peak FROM (SELECT event_type AS run, CAST(event_id AS BIGINT) AS snapshot, CAST(user_id * 100 + event_id % 17 + 3 AS BIGINT) AS total
       FROM events)"""),
    "f11_heap_tree_significant": (lambda s, d: p.heap_tree_significant(heap_nodes(s, d), 0.9), COSTS + """
, nodes AS (SELECT *, sum(bytes) OVER (PARTITION BY run) AS total FROM (SELECT run, 0 AS snapshot, fn AS parent, file AS path, CAST(sum(n)
       AS BIGINT) AS bytes FROM costs WHERE event = 'quantity' GROUP BY ALL)) SELECT run, snapshot, parent, path, bytes, 1 AS places
       FROM nodes WHERE 100 * bytes >= 0.9 * total UNION ALL SELECT run, snapshot, parent, '(below threshold)', CAST(sum(bytes) AS BIGINT),
       count(*) FROM nodes WHERE 100 * bytes < 0.9 * total GROUP BY run, snapshot, parent"""),
    "f13_heap_prefix_tree": (lambda s, d: named(p.heap_prefix_tree(heap_points(s, d), COUNTERS)), POINTS + "SELECT * REPLACE (array_to_string(prefix, '/') AS prefix) FROM tree"),
    "f14_heap_metrics": (lambda s, d: named(p.heap_metrics(p.heap_prefix_tree(heap_points(s, d), COUNTERS))), POINTS + """
SELECT array_to_string(prefix, '/') AS prefix, round(tb / tbk, 9) AS avg_size, round(tl / tbk, 9) AS avg_lifetime, round(rb / tb, 9)
       AS reads_per_byte, round(wb / tb, 9) AS writes_per_byte FROM tree"""),
    "f15_heap_significant": (lambda s, d: named(p.heap_significant(p.heap_prefix_tree(heap_points(s, d), COUNTERS), F.col("wb") > 0.155 * F.col("tb"))), POINTS + """
, hit AS (SELECT prefix FROM tree WHERE wb > 0.155 * tb) SELECT * REPLACE (array_to_string(prefix, '/') AS prefix)
       FROM tree WHERE EXISTS (SELECT 1 FROM hit WHERE hit.prefix[1 : len(tree.prefix)] = tree.prefix)"""),
    "f15_heap_presets": (lambda s, d: named(p.heap_preset_nodes(heap_points(s, d), COUNTERS, SHORT_LIVED)), POINTS + PRESETS),
    "f16_interval_vectors": (lambda s, d: p.interval_vectors(block_events(s, d), 1000, 9), """
SELECT 'r' AS run, thread, (c - n) // 1000 AS "interval", block, CAST(sum(n) AS BIGINT) AS weight
       FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY thread ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c
       FROM (SELECT event_id, CAST(user_id % 4 AS INTEGER) AS thread, event_type AS block, 1 + user_id % 7 AS n
       FROM events)) GROUP BY ALL"""),
    "f17_live_heap_timeline": (lambda s, d: p.live_heap_timeline(timeline_input(s, d)), INGEST + """
, ev AS (SELECT seq, alloc_size AS x, 1 AS k FROM allocs UNION ALL SELECT end_seq, -alloc_size, -1
       FROM allocs WHERE end_seq IS NOT NULL) SELECT 'r0' AS run_id, CAST(seq AS BIGINT) AS seq, CAST(sum(x) OVER (ORDER BY seq) AS BIGINT)
       AS live_bytes, CAST(sum(k) OVER (ORDER BY seq) AS BIGINT) AS live_blocks FROM ev"""),
    "f17_peak_composition": (lambda s, d: p.peak_composition(timeline_input(s, d), 5), INGEST + """,
ev AS (SELECT seq, alloc_size AS x FROM allocs UNION ALL SELECT end_seq, -alloc_size FROM allocs WHERE end_seq IS NOT NULL),
live AS (SELECT DISTINCT seq, sum(x) OVER (ORDER BY seq) AS bytes FROM ev),
peak AS (SELECT seq FROM live ORDER BY bytes DESC, seq LIMIT 1)
SELECT 'r0' AS run_id, 'site' || alloc_addr AS site, CAST(sum(alloc_size) AS BIGINT) AS bytes, count(*) AS blocks
FROM allocs, peak WHERE allocs.seq <= peak.seq AND (end_seq IS NULL OR end_seq > peak.seq) GROUP BY 2 ORDER BY bytes DESC, site LIMIT 5"""),
    "a03_pair_lifetimes": (lambda s, d: allocations(s, d).select("seq", "end_seq", "alloc_addr", "alloc_size", "generation"),
        INGEST + "SELECT seq, end_seq, alloc_addr, alloc_size, generation FROM allocs"),
    "a05_attribute_stores": (lambda s, d: attributed(s, d).select("seq", "addr", "alloc_addr", "generation", "offset"),
        INGEST + 'SELECT seq, addr, alloc_addr, generation, addr - alloc_addr AS "offset" FROM met'),
    "a06_unattributed_stores": (lambda s, d: traces.unattributed_stores(stores(s, d), attributed(s, d)).select("seq", "addr"), INGEST + "SELECT seq, addr FROM stores ANTI JOIN met USING (seq)"),
    "a07_classify_alignment": (lambda s, d: traces.classify_alignment(attributed(s, d)).groupBy("alloc_type").agg(F.count("*").alias("stores")), INGEST + """
SELECT CASE WHEN by8 THEN '64bits' WHEN by4 THEN '32bits' ELSE 'object' END AS alloc_type, CAST(sum(n) AS BIGINT) AS stores
       FROM (SELECT bool_and((addr - alloc_addr) % 8 = 0) AS by8, bool_and((addr - alloc_addr) % 4 = 0) AS by4, count(*) AS n
       FROM met GROUP BY alloc_addr, generation) GROUP BY 1"""),
    "a08_drop_unwritten": (lambda s, d: traces.drop_unwritten(allocations(s, d), attributed(s, d)).select("seq", "alloc_addr",
        "generation"), INGEST + "SELECT seq, alloc_addr, generation FROM allocs SEMI JOIN met USING (alloc_addr, generation)"),
    "h01_stream_attribute": (lambda s, d: streaming.run_available(streaming.stream_attribute(event_stream(s, d)), "append").select("seq", "addr", "alloc_addr", "generation", "offset", "status"), INGEST + """
SELECT seq, addr, alloc_addr, generation, addr - alloc_addr AS "offset", CASE WHEN alloc_addr IS NULL THEN 'unattributed' ELSE 'ok' END AS status
FROM stores LEFT JOIN met USING (seq, addr)"""),
    "h02_stream_silent": (lambda s, d: streaming.run_available(streaming.stream_silent(stream(s, d, "ev")), "append").groupBy("bench", "alloc_type").agg(F.sum("stores_with_prev").alias("stores_with_prev"), F.sum("silent").alias("silent")), f"""
WITH t AS ({fixtures.DUCK['ev']}) SELECT bench, alloc_type, count(prev) AS stores_with_prev, count(*) FILTER (prev = value) AS silent
       FROM (SELECT *, lag(value) OVER (PARTITION BY bench, alloc_addr, generation, "offset" ORDER BY rn, value) AS prev
       FROM t) GROUP BY ALL"""),
    "h03_stream_summary": (lambda s, d: streaming.run_available(streaming.stream_summary(stream(s, d, "li")), "complete").drop("allocations"), f"""
WITH t AS ({fixtures.DUCK['li']}),
parts AS (
    SELECT *, CASE alloc_type WHEN '64bits' THEN (value >> 52) & 2047 WHEN '32bits' THEN (value >> 23) & 255 END AS e,
           CASE alloc_type WHEN '64bits' THEN 2047 WHEN '32bits' THEN 255 END AS special, CASE alloc_type WHEN '64bits' THEN 1023 WHEN '32bits' THEN 127 END AS bias
    FROM t)
SELECT bench, count(*) AS stores, count(*) FILTER (alloc_type = '64bits') AS stores_64, count(*) FILTER (alloc_type = '32bits') AS stores_32, count(*) FILTER (alloc_type = 'object') AS stores_object,
       count(*) FILTER (value = 0) AS zero, count(*) FILTER (value <> 0 AND (value >> 56) & 255 = 0) AS nonzero_top_byte_zero, count(*) FILTER ((value >> 56) & 255 <> 0) AS nonzero_top_byte_nonzero,
       count(*) FILTER ("offset" % 8 = 0) AS aligned_8b, count(*) FILTER ("offset" % 8 = 4) AS aligned_4b_only, count(*) FILTER ("offset" % 4 <> 0) AS unaligned,
       count(*) FILTER (e > 0 AND e < special) AS normal, count(*) FILTER (e = 0 AND value <> 0) AS denormal, count(*) FILTER (e = special) AS inf_nan,
       CAST(min(e - bias) FILTER (e > 0 AND e < special) AS BIGINT) AS min_exp, CAST(max(e - bias) FILTER (e > 0 AND e < special) AS BIGINT) AS max_exp
FROM parts GROUP BY bench"""),
}

QUERIES = {name: q for name, (q, _) in DEFS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in DEFS.items()}
