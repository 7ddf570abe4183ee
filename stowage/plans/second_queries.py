"""Second-stage operators and the block re-encoder, registered over results of the analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.operators import second_stage as d
from stowage.operators.mx import mantissa_sweep, mx_round, mx_summary
from stowage.plans.fixtures import f64_bits, trace
from stowage.plans.trace_queries import ANALYSES, ctes


def over(name: str, run, sql: str, *more: str):
    """An operator on the result of analysis `name` (and others); in the SQL these are base, base2, ..."""
    names = (name, *more)
    view = ANALYSES[name][1]
    bases = ", ".join(f"base{i or ''} AS ({ANALYSES[n][2]})" for i, n in ((0 if k == 0 else k + 1, n) for k, n in enumerate(names)))
    return (lambda spark, sf_dir: run(*(ANALYSES[n][0](trace(spark, sf_dir, view)) for n in names))), f"{ctes(view)}, {bases} {sql}"


GRID = "unnest(list_transform(range(1, 20), lambda i: i / 20.0))"
NEAR = """
SELECT bench, round(sum(CASE WHEN abs(v - a) <= 0.05 THEN w ELSE 0 END) / sum(w), 9) AS near_share
       FROM (SELECT *, round(sum(v * w) OVER p / sum(w) OVER p, 9) AS a FROM (SELECT bench, silent_frac AS v, pairs AS w
       FROM base) WINDOW p AS (PARTITION BY bench)) GROUP BY bench"""
DEFS = {
    "d01_cumulative_share": over("c02_top_allocations", d.cumulative_share, """
SELECT bench, CAST(row_number() OVER w AS INTEGER) AS rank, CAST(sum(base.stores) OVER (PARTITION BY bench
       ORDER BY base.stores DESC, alloc_addr, generation ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_stores, round(sum(base.stores) OVER (PARTITION
       BY bench ORDER BY base.stores DESC, alloc_addr, generation ROWS UNBOUNDED PRECEDING) / base2.stores, 9) AS cum_frac
       FROM base JOIN base2 USING (bench) WINDOW w AS (PARTITION BY bench ORDER BY base.stores DESC, alloc_addr, generation)""", "c01_summary"),
    "d02_size_ccdf": over("c03_size_distribution", d.size_ccdf, """
SELECT bench, size_bucket_bytes, (SELECT CAST(sum(allocations) AS BIGINT) FROM base b WHERE b.bench = base.bench AND b.size_bucket_bytes
       >= base.size_bucket_bytes) AS at_least FROM base"""),
    "d03_write_regime": over("c08_coverage", d.write_regime, """
SELECT bench, alloc_type, CASE WHEN avg_coverage >= 0.5 THEN 'dense' ELSE 'sparse' END || CASE WHEN avg_writes_per_slot >= 10 THEN '-hot'
       ELSE '-cold' END AS regime FROM base"""),
    "d04_weighted_bench_aggregate": over("c35_buffer_silent", lambda x: d.weighted_bench_aggregate(x, "silent_frac", "pairs"), """
SELECT bench, round(sum(silent_frac * pairs) / sum(pairs), 9) AS aggregate, CAST(sum(pairs) AS BIGINT) AS weight
       FROM base GROUP BY bench"""),
    "d05_top_buffers_above_floor": over("c35_buffer_silent", lambda x: d.top_buffers_above_floor(x, "pairs", 100, 25), """
SELECT * EXCLUDE (r, m) FROM (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY pairs DESC, alloc_addr, generation, run_id) AS
       r, max(pairs) OVER (PARTITION BY bench) AS m FROM base) WHERE (pairs >= 100 OR m < 100) AND r <= 25"""),
    "d06_coverage_of_selection": over("c35_buffer_silent", lambda x: d.coverage_of_selection(x.where("pairs >= 100"), x, "pairs"), """
SELECT bench, count(*) FILTER (pairs >= 100) AS selected, count(*) AS buffers, round(coalesce(sum(pairs) FILTER (pairs >= 100), 0) /
       sum(pairs), 9) AS weight_share FROM base GROUP BY bench"""),
    "d07_buffer_required_bits": over("c37_buffer_exp_range", d.buffer_required_bits, """
SELECT run_id, bench, alloc_addr, generation, CASE WHEN min_e IS NULL THEN 0 ELSE CAST(ceil(log2(greatest(max_e - min_e + 1, 1))) AS
       BIGINT) END AS required_bits FROM base"""),
    "d08_share_near_aggregate": over("c35_buffer_silent", lambda x: d.share_near_aggregate(x, "silent_frac", "pairs"), NEAR),
    "d09_convertible_buffers": over("c36_buffer_feasibility_events", lambda x, y: d.convertible_buffers(x, y, "pct_fp16", -14, 15), """
SELECT bench, base.alloc_type, CASE WHEN n_zero = base2.total THEN 'all_zero' WHEN n_special = 0 AND min_e >= -14 AND max_e <= 15 THEN
       'convertible' ELSE 'range' END AS verdict, count(*) AS buffers, CAST(sum(base2.total) AS BIGINT) AS stores
       FROM base JOIN base2 USING (run_id, bench, alloc_addr, generation) WHERE pct_fp16 = 1 GROUP BY ALL""", "c37_buffer_exp_range_events"),
    "d10_top_n_per_group": over("c13_site_feasibility", lambda x: d.top_n_per_group(x, 1, "bench", F.desc("total"), "alloc_type", "site").select("bench", "alloc_type", "site", "total"), """
SELECT bench, alloc_type, site, total FROM base QUALIFY row_number() OVER (PARTITION BY bench
       ORDER BY total DESC, alloc_type, site) <= 1"""),
    "d11_gini_quality_flag": over("c17_intra_buffer_gini", d.gini_quality_flag, """
SELECT bench, alloc_type, min_gini < 0 OR max_gini > 1 AS out_of_range, greatest(0.0, least(1.0, mean_gini)) AS clipped_mean
       FROM base"""),
    "d12_buffer_dense_rank": over("c18_hot_offsets", d.buffer_dense_rank, 'SELECT bench, alloc_addr, generation, "offset", CAST(dense_rank() OVER (PARTITION BY bench ORDER BY alloc_addr, generation) AS INTEGER) AS buffer_rank FROM base'),
    "d13_sweep_is_flat": over("c28_mx_scale_sharing", d.sweep_is_flat, "SELECT bench, alloc_type, min(overall_scale_share) = max(overall_scale_share) AS is_flat FROM base GROUP BY ALL"),
    "d14_silent_impact_rank": over("c21_site_silent", d.silent_impact_rank, "SELECT bench, site, round(stores * silent_frac, 9) AS impact FROM base ORDER BY impact DESC, bench, site LIMIT 12"),
    "d15_exp_bits_histogram": over("c24_site_required_exp_bits_mix", d.exp_bits_histogram, """
SELECT alloc_type, required_e_bits, CAST(sum(total) AS BIGINT) AS stores, round(sum(sum(total)) OVER (PARTITION BY alloc_type ORDER BY required_e_bits) / sum(sum(total)) OVER (PARTITION BY alloc_type), 9) AS cum_share
FROM base GROUP BY alloc_type, required_e_bits"""),
    "d15_exp_bits_shares": over("c24_site_required_exp_bits_mix", d.exp_bits_shares, "SELECT alloc_type, CAST(sum(total) AS BIGINT) AS stores, " + ", ".join(f"round(coalesce(sum(total) FILTER (required_e_bits <= {w}), 0) / sum(total), 9) AS le_{w}_bits" for w in (4,
        5, 8, 11)) + " FROM base GROUP BY alloc_type"),
    "d16_residual_class_share": over("c34_exponent_classes", d.residual_class_share, """
SELECT bench, alloc_type, round(greatest(0.0, least(1.0, 1 - (coalesce(frac_zero, 0) + coalesce(normal, 0) + coalesce(subnormal, 0) + coalesce(inf_nan, 0)))), 8) AS other
FROM (SELECT bench, alloc_type, frac_zero, frac_normal_f64 AS normal, frac_subnormal_f64 AS subnormal, frac_inf_nan_f64 AS inf_nan FROM base WHERE alloc_type = '64bits'
      UNION ALL SELECT bench, alloc_type, frac_zero, frac_normal_f32, frac_subnormal_f32, frac_inf_nan_f32 FROM base WHERE alloc_type = '32bits')"""),
    "d17_scaling_granularity": over("c27_exponent_stability", d.scaling_granularity, """
SELECT bench, alloc_type, site, CASE WHEN frac_constant_exp >= 0.8 THEN 'per-channel' WHEN frac_constant_exp <= 0.2 THEN 'per-token'
       ELSE 'mixed' END AS granularity FROM base"""),
    "d18_outlier_scaling_class": over("c26_outlier_channels", d.outlier_scaling_class, """
SELECT bench, alloc_type, site, CASE WHEN channel_frac <= 0.05 THEN 'per-channel' WHEN channel_frac >= 0.5 THEN 'per-tensor' ELSE 'mixed'
       END AS scaling FROM base"""),
    "d19_dominant_site_share": over("c16_site_profile", d.dominant_site_share, """
SELECT bench, site, share, CAST(row_number() OVER (ORDER BY share DESC, bench) AS INTEGER) AS rank
       FROM (SELECT bench, site, pct_of_bench AS share FROM base QUALIFY row_number() OVER (PARTITION BY bench
       ORDER BY stores DESC, site) = 1)"""),
    "d20_single_slot_share": over("c31_cacheline_homogeneity", lambda x: d.single_slot_share(x, False), "SELECT bench, alloc_type, round(trivial_lines / (lines + trivial_lines), 9) AS single_slot_share FROM base"),
    "d21_class_fractions": over("c06_alignment", lambda x: d.class_fractions(x, "aligned_8b", "aligned_4b_only", "unaligned"), """
SELECT bench, alloc_type, round(aligned_8b / greatest(total, 1), 9) AS aligned_8b, round(aligned_4b_only / greatest(total, 1), 9) AS
       aligned_4b_only, round(unaligned / greatest(total, 1), 9) AS unaligned, CAST(row_number() OVER (ORDER BY total DESC, bench, alloc_type)
       AS INTEGER) AS rank FROM base"""),
    "d22_delta_bands": over("c20_spatial_delta", d.delta_bands, """
SELECT bench, alloc_type, round(bit_identical / pairs, 9) AS identical, round((delta_le_8b - bit_identical) / pairs, 9) AS within_8b,
       round((delta_le_16b - delta_le_8b) / pairs, 9) AS within_16b, round((pairs - delta_le_16b) / pairs, 9) AS beyond
       FROM base"""),
    "c38_silent_energy_sweep": over("c35_buffer_silent", lambda x: d.silent_energy_sweep(x, least=20), f"""
SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(ratio AS INTEGER) AS ratio, coalesce(round((sum(silent) FILTER (gate) * ratio - sum(stores) FILTER (gate)) / (max(total) * ratio), 9), 0) AS net_saving
FROM (SELECT *, pairs >= 20 AND silent_frac >= threshold AS gate FROM (SELECT *, sum(stores) OVER () AS total, {GRID} AS threshold FROM base)) CROSS JOIN (SELECT unnest([2, 5, 10]) AS ratio)
GROUP BY threshold, ratio"""),
    "c38_best_thresholds": over("c35_buffer_silent", lambda x: d.best_thresholds(x, least=20), f"""
SELECT bench, CAST(threshold AS DOUBLE) AS threshold, greatest(0.0, net) AS net_saving
FROM (SELECT bench, threshold, coalesce(round((sum(silent) FILTER (gate) * 5 - sum(stores) FILTER (gate)) / (sum(stores) * 5), 9), 0) AS net
      FROM (SELECT *, pairs >= 20 AND silent_frac >= threshold AS gate FROM (SELECT *, {GRID} AS threshold FROM base)) GROUP BY bench, threshold)
QUALIFY row_number() OVER (PARTITION BY bench ORDER BY net DESC, threshold) = 1"""),
}


def tensors(spark, sf_dir):
    """The embeddings' float bits as elements of tensors."""
    return trace(spark, sf_dir, "emb").select("bench", "alloc_addr", (F.col("offset") / 4).cast("int").alias("idx"), F.col("value").alias("bits"))


def mx_embeddings(spark, sf_dir):
    return mx_summary(mx_round(tensors(spark, sf_dir), ["bench", "alloc_addr"]), ["bench", "alloc_addr"], ["bench"])


def mx_mantissa_sweep(spark, sf_dir):
    return mantissa_sweep(tensors(spark, sf_dir), ["bench", "alloc_addr"], ["bench"])


def doubles(spark, sf_dir):
    """Prices and discounts as elements of 64-bit tensors, one for each flag and supplier."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    value = F.when(F.col("l_partkey") % 2 == 0, F.col("l_extendedprice")).otherwise(F.col("l_discount")).cast("double")
    idx = F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")
    return l.select(F.col("l_returnflag").alias("bench"), F.col("l_suppkey").cast("long").alias("alloc_addr"), idx.alias("idx"), f64_bits(value).alias("bits"))


def mx_mantissa_sweep_doubles(spark, sf_dir):
    return mantissa_sweep(doubles(spark, sf_dir), ["bench", "alloc_addr"], ["bench"], WIDTHS, esz=8)


#: The widths that a sweep of 64-bit stores goes through.
WIDTHS = (52, 23, 16, 10, 7, 3)


# The same rounding on doubles: exact there for float32 inputs, 8 exponent bits below the block's top and few mantissa bits.
_FLOATS = """SELECT 'label_' || label AS bench, vec_id, pos, CAST(x AS DOUBLE) AS v
            FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings)"""
_DOUBLES = """SELECT l_returnflag AS bench, l_suppkey AS vec_id, l_orderkey * 8 + l_linenumber AS pos,
            CAST(CASE WHEN l_partkey % 2 = 0 THEN l_extendedprice ELSE l_discount END AS DOUBLE) AS v FROM lineitem"""
# From 2**52 on, a double is whole already, and half more would be rounded itself.
_ROUNDED = "CASE WHEN abs(v) / pow(2, q) >= 4503599627370496 THEN abs(v) ELSE floor(abs(v) / pow(2, q) + 0.5) * pow(2, q) END"
MX_SQL = f"""
WITH el AS ({{el}}),
lead AS (SELECT *, CASE WHEN v <> 0 THEN floor(log2(abs(v))) END AS l FROM el),
fixed AS (SELECT * EXCLUDE (l), CASE WHEN abs(v) >= pow(2, l + 1) THEN l + 1 WHEN abs(v) < pow(2, l) THEN l - 1 ELSE l END AS l FROM lead),
shared AS (SELECT *, max(l) OVER (PARTITION BY bench, vec_id, pos // 32) - 8 AS s FROM fixed),
el2 AS (SELECT *, greatest(l, s - 6) - {{m}} AS q FROM shared),
out AS (SELECT *, CASE WHEN l IS NULL THEN 0 ELSE {_ROUNDED} END AS r, (pow(2, {{m}} + 1) - 1 - CASE WHEN {{m}} = 3 THEN 1 ELSE 0 END) * pow(2, s + 8 - {{m}}) AS most FROM el2)
SELECT bench, count(*) AS stores, count(*) FILTER (l IS NOT NULL AND least(r, most) <> abs(v)) AS values_changed, count(*) FILTER (l IS NOT NULL AND r = 0) AS values_flushed,
       count(*) FILTER (r > most) AS values_saturated, count(DISTINCT (vec_id, pos // 32)) AS blocks, CAST(0 AS BIGINT) AS blocks_nan, CAST(0 AS BIGINT) AS scales_clamped{{more}}
FROM out GROUP BY bench
"""

QUERIES = {name: q for name, (q, _) in DEFS.items()} | {"e09_mx_embeddings": mx_embeddings, "e11_mantissa_sweep": mx_mantissa_sweep, "e11_mantissa_sweep_doubles": mx_mantissa_sweep_doubles}
ORACLE_SQL = {name: sql for name, (_, sql) in DEFS.items()} | {
    "e09_mx_embeddings": MX_SQL.format(m=3, more="", el=_FLOATS),
    "e11_mantissa_sweep": " UNION ALL ".join(f"SELECT * FROM ({MX_SQL.format(m=m, more=f', {m} AS mbits', el=_FLOATS)})" for m in (23, 16, 10, 7, 3)),
    "e11_mantissa_sweep_doubles": " UNION ALL ".join(f"SELECT * FROM ({MX_SQL.format(m=m, more=f', {m} AS mbits', el=_DOUBLES)})" for m in WIDTHS),
}
