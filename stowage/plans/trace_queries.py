"""The analyses registered over derived traces, each with the SQL that checks it."""

from __future__ import annotations

from stowage.functions.sites import ALLOCATORS
from stowage.operators import cells
from stowage.operators import ordered as o
from stowage.operators import stores as s
from stowage.plans.fixtures import DUCK, RN_BITS, trace

E = "CASE alloc_type WHEN '64bits' THEN (value >> 52) & 2047 WHEN '32bits' THEN (value >> 23) & 255 END"
M = "CASE alloc_type WHEN '64bits' THEN value & 4503599627370495 WHEN '32bits' THEN value & 8388607 END"
BIAS, SPECIAL, WIDTH = (f"CASE alloc_type WHEN '64bits' THEN {a} WHEN '32bits' THEN {b} END" for a, b in ((1023, 127), (2047, 255), (52, 23)))
SITE = "(SELECT site FROM sites WHERE stack = alloc_stack)"
BUF = "run_id, bench, alloc_addr, generation"


def ctes(view: str) -> str:
    return f"""WITH t AS ({DUCK[view]}),
f AS (SELECT *, {E} AS e, {M} AS m, {BIAS} AS bias, {SPECIAL} AS special, {WIDTH} AS width FROM t WHERE alloc_type IN ('64bits', '32bits')),
fp AS (SELECT *, CASE WHEN e > 0 AND e < special THEN e - bias END AS x, CASE WHEN m = 0 THEN width ELSE bit_count(xor(m, m - 1)) - 1 END AS tz FROM f),
snap AS (SELECT {BUF}, "offset", arg_max(value, rn) AS value, min(alloc_type) AS alloc_type FROM fp GROUP BY ALL),
snapx AS (SELECT *, CASE WHEN e > 0 AND e < special THEN e - bias END AS x FROM (SELECT *, {E} AS e, {BIAS} AS bias, {SPECIAL} AS special FROM snap)),
idx AS (SELECT *, row_number() OVER (PARTITION BY {BUF} ORDER BY "offset") - 1 AS i FROM snapx),
prev AS (SELECT *, lag(value) OVER (PARTITION BY {BUF}, "offset" ORDER BY rn, value) AS prev FROM t),
bufsite AS (SELECT {BUF}, min(alloc_stack) AS alloc_stack FROM t GROUP BY ALL),
frames AS (SELECT stack, generate_subscripts(f, 1) AS place, unnest(f) AS frame FROM (SELECT stack, string_split(stack, chr(10)) AS f FROM (SELECT DISTINCT alloc_stack AS stack FROM t))),
choice AS (SELECT *, CASE WHEN NOT regexp_matches(lower(frame), '{ALLOCATORS}') THEN 0 WHEN place = 2 THEN 1 ELSE 2 END AS worse FROM frames),
sites AS (SELECT stack, regexp_extract(arg_min(frame, (worse, place)), ': (.*?) \\(', 1) AS site FROM choice GROUP BY stack)
"""


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def pct(cond: str, of: str = "count(*)") -> str:
    return f"round(count(*) FILTER ({cond}) / {of}, 9)"


def hamming(a: str, b: str) -> str:
    return f"bit_count(xor({a}, {b}) & CASE alloc_type WHEN '32bits' THEN 4294967295 ELSE -1 END)"


DELTA = "CASE WHEN value = prev THEN 0 ELSE length(bin(abs(value - prev))) END"
SIGNED = "CASE alloc_type WHEN '64bits' THEN value WHEN '32bits' THEN value - CASE WHEN value >= 2147483648 THEN 4294967296 ELSE 0 END END"
FPC = {"zero": "value = 0", **{f"sign{k}": f"({SIGNED} BETWEEN {-(1 << k - 1)} AND {(1 << k - 1) - 1}" + (" AND alloc_type = '64bits')" if k == 32 else ")") for k in (4,
    8, 16, 32)}, "high_zero_low16": "(value >> 16) = 0",
       "repeating_byte": "hex(value) = '0' OR CASE alloc_type WHEN '64bits' THEN printf('%016x', value) = repeat(printf('%02x', value & 255), 8) ELSE printf('%08x', value) = repeat(printf('%02x', value & 255), 4) END"}


def topk(inner: str, k: int, by: str | None, order: str, columns: str) -> str:
    if by is None:
        return f"SELECT {columns} FROM ({inner}) ORDER BY {order} LIMIT {k}"
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS pick FROM ({inner})) WHERE pick <= {k}"


def blocks(size: int) -> str:
    return f"SELECT {BUF}, i // {size} AS block, min(alloc_type) AS alloc_type, count(x) AS valid, min(x) AS lo, max(x) AS hi FROM idx GROUP BY ALL"


def sweep(size: int) -> str:
    return f"""
SELECT bench, alloc_type, {size} AS block_size, count(*) AS blocks, round(count(*) FILTER (valid < 2 OR hi - lo <= 4) / count(*), 9) AS viable_spread4,
       round(count(*) FILTER (valid < 2 OR hi - lo <= 8) / count(*), 9) AS viable_spread8, round(avg(hi - lo) FILTER (valid >= 2), 9) AS mean_spread
FROM ({blocks(size)}) GROUP BY bench, alloc_type"""


def sharing(size: int) -> str:
    return f"""
SELECT bench, alloc_type, {size} AS block_size, {big('sum(k)')} AS blocks, {big('sum(d)')} AS distinct_scales_total, round(sum(d) / sum(k), 9) AS overall_scale_share,
       round(avg(d / k), 9) AS mean_buffer_share, round(quantile_cont(d / k, 0.5), 9) AS median_buffer_share
FROM (SELECT {BUF}, min(alloc_type) AS alloc_type, count(*) AS k, count(DISTINCT hi) AS d FROM ({blocks(size)}) WHERE hi IS NOT NULL GROUP BY {BUF}) GROUP BY bench, alloc_type"""


CONC = ", ".join(f"{big(f'min(r) FILTER (100 * c >= {p} * total)')} AS top_for_{p}pct" for p in (50, 80, 90, 95, 99))
SILENT_BUF = f"SELECT {BUF}, min(alloc_type) AS alloc_type, min(alloc_size) AS alloc_size, count(*) AS stores, count(prev) AS pairs, count(*) FILTER (prev = value) AS silent FROM prev GROUP BY {BUF}"
FEASIBLE = """count(*) AS total,
       round(count(*) FILTER (tz >= CASE alloc_type WHEN '64bits' THEN 49 ELSE 20 END) / count(*), 9) AS pct_fp8_e4m3,
       round(count(*) FILTER (tz >= CASE alloc_type WHEN '64bits' THEN 50 ELSE 21 END) / count(*), 9) AS pct_fp8_e5m2,
       round(count(*) FILTER (tz >= CASE alloc_type WHEN '64bits' THEN 45 ELSE 16 END) / count(*), 9) AS pct_bf16,
       round(count(*) FILTER (tz >= CASE alloc_type WHEN '64bits' THEN 42 ELSE 13 END) / count(*), 9) AS pct_fp16"""
FEAS_BUF = f"""
SELECT run_id, bench, alloc_addr, generation, min(alloc_type) AS alloc_type, min(alloc_size) AS alloc_size, {FEASIBLE},
       CASE alloc_type WHEN '64bits' THEN round(count(*) FILTER (tz >= 29) / count(*), 9) ELSE 1.0 END AS pct_fp32
FROM fp GROUP BY run_id, bench, alloc_addr, generation, alloc_type"""
RANGE_BUF = f"""
SELECT {BUF}, min(alloc_type) AS alloc_type, min(alloc_size) AS alloc_size, count(*) AS total, count(*) FILTER (value = 0) AS n_zero,
       count(*) FILTER (value <> 0 AND (e = 0 OR e = special)) AS n_special, min(x) AS min_e, max(x) AS max_e
FROM fp GROUP BY {BUF}"""

SILENT = """
SELECT bench, alloc_type, count(prev) AS stores_with_prev, count(*) FILTER (prev = value) AS silent, round(count(*) FILTER (prev = value) / nullif(count(prev), 0), 9) AS silent_frac
FROM prev GROUP BY ALL"""
BUFFER_SILENT = f"SELECT *, round(silent / pairs, 9) AS silent_frac FROM ({SILENT_BUF}) WHERE pairs > 0"
SITE_SILENT = f"""
SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY pairs DESC, site) AS pick FROM (
SELECT bench, site, {big('sum(stores)')} AS stores, {big('sum(pairs)')} AS pairs, {big('sum(silent)')} AS silent, round(sum(silent) / sum(pairs), 9) AS silent_frac
FROM (SELECT *, {SITE} AS site FROM ({SILENT_BUF}) JOIN bufsite USING ({BUF})) WHERE site <> '' GROUP BY bench, site HAVING sum(pairs) >= 10)) WHERE pick <= 20"""
EXP_BITS = f"""
SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY total DESC, alloc_type, site) AS pick FROM (
SELECT bench, alloc_type, site, min(lo) AS min_e, max(hi) AS max_e, max(hi) - min(lo) + 1 AS exp_range, {big('ceil(log2(greatest(max(hi) - min(lo) + 1, 2)))')} AS required_e_bits, {big('sum(n)')} AS total
FROM (SELECT *, {SITE} AS site FROM (SELECT bench, alloc_type, alloc_stack, min(x) AS lo, max(x) AS hi, count(*) AS n FROM fp WHERE value <> 0 GROUP BY ALL))
WHERE site <> '' AND lo IS NOT NULL GROUP BY bench, alloc_type, site HAVING sum(n) >= 1000)) WHERE pick <= 20"""
CELLS = f"""
SELECT {BUF}, "offset", min(alloc_type) AS alloc_type, min(alloc_size) AS alloc_size, count(*) AS writes, count(prev) AS pairs, count(*) FILTER (prev = value) AS silent,
       arg_max(value, (rn, value)) AS last, max(rn) AS last_rn, count(x) AS normal, min(x) AS min_exp, max(x) AS max_exp
FROM (SELECT *, CASE WHEN e > 0 AND e < special THEN e - bias END AS x FROM (SELECT *, {E} AS e, {BIAS} AS bias, {SPECIAL} AS special FROM prev)) GROUP BY {BUF}, "offset"
"""


def ranged(operator):
    """The operator with ranges that fit the views' numbers."""
    return lambda t: operator(t, bits=RN_BITS)


#: name -> (operator on a trace, view, SQL after the common table expressions)
ANALYSES = {
    "c01_summary": (s.summary, "li", f"""
SELECT bench, count(*) AS stores, count(DISTINCT (run_id, alloc_addr, generation)) AS allocations, count(*) FILTER (alloc_type = '64bits')
       AS stores_64, count(*) FILTER (alloc_type = '32bits') AS stores_32, count(*) FILTER (alloc_type = 'object') AS stores_object, {pct('value = 0')}
       AS frac_zero_value FROM t GROUP BY bench"""),
    "c02_top_allocations": (s.top_allocations, "li", topk(f"""
SELECT {BUF}, min(alloc_size) AS alloc_size, min(alloc_type) AS alloc_type, count(*) AS stores, count(DISTINCT "offset") AS unique_offsets,
       round(count(*) / min(alloc_size), 9) AS stores_per_byte FROM t GROUP BY {BUF}""", 20, "bench", "stores DESC, alloc_addr, generation, run_id", "bench, alloc_addr, alloc_size, alloc_type, generation, stores, unique_offsets, stores_per_byte")),
    "c03_size_distribution": (s.size_distribution, "li", f"""
SELECT bench, CAST(2 ** (length(bin(size)) - 1) AS BIGINT) AS size_bucket_bytes, count(*) AS allocations
       FROM (SELECT {BUF}, min(alloc_size) AS size FROM t GROUP BY {BUF}) GROUP BY ALL"""),
    "c04_hot_stack_sites": (s.hot_stack_sites, "li", topk(f"""
SELECT bench, array_to_string(string_split(alloc_stack, chr(10))[1:3], chr(10)) AS site3, {big('sum(n)')} AS stores, count(*) AS allocs,
       {big('sum(n * size)')} AS total_bytes, {big('sum(size)')} AS distinct_bytes FROM (SELECT {BUF}, alloc_stack, count(*) AS n, min(alloc_size)
       AS size FROM t GROUP BY ALL) GROUP BY 1, 2""", 15, None, "stores DESC, bench, site3", "*")),
    "c05_value_patterns": (s.value_patterns, "li", """
SELECT bench, alloc_type, count(*) FILTER (value = 0) AS zero,
       count(*) FILTER (value <> 0 AND (value >> 56) & 255 = 0) AS nonzero_top_byte_zero, count(*) FILTER (value <> 0 AND (value >> 56) & 255 <> 0) AS nonzero_top_byte_nonzero,
       count(*) FILTER (((value >> 52) & 2047) BETWEEN 1 AND 2046) AS exp_field_normal_f64, count(*) AS total
FROM t GROUP BY bench, alloc_type"""),
    "c06_alignment": (s.alignment, "li", """
SELECT bench, alloc_type, count(*) FILTER ("offset" % 8 = 0) AS aligned_8b, count(*) FILTER ("offset" % 8 = 4) AS aligned_4b_only,
       count(*) FILTER ("offset" % 4 <> 0) AS unaligned, count(*) AS total
FROM t GROUP BY bench, alloc_type"""),
    "c07_reused_allocations": (s.reused_allocations, "li", """
SELECT bench, alloc_addr, max(generation) AS max_generation, count(*) AS stores, round(sum(alloc_size) / max(generation), 9) AS avg_size,
       round((SELECT avg(size) FROM (SELECT DISTINCT b.run_id, b.generation, b.alloc_size AS size FROM t b WHERE b.run_id = t.run_id AND b.bench = t.bench AND b.alloc_addr = t.alloc_addr)), 9) AS avg_size_distinct
FROM t GROUP BY run_id, bench, alloc_addr HAVING max(generation) > 1 ORDER BY max_generation DESC, stores DESC, bench, alloc_addr, run_id LIMIT 20"""),
    "c08_coverage": (s.coverage, "li", f"""
SELECT bench, alloc_type, count(*) AS allocations, round(avg(c), 9) AS avg_coverage, round(min(c), 9) AS min_coverage, round(max(c),
       9) AS max_coverage, round(avg(w), 9) AS avg_writes_per_slot FROM (SELECT bench, min(alloc_type) AS alloc_type, count(DISTINCT "offset")
       * min(CASE width WHEN 52 THEN 8 ELSE 4 END) / min(alloc_size) AS c, count(*) / count(DISTINCT "offset") AS w
       FROM fp GROUP BY {BUF}) GROUP BY ALL"""),
    "c09_silent_stores": (ranged(o.silent_stores), "ev", SILENT),
    "c09_silent_stores_mixed": (ranged(o.silent_stores), "li", SILENT),
    "c09_silent_stores_hot": (ranged(o.silent_stores), "hot", SILENT),
    "c10_bit_patterns": (ranged(o.bit_patterns), "li", f"""
SELECT bench, alloc_type, count(*) AS total, count(*) FILTER (value = 0) AS zero_values, count(*) FILTER (e = 0) AS exp_zero, count(*)
       FILTER (m = 0) AS mantissa_zero, count(prev) AS pairs, count(*) FILTER (prev = value) AS bit_identical, round(sum({hamming('value', 'prev')})
       / count(prev), 9) AS mean_hamming FROM (SELECT *, lag(value) OVER (PARTITION BY {BUF} ORDER BY rn, value) AS prev
       FROM fp) GROUP BY ALL"""),
    "c11_write_concentration": (o.write_concentration, "li", f"""
SELECT bench, CAST(max(total) AS BIGINT) AS total_stores, count(*) AS total_buffers, {CONC}
       FROM (SELECT bench, row_number() OVER w AS r, sum(n) OVER (PARTITION BY bench ORDER BY n DESC, alloc_addr, generation ROWS UNBOUNDED
       PRECEDING) AS c, sum(n) OVER (PARTITION BY bench) AS total FROM (SELECT {BUF}, count(*) AS n
       FROM t GROUP BY {BUF}) WINDOW w AS (PARTITION BY bench ORDER BY n DESC, alloc_addr, generation))
       GROUP BY bench"""),
    "c12_format_feasibility": (s.format_feasibility, "li", f"""
SELECT bench, alloc_type, {FEASIBLE},
       CASE alloc_type WHEN '64bits' THEN round(count(*) FILTER (tz >= 29) / count(*), 9) ELSE 1.0 END AS pct_fp32
FROM fp GROUP BY bench, alloc_type"""),
    "c13_site_feasibility": (s.site_feasibility, "li", f"""
SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY total DESC, alloc_type, site) AS pick FROM (
SELECT bench, alloc_type, site, {FEASIBLE},
       CASE alloc_type WHEN '64bits' THEN round(count(*) FILTER (tz >= 29) / count(*), 9) END AS pct_fp32
FROM (SELECT *, {SITE} AS site FROM fp) WHERE site <> '' GROUP BY bench, alloc_type, site HAVING count(*) >= 1000)) WHERE pick <= 20"""),
    "c14_mx_feasibility": (o.mx_feasibility, "li", f"""
SELECT bench, alloc_type, count(*) AS blocks, count(*) FILTER (valid < 2 OR hi - lo <= 8) AS viable_blocks, round(count(*) FILTER (valid < 2 OR hi - lo <= 8) / count(*), 9) AS viable_frac,
       round(avg(hi - lo) FILTER (valid >= 2), 9) AS mean_spread, CAST(quantile_cont(hi - lo, 0.5) FILTER (valid >= 2) AS DOUBLE) AS median_spread, max(hi - lo) AS max_spread
FROM ({blocks(32)}) GROUP BY bench, alloc_type"""),
    "c14_mx_feasibility_dense": ((lambda t: o.mx_feasibility(t, 32, 6)), "emb", f"""
SELECT bench, alloc_type, count(*) AS blocks, count(*) FILTER (valid < 2 OR hi - lo <= 6) AS viable_blocks, round(count(*) FILTER (valid < 2 OR hi - lo <= 6) / count(*), 9) AS viable_frac,
       round(avg(hi - lo) FILTER (valid >= 2), 9) AS mean_spread, CAST(quantile_cont(hi - lo, 0.5) FILTER (valid >= 2) AS DOUBLE) AS median_spread, max(hi - lo) AS max_spread
FROM ({blocks(32)}) GROUP BY bench, alloc_type"""),
    "c15_exponent_range": (s.exponent_range, "li", f"""
SELECT bench, alloc_type, count(*) AS total, {pct('value = 0')} AS frac_zero, {pct('value <> 0 AND e = 0')} AS frac_denormal, {pct('e = special')} AS frac_inf_nan,
       min(x) AS min_exp, max(x) AS max_exp, round(avg(x), 9) AS mean_exp, {pct('e - bias BETWEEN -9 AND 8')} AS frac_in_e4m3_range, {pct('e - bias BETWEEN -16 AND 15')} AS frac_in_e5m2_range
FROM fp GROUP BY bench, alloc_type"""),
    "c16_site_profile": (s.site_profile, "li", f"""
SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY stores DESC, site) AS pick FROM (
SELECT bench, site, {big('sum(n)')} AS stores, round(100.0 * sum(n) / sum(sum(n)) OVER (PARTITION BY bench), 9) AS pct_of_bench, {big('sum(k)')} AS buffers,
       round(sum(n * mean_size) / sum(n), 9) AS mean_alloc_size, round(sum(n * coalesce(mean_tz, 0)) / sum(n), 9) AS mean_trailing_z
FROM (SELECT *, {SITE} AS site FROM (
    SELECT bench, alloc_stack, count(*) AS n, count(DISTINCT (run_id, alloc_addr, generation)) AS k, avg(alloc_size) AS mean_size, avg(tz) AS mean_tz
    FROM (SELECT *, CASE WHEN m = 0 THEN {WIDTH} ELSE bit_count(xor(m, m - 1)) - 1 END AS tz FROM (SELECT *, {M} AS m FROM t)) GROUP BY bench, alloc_stack))
WHERE site <> '' GROUP BY bench, site)) WHERE pick <= 15"""),
    "c17_intra_buffer_gini": (o.intra_buffer_gini, "li", f"""
SELECT bench, alloc_type, count(*) AS buffers, round(avg(g), 9) AS mean_gini, round(quantile_cont(g, 0.5), 9) AS median_gini, round(min(g),
       9) AS min_gini, round(max(g), 9) AS max_gini, round(sum(g * total) / sum(total), 9) AS weighted_gini
       FROM (SELECT bench, min(alloc_type) AS alloc_type, sum(c) AS total, (2 * sum(r * c) - (count(*) + 1) * sum(c)) / (count(*) * sum(c))
       AS g FROM (SELECT {BUF}, alloc_type, c, row_number() OVER (PARTITION BY {BUF} ORDER BY c) AS r
       FROM (SELECT {BUF}, alloc_type, "offset", count(*) AS c FROM fp GROUP BY ALL)) GROUP BY {BUF}
       HAVING count(*) > 1) GROUP BY ALL"""),
    "c18_hot_offsets": (o.hot_offsets, "li", f"""
SELECT bench, alloc_addr, generation, alloc_type, alloc_size, "offset", writes, round(100.0 * writes / total, 9) AS pct_of_buffer, round(100.0 * writes / bench_total, 9) AS pct_of_bench
FROM (SELECT *, row_number() OVER (PARTITION BY {BUF} ORDER BY writes DESC, "offset") AS r, dense_rank() OVER (PARTITION BY bench ORDER BY total DESC, alloc_addr, generation, run_id) AS b
      FROM (SELECT *, sum(writes) OVER (PARTITION BY {BUF}) AS total, sum(writes) OVER (PARTITION BY bench) AS bench_total
            FROM (SELECT {BUF}, "offset", min(alloc_type) AS alloc_type, min(alloc_size) AS alloc_size, count(*) AS writes FROM t GROUP BY {BUF}, "offset")))
WHERE r <= 5 AND b <= 10"""),
    "c19_mx_block_sweep": (o.mx_block_sweep, "emb", " UNION ALL ".join(map(sweep, (8, 16, 32, 64, 128)))),
    "c20_spatial_delta": (o.spatial_delta, "li", f"""
SELECT bench, alloc_type, count(*) AS pairs, count(*) FILTER (value = prev) AS bit_identical, count(*) FILTER (h <= 8) AS delta_le_8b, count(*) FILTER (h <= 16) AS delta_le_16b,
       round(avg(h), 9) AS mean_hamming, round(avg({DELTA}), 9) AS mean_log_delta
FROM (SELECT *, {hamming('value', 'prev')} AS h FROM (SELECT *, lag(value) OVER (PARTITION BY {BUF} ORDER BY "offset") AS prev FROM snap))
WHERE prev IS NOT NULL GROUP BY bench, alloc_type"""),
    "c21_site_silent": ((lambda t: o.site_silent(t, min_pairs=10, bits=RN_BITS)), "li", SITE_SILENT),
    "c21_site_silent_hot": ((lambda t: o.site_silent(t, min_pairs=10, bits=RN_BITS)), "hot", SITE_SILENT),
    "c22_bdi_compression": (s.bdi_compression, "emb", f"""
SELECT bench, alloc_type, count(*) AS lines, count(*) FILTER (k = 1) AS trivial_lines, round(count(*) FILTER (k >= 2 AND r < 256) / nullif(count(*) FILTER (k >= 2), 0), 9) AS bdi8_frac,
       round(count(*) FILTER (k >= 2 AND r < 65536) / nullif(count(*) FILTER (k >= 2), 0), 9) AS bdi16_frac,
       round(count(*) FILTER (k >= 2 AND r < 4294967296) / nullif(count(*) FILTER (k >= 2), 0), 9) AS bdi32_frac, round(avg(r) FILTER (k >= 2), 9) AS mean_range
FROM (SELECT bench, min(alloc_type) AS alloc_type, count(*) AS k, max(value) - min(value) AS r FROM snap GROUP BY {BUF}, "offset" // 64) GROUP BY bench, alloc_type"""),
    "c23_fpc_patterns": (s.fpc_patterns, "li", f"""
SELECT bench, alloc_type, count(*) AS total, {', '.join(f'{pct(x)} AS pct_{n}' for n, x in FPC.items())}, {pct(' OR '.join(f'({x})' for x in FPC.values()))}
       AS pct_any_pattern FROM fp GROUP BY ALL"""),
    "c24_site_required_exp_bits": (s.site_required_exp_bits, "li", EXP_BITS),
    "c24_site_required_exp_bits_mix": (s.site_required_exp_bits, "mix", EXP_BITS),
    "c25_frequent_values": (s.frequent_values, "li", "SELECT bench, alloc_type, CAST(sum(n) AS BIGINT) AS total_stores, count(*) AS distinct_values, " + ", ".join(f"round(coalesce(sum(n) FILTER (r <= {k}), 0) / sum(n), 9) AS top{k}_frac" for k in (1, 8, 64, 256, 1024)) + """
FROM (SELECT *, row_number() OVER (PARTITION BY bench, alloc_type ORDER BY n DESC) AS r FROM (SELECT bench, alloc_type, value, count(*)
       AS n FROM fp GROUP BY ALL)) GROUP BY ALL"""),
    "c26_outlier_channels": (o.outlier_channels, "li", f"""
SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY total DESC, alloc_type, site) AS pick FROM (
SELECT bench, alloc_type, site, {big('sum(n)')} AS total, {big('sum(k)')} AS n_outlier_999, {big('sum(d)')} AS distinct_offsets, {big('sum(u)')} AS outlier_offsets, round(sum(u) / sum(d), 9) AS channel_frac
FROM (SELECT *, {SITE} AS site FROM (
    SELECT bench, alloc_type, alloc_stack, count(*) AS n, count(*) FILTER (mag >= edge) AS k, count(DISTINCT "offset") AS d, count(DISTINCT "offset") FILTER (mag >= edge) AS u
    FROM (SELECT *, min(mag) FILTER (r >= ceil(CAST(0.999 AS DOUBLE) * n)) OVER w AS edge
          FROM (SELECT *, count(*) OVER w AS n, count(*) OVER (PARTITION BY bench, alloc_type, alloc_stack ORDER BY mag) AS r
                FROM (SELECT bench, alloc_type, alloc_stack, "offset", value & CASE alloc_type WHEN '64bits' THEN 9223372036854775807 ELSE 2147483647 END AS mag FROM fp WHERE value <> 0)
                WINDOW w AS (PARTITION BY bench, alloc_type, alloc_stack))
          WINDOW w AS (PARTITION BY bench, alloc_type, alloc_stack)) GROUP BY bench, alloc_type, alloc_stack))
WHERE site <> '' GROUP BY bench, alloc_type, site HAVING sum(n) >= 1000)) WHERE pick <= 20"""),
    "c27_exponent_stability": (o.exponent_stability, "li", f"""
SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY distinct_offsets DESC, alloc_type, site) AS pick FROM (
SELECT bench, alloc_type, site, {big('sum(n)')} AS distinct_offsets, round(sum(n * same) / sum(n), 9) AS frac_constant_exp, round(sum(n * mean) / sum(n), 9) AS mean_exp_range,
       round(avg(median), 9) AS median_exp_range, round(max(p95), 9) AS p95_exp_range
FROM (SELECT *, {SITE} AS site FROM (
    SELECT bench, alloc_type, alloc_stack, count(*) AS n, count(*) FILTER (r = 0) / count(*) AS same, avg(r) AS mean, CAST(quantile_cont(r, 0.5) AS DOUBLE) AS median, CAST(quantile_cont(r, 0.95) AS DOUBLE) AS p95
    FROM (SELECT {BUF}, alloc_type, max(x) - min(x) AS r FROM fp WHERE x IS NOT NULL GROUP BY {BUF}, alloc_type, "offset" HAVING count(*) >= 2) JOIN bufsite USING ({BUF}) GROUP BY bench, alloc_type, alloc_stack))
WHERE site <> '' GROUP BY bench, alloc_type, site HAVING sum(n) >= 100)) WHERE pick <= 20"""),
    "c28_mx_scale_sharing": (o.mx_scale_sharing, "emb", " UNION ALL ".join(map(sharing, (16, 32, 64)))),
    "c29_bit_plane_entropy": (s.bit_plane_entropy, "li", """
SELECT bench, alloc_type, total, CAST(i AS INTEGER) AS bit_pos, round(ones / total, 9) AS p_one, CASE WHEN ones = 0 OR ones = total
       THEN 0.0 ELSE round(-(ones / total) * log2(ones / total) - (1 - ones / total) * log2(1 - ones / total), 9) END AS entropy
       FROM (SELECT bench, alloc_type, i, count(*) AS total, sum((value >> i) & 1) AS ones FROM fp, range(64) r(i)
       GROUP BY ALL)"""),
    "c30_posit_fit": (s.posit_fit, "li", f"""
SELECT bench, alloc_type, count(*) AS total, round(avg(abs(x)), 9) AS mean_abs_exp, {pct('abs(e - bias) <= 4')} AS frac_high_precision, {pct('abs(e - bias) <= 16')} AS frac_mid_precision,
       {pct('abs(e - bias) > 30')} AS frac_extreme, round(avg(greatest(0.0, 28.0 - abs(e - bias) / 2.0)), 9) AS mean_posit_useful_bits
FROM fp WHERE value <> 0 GROUP BY bench, alloc_type"""),
    "c31_cacheline_homogeneity": (o.cacheline_homogeneity, "emb", """
SELECT bench, alloc_type, count(*) FILTER (k > 1) AS lines, count(*) FILTER (k = 1) AS trivial_lines, round(avg(k), 9) AS mean_slots_per_line,
       """ + ", ".join(f"round(count(*) FILTER (k > 1 AND {n}) / nullif(count(*) FILTER (k > 1), 0), 9) AS frac_homog_{n}" for n in ("high32", "high16", "high8", "exp")) + f"""
FROM (SELECT bench, alloc_type, count(*) AS k, min(value >> 32) = max(value >> 32) AS high32, min(value >> 48) = max(value >> 48) AS
       high16, min(value >> 56) = max(value >> 56) AS high8, min({E}) = max({E}) AS exp FROM (SELECT run_id, bench, alloc_type, alloc_addr,
       "offset", arg_max(value, rn) AS value FROM fp GROUP BY ALL) GROUP BY run_id, bench, alloc_type, alloc_addr, "offset" // 64)
       GROUP BY ALL"""),
    "c32_trace_volume": (s.trace_volume, "li", f"""
SELECT bench, {big('sum(n)')} AS stores, count(*) AS buffers, count(DISTINCT alloc_stack) AS call_sites, count(DISTINCT size) AS distinct_sizes,
       {big('sum(size)')} AS bytes_addressed, round(count(*) / count(DISTINCT alloc_stack), 9) AS buffers_per_site
       FROM (SELECT {BUF}, alloc_stack, count(*) AS n, min(alloc_size) AS size FROM t GROUP BY ALL)
       GROUP BY bench"""),
    "c33_trace_robustness": (s.trace_robustness, "li", f"""
SELECT bench, min(size) AS min_size, CAST(quantile_cont(size, 0.5) AS DOUBLE) AS median_size, max(size) AS max_size, max(generation)
       AS max_generation, count(DISTINCT k) AS distinct_alignment_classes, count(*) FILTER (k = '64bits') AS buffers_64, count(*) FILTER (k
       = '32bits') AS buffers_32, count(*) FILTER (k = 'object') AS buffers_object, max(o) AS max_offset, count(DISTINCT (run_id, alloc_addr))
       FILTER (generation > 1) AS buffers_reused FROM (SELECT {BUF}, min(alloc_size) AS size, min(alloc_type) AS k, max("offset") AS o
       FROM t GROUP BY {BUF}) GROUP BY bench"""),
    "c34_exponent_classes": (s.exponent_classes, "li", f"""
SELECT bench, alloc_type, count(*) AS stores, {pct('value = 0')} AS frac_zero,
       {pct("alloc_type = '64bits' AND value <> 0 AND (value >> 52) & 2047 BETWEEN 1 AND 2046")} AS frac_normal_f64,
       {pct("alloc_type = '64bits' AND value <> 0 AND (value >> 52) & 2047 = 0")} AS frac_subnormal_f64,
       {pct("alloc_type = '64bits' AND (value >> 52) & 2047 = 2047")} AS frac_inf_nan_f64,
       {pct("alloc_type = '32bits' AND value & 4294967295 <> 0 AND (value >> 23) & 255 BETWEEN 1 AND 254")} AS frac_normal_f32,
       {pct("alloc_type = '32bits' AND value & 4294967295 <> 0 AND (value >> 23) & 255 = 0")} AS frac_subnormal_f32,
       {pct("alloc_type = '32bits' AND (value >> 23) & 255 = 255")} AS frac_inf_nan_f32
FROM t GROUP BY bench, alloc_type"""),
    "c35_buffer_silent": (ranged(o.buffer_silent), "li", BUFFER_SILENT),
    "c35_buffer_silent_hot": (ranged(o.buffer_silent), "hot", BUFFER_SILENT),
    "c36_buffer_feasibility": (s.buffer_feasibility, "li", FEAS_BUF),
    "c36_buffer_feasibility_events": (s.buffer_feasibility, "ev", FEAS_BUF),
    "c37_buffer_exp_range": (s.buffer_exp_range, "li", RANGE_BUF),
    "c37_buffer_exp_range_events": (s.buffer_exp_range, "ev", RANGE_BUF),
    "c39_zoom_silent": ((lambda t: o.zoom_silent(t, "NO", bits=RN_BITS)), "li", f"""
SELECT {BUF}, alloc_type, alloc_size, stores, pairs, silent, round(silent / pairs, 9) AS silent_frac, {SITE} AS site,
       round((SELECT sum(silent) / sum(pairs) FROM ({SILENT_BUF}) WHERE bench = 'NO'), 9) AS bench_silent_frac
FROM ({SILENT_BUF}) JOIN bufsite USING ({BUF}) WHERE pairs > 0 AND bench = 'NO' ORDER BY pairs DESC, alloc_addr, generation, run_id LIMIT 22"""),
    "c40_zoom_feasibility": ((lambda t: o.zoom_feasibility(t, "NO")), "li", f"""
SELECT {BUF}, alloc_type, alloc_size, total, pct_bf16 AS pct_fit, {SITE} AS site
FROM ({FEAS_BUF}) JOIN bufsite USING ({BUF}) WHERE bench = 'NO' ORDER BY total DESC, alloc_addr, generation, run_id LIMIT 22"""),
}

ANALYSES |= {
    "cells_table": (ranged(cells.cells), "li", CELLS),
    "cells_table_hot": (ranged(cells.cells), "hot", CELLS),
}
#: Analyses that read the table of cells instead of the trace.
OF_CELLS = (
    "c02_top_allocations", "c08_coverage", "c09_silent_stores_mixed", "c14_mx_feasibility", "c17_intra_buffer_gini", "c18_hot_offsets", "c19_mx_block_sweep",
    "c20_spatial_delta", "c22_bdi_compression", "c28_mx_scale_sharing", "c31_cacheline_homogeneity", "c35_buffer_silent",
)
for _name in OF_CELLS:
    _run, _view, _sql = ANALYSES[_name]
    ANALYSES[f"cells_{_name}"] = ((lambda t, run=_run: run(cells.cells(t, RN_BITS))), _view, _sql)
for _name, _run in (("c21_site_silent", lambda t, c, s: o.site_silent(c, min_pairs=10, stacks=s)), ("c27_exponent_stability", lambda t, c, s: o.exponent_stability(c, stacks=s))):
    _, _view, _sql = ANALYSES[_name]
    ANALYSES[f"cells_{_name}"] = ((lambda t, run=_run: run(t, cells.cells(t, RN_BITS), o.stacks_of_buffers(t))), _view, _sql)

QUERIES = {name: (lambda spark, sf_dir, run=run, view=view: run(trace(spark, sf_dir, view))) for name, (run, view, _) in ANALYSES.items()}
ORACLE_SQL = {name: ctes(view) + sql for name, (_, view, sql) in ANALYSES.items()}
