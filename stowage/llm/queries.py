"""The registered queries of the corpus operators, opN_<name>, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import integer_vectors, top_k

    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import added_tokens, pack

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


def op5_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import uniform_shards

    return uniform_shards(table(spark, sf_dir, "documents"), 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_and_decode

    out = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("n_lines")


def quality_rules_alpha_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 with a weaker promise, a tenth of good documents, for which few labels suffice: small tables get cutoffs too."""
    from .quality import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), alpha=0.1).drop("n_lines")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import removed_words

    return removed_words(table(spark, sf_dir, "documents")).drop("kept")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setjoin import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("group_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import prove

    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return prove(table(spark, sf_dir, "documents"), {"n_chars": altered}).drop("proof")


def op12_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 25).drop("n_words")


ALL = (
    op1_maxscore_search, op2_suffix_dedup, op3_pu_toxicity, op4_bin_slack_packing, op5_hypergeometric_sharding, op6_fuzzy_lines,
    op7_byte_bpe, op8_quality_rules, op9_substring_dedup, op10_jaccard_join, op11_merkle_manifest, op12_entropy_mixing,
    op13_importance_resampling, quality_rules_alpha_10,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}

# Measures, then per language the last set of cutoffs, in their fixed order, before the exact binomial tail refuses one.
QUALITY = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
starts AS (SELECT rid, p, array_to_string(w[p : p + 4], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM split WHERE len(w) >= 5)),
twice AS (SELECT rid, p FROM starts QUALIFY count(*) OVER (PARTITION BY rid, win) >= 2),
repeats AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY rid),
stats AS (
    SELECT rid, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM split LEFT JOIN repeats USING (rid)),
levels AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [
        len(list_filter([10, 20, 50, 100, 150, 200, 300, 500], lambda c: 1000 * n_symbols > c * word_chars)),
        len(list_filter([50, 100, 200, 300, 500, 700], lambda c: 1000 * n_dup_lines > c * n_lines)),
        len(list_filter([20, 50, 100, 150, 200], lambda c: 1000 * n_repeat_words > c * n_words)),
        len(list_filter([9000, 10000, 12000, 15000, 20000], lambda c: 1000 * word_chars > c * n_words))] AS level
    FROM stats),
good AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
ways AS (SELECT lang, level, count(*) FILTER (WHERE good = 1) AS n FROM levels JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
strata AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n, list({'level': level, 'n': n}) AS ways, count(*) OVER () AS strata FROM ways GROUP BY lang),
tails AS (
    SELECT lang, strata, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(ALPHA) + (n - i) * ln(1 - ALPHA))) OVER (PARTITION BY lang ORDER BY i) AS tail
    FROM (SELECT lang, strata, n, unnest(range(0, CAST(floor(ALPHA * n) AS BIGINT) + 1)) AS i FROM strata)),
most AS (SELECT lang, coalesce(max(i) FILTER (WHERE tail <= 0.05 / strata), -1) AS most FROM tails GROUP BY lang),
steps AS (SELECT round, rule, row_number() OVER (ORDER BY round, rule) AS step
          FROM (SELECT unnest(range(1, 9)) AS round) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS rule, unnest([8, 6, 5, 5]) AS n) WHERE round <= n),
sets AS (SELECT 0 AS step, [8, 6, 5, 5] AS cuts UNION ALL
         SELECT a.step, [8 - count_if(b.rule = 1), 6 - count_if(b.rule = 2), 5 - count_if(b.rule = 3), 5 - count_if(b.rule = 4)]
         FROM steps a JOIN steps b ON b.step <= a.step GROUP BY a.step),
tests AS (SELECT s.lang, step, cuts, most >= coalesce(list_sum(list_transform(list_filter(ways, lambda x:
                     x.level[1] > cuts[1] OR x.level[2] > cuts[2] OR x.level[3] > cuts[3] OR x.level[4] > cuts[4]), lambda x: x.n)), 0) AS allowed
          FROM strata s JOIN most m ON s.lang IS NOT DISTINCT FROM m.lang CROSS JOIN sets),
chosen AS (SELECT lang, arg_max(cuts, step) AS cuts
           FROM (SELECT *, bool_and(allowed OR step = 0) OVER (PARTITION BY lang ORDER BY step) AS reached FROM tests) WHERE reached GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(level[1] > cuts[1] OR level[2] > cuts[2] OR level[3] > cuts[3] OR level[4] > cuts[4], false) AS kept
FROM levels d LEFT JOIN chosen c ON d.lang IS NOT DISTINCT FROM c.lang
"""

WORDS = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM docs)
"""

BYTES = "list_transform(range(1, 2 * strlen({0}) + 1, 2), lambda i: CAST('0x' || hex(encode({0}))[i : i + 1] AS BIGINT))"
CRC32 = "xor(list_reduce(" + BYTES + ", lambda c, b: xor(c >> 8, crc_table[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295), 4294967295)"
#: The table of crc32, from its polynomial.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc_table)"""

ORACLE_SQL: dict[str, str] = {
    "op1_maxscore_search": """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
""",
    "op8_quality_rules": QUALITY.replace("ALPHA", "0.01"),
    "quality_rules_alpha_10": QUALITY.replace("ALPHA", "0.1"),
    # Levels of all runs, then of the run of their roots; siblings by level and place; the altered leaf climbs with its siblings.
    "op11_merkle_manifest": f"""
WITH RECURSIVE {CRC_TABLE},
docs AS (SELECT row_number() OVER () AS rid, *, {CRC32.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS altered FROM documents, crc),
fields AS (
    SELECT rid, doc_id, coalesce('=' || lang, '-') AS run,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n, coalesce(strlen(text) || ':' || text, '-') AS tail,
           CASE WHEN altered THEN coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') END AS n_altered
    FROM docs),
leaves AS (SELECT rid, doc_id, run, sha256(head || n || tail) AS leaf, sha256(head || coalesce(n_altered, n) || tail) AS shown FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
nodes AS (
    SELECT run, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY run) AS total FROM placed
    UNION ALL
    SELECT run, any_value(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), any_value(total + 1) // 2 FROM nodes WHERE total > 1 GROUP BY run, place // 2),
tops AS (SELECT run, digest AS subroot, row_number() OVER (ORDER BY run) - 1 AS place, count(*) OVER () AS runs FROM nodes WHERE total = 1),
upper AS (
    SELECT 0 AS level, place, subroot AS digest, runs AS total FROM tops
    UNION ALL
    SELECT any_value(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), any_value(total + 1) // 2 FROM upper WHERE total > 1 GROUP BY place // 2),
whole AS (SELECT digest AS root FROM upper WHERE total = 1),
high AS (SELECT run, subroot, place, (SELECT max(level) FROM nodes n WHERE n.run = tops.run) AS height FROM tops),
climb AS (
    SELECT rid, run, 0 AS level, place, shown AS digest, '' AS proof FROM placed
    UNION ALL
    SELECT c.rid, c.run, c.level + 1, c.place // 2, sha256(CASE WHEN c.place % 2 = 1 THEN s.digest || c.digest ELSE c.digest || coalesce(s.digest, '') END), c.proof || coalesce(s.digest, '')
    FROM climb c JOIN high h USING (run) LEFT JOIN nodes s ON s.run = c.run AND s.level = c.level AND s.place = xor(c.place, 1) WHERE c.level < h.height),
over_runs AS (
    SELECT rid, 0 AS level, h.place, digest, proof FROM climb c JOIN high h ON c.run = h.run AND c.level = h.height
    UNION ALL
    SELECT c.rid, c.level + 1, c.place // 2, sha256(CASE WHEN c.place % 2 = 1 THEN s.digest || c.digest ELSE c.digest || coalesce(s.digest, '') END), c.proof || coalesce(s.digest, '')
    FROM over_runs c LEFT JOIN upper s ON s.level = c.level AND s.place = xor(c.place, 1) WHERE c.level < (SELECT max(level) FROM upper))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM over_runs JOIN leaves USING (rid) JOIN tops ON tops.run = leaves.run, whole WHERE level = (SELECT max(level) FROM upper)
""",
    "op13_importance_resampling": rf"""
WITH {CRC_TABLE},
docs AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
goal AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
words AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT rid, doc_id, text FROM docs UNION ALL SELECT NULL, NULL, text FROM goal)),
features AS (
    SELECT rid IS NULL AS is_goal, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
different AS (SELECT f, CAST({CRC32.format("f")} % 10000 AS BIGINT) AS bucket FROM (SELECT DISTINCT f FROM features), crc),
counts AS (SELECT bucket, count(*) FILTER (NOT is_goal) AS s, count(*) FILTER (is_goal) AS t FROM features JOIN different USING (f) GROUP BY bucket),
sums AS (SELECT CAST(sum(s) AS BIGINT) AS all_s, CAST(sum(t) AS BIGINT) AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000)))) AS gain FROM counts, sums),
means AS (SELECT rid, floor(sum(gain) / count(*)) AS weight, count(*) AS n FROM features JOIN different USING (f) JOIN gains USING (bucket) WHERE NOT is_goal GROUP BY rid),
scores AS (
    SELECT rid, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM words LEFT JOIN means USING (rid) WHERE rid IS NOT NULL),
drawn AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM scores LEFT JOIN drawn USING (rid)
""",
    "op9_substring_dedup": WORDS
    + """,
starts AS (SELECT rid, doc_id, p, array_to_string(w[p : p + 12], ' ') AS win
           FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words WHERE len(w) >= 13)),
least AS (SELECT win, min(doc_id) AS first_doc FROM starts GROUP BY win),
hit AS (SELECT DISTINCT rid, unnest(range(p, p + 13)) AS q FROM starts JOIN least USING (win)
        WHERE first_doc < doc_id OR (doc_id IS NULL AND first_doc IS NOT NULL)),
gone AS (SELECT rid, list(q) AS gone FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (rid)
""",
    "op10_jaccard_join": WORDS
    + """,
shingles AS (
    SELECT DISTINCT rid, sh FROM (
        SELECT rid, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh
        FROM (SELECT rid, list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM words))),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
links AS (
    SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS o FROM shingles x JOIN shingles y ON x.sh = y.sh AND x.rid <> y.rid GROUP BY ALL)
    JOIN sizes s ON s.rid = a JOIN sizes t ON t.rid = b WHERE 100 * o >= 85 * (s.n + t.n - o)),
reach AS (
    WITH RECURSIVE r(a, b) AS (SELECT rid, rid FROM docs UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a)
    SELECT a, min(d.doc_id) AS component_id FROM r JOIN docs d ON d.rid = r.b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (rid) JOIN reach ON reach.a = docs.rid
""",
}
