"""The SQL of the quality rules gives the operator's rows, cutoffs included."""

import random

import duckdb
from corpus import awkward, frame

from stowage.llm import quality, queries


def test_sql_chooses_the_same_cutoffs(spark, tmp_path):
    rng = random.Random(8)
    rows = list(awkward())
    for i in range(100, 6100):
        w = [rng.choice("abcdefghij") * rng.randint(1, 9) + str(rng.randrange(50)) for _ in range(rng.randint(8, 30))]
        w = [x + "#*" * (rng.random() < 0.02) for x in w] + (w[:6] if rng.random() < 0.05 else [])
        lines = [" ".join(w[:9]), " ".join(w[9:])]
        rows.append((i, "\n".join(lines + lines[:1] * (rng.random() < 0.01)), "en" if i % 6 else None, *[None] * (len(rows[0]) - 3)))
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(rng.random() < 0.9), 0) for i in range(100, 6000)] + [(None, 1, 0), (200, None, 0), (300, 1, 0)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op8_quality_rules"])
    got = queries.op8_quality_rules(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    assert 0 < sum(not r.kept and not r.base_failed for r in got) <= 0.02 * len(got)
    assert quality.RULES.keys() == {"symbols", "dup_lines", "repeat_words", "word_length"}


def test_rules_reject_documents_of_the_small_tables(spark):
    """With a promise that few labels suffice for, rows equal the SQL's and the rules, not only the base rule, reject some."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.sql(queries.ORACLE_SQL["quality_rules_alpha_10"])
    got = queries.quality_rules_alpha_10(spark, folder).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    assert 0 < sum(not r.kept and not r.base_failed for r in got) <= 0.2 * len(got)


def test_empty_tables(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.apply_rules(docs, labels).count() == 0
    kept = quality.apply_rules(frame(spark), labels)
    assert kept.where("kept = base_failed").count() == 0  # no labels: nothing but the base rule


def test_sets_of_cutoffs_are_nested():
    sets = quality.sequence()
    assert len(sets) == sum(len(grid) for _, _, grid in quality.RULES.values())
    assert all(sum(x) == sum(y) + 1 and all(a >= b for a, b in zip(x, y, strict=True)) for x, y in zip(sets, sets[1:], strict=False))
    assert sets[-1] == (0, 0, 0, 0)
