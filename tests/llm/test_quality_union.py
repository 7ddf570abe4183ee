"""The promise of the quality rules holds for all rules together."""

from stowage.llm import quality


def test_rules_together_keep_the_promise(spark):
    n, part = 20000, 120  # each rule by itself fails 0.6 % of good documents, other ones each
    plain = {"n_words": 100, "word_chars": 500, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "n_lines": 10}
    bad = [{"n_symbols": 400}, {"n_dup_lines": 9}, {"n_repeat_words": 90}, {"word_chars": 3000}]
    rows = [tuple((plain | (bad[i // part] if i < 4 * part else {})).values()) + ("en", 1) for i in range(n)]
    stats = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in plain) + ", lang string, good int")
    chosen = quality.calibrate(stats, "good", "lang")
    assert chosen["en"]
    assert stats.where(~quality.verdict(chosen, "lang")).count() <= 0.01 * n
