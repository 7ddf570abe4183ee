"""Documents with every awkward case, and brute-force helpers."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk_f string, h int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"alpha{i} beta{i % 7} gamma{i % 11}" for i in range(60))


def awkward():
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    near = BASE.split(" ")
    texts = [
        (1, BASE), (2, BASE), (3, BASE.replace("alpha30", "omega")), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (7, "one"), (8, "one two three"), (9, "One TWO three"),
        (10, "x" * 5000), (11, "word " * 3000), (12, "é" * 150 + "\n" + BASE[:400]), (None, BASE), (None, "lone words of a row without a name " * 3), (13, " ".join(near[:150])),
        (14, "a\x0bb\x0cc d e f\x85g"), (15, "line\n" * 40), (16, BASE + " " + BASE), (16, "second row of sixteen " + BASE[:300]), (17, "\x00nul \x00nul " * 60),
        (18, " ".join(near[:160] + ["changed"] + near[161:])), (19, "idiot moron " * 5), (-3, " ".join(near[20:])),
        (20, "left <|endoftext|> right<|endoftext|><|endof"),
    ]
    return [(i, t, None if n % 3 == 0 else ("en", "fr")[n % 2], None if n % 5 == 0 else "src", None if t is None else len(t), "clash", n) for n, (i, t) in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
