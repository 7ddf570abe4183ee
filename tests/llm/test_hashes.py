"""Strings that collide in every polynomial hash modulo 2**64 are told apart."""

from corpus import frame, rows_of

from stowage.llm import lines, setjoin, substring


def pair(n=11):
    x, y = "a", "b"
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def docs(*texts):
    return [(i, t, None, None, None, None, None) for i, t in enumerate(texts, 1)]


def test_words(spark):
    x, y = pair()
    assert rows_of(setjoin.near_duplicates(frame(spark, docs(x, y, x))), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1)]
    rest = " one two three four five six seven eight nine ten eleven twelve"
    assert rows_of(substring.removed_words(frame(spark, docs(x + rest, y + rest, y + rest))), "doc_id", "n_removed") == [(1, 0), (2, 0), (3, 13)]


def test_lines_of_words(spark):
    x, y = (" ".join({"a": "left", "b": "right"}[c] for c in w) for w in pair())
    assert rows_of(lines.dedup_lines(frame(spark, docs(x, y, y))), "doc_id", "n_removed")[::2] == [(1, 0), (3, 1)]
    assert rows_of(setjoin.near_duplicates(frame(spark, docs(x, x))), "doc_id", "component_id") == [(1, 1), (2, 1)]
