"""Substring dedup, Jaccard join and quality rules against brute force, on awkward rows and on a small table."""

import hashlib
from collections import Counter

import pytest
from corpus import WORD, awkward, frame, rows_of

from stowage.llm import quality, setjoin, substring

SMALL = "/root/testdata/sf0.001"


def brute_substring(rows, size=13):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, w in docs:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, float("inf")), order(i))
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < order(i):
                gone |= set(range(p, p + size))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[p : p + 4]) for p in range(len(w) - 3)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                label[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(sets[x]), least.get(find(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)), key=repr)


def brute_stats(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    count = Counter(tuple(words[p : p + 5]) for p in range(len(words) - 4))
    hit = {p + k for p in range(len(words) - 4) if count[tuple(words[p : p + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.collect()]


def test_substring(spark, small):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows_of(substring.removed_words(frame(spark)), *columns) == brute_substring([r[:2] for r in awkward()])
    assert rows_of(substring.removed_words(small[0]), *columns) == brute_substring(small[1])
    assert substring.removed_words(frame(spark, [])).count() == 0


def test_a_full_sketch_loses_nothing(small):
    """With so few cells that all count as repeated, the exact pass alone decides."""
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows_of(substring.removed_words(small[0], most_cells=1 << 16), *columns) == brute_substring(small[1])


def test_jaccard(spark, small):
    columns = ("doc_id", "n_shingles", "component_id")
    assert rows_of(setjoin.near_duplicates(frame(spark)), *columns) == brute_jaccard([r[:2] for r in awkward()])
    assert rows_of(setjoin.near_duplicates(small[0]), *columns) == brute_jaccard(small[1])
    assert setjoin.near_duplicates(frame(spark, [])).count() == 0


def test_jaccard_chains_of_small_steps(spark):
    """Each text differs from the next by a few words, the ends by all: hubs, members and the bounds all take part."""
    words = [f"w{i}" for i in range(220)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60]), None, None, None, None, None) for i in range(50)] + [(100 + i, " ".join(words[2 * i : 2 * i + 80]), None, None, None, None, None) for i in range(40)]
    assert rows_of(setjoin.near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == brute_jaccard([r[:2] for r in rows])


def test_quality_stats(spark, small):
    for docs, rows in ((frame(spark), [r[:2] for r in awkward()]), small):
        got = rows_of(quality.document_stats(docs, "doc_id"), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert got == sorted(((i, *brute_stats(t)) for i, t in rows), key=repr)


def test_upper_bound_is_the_exact_binomial_bound():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert quality.upper_bound(5, 5, 0.05) == 1.0
    from math import comb

    p = quality.upper_bound(3, 50, 0.01)
    assert sum(comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4)) == pytest.approx(0.01, rel=1e-6)


def test_quality_rules(spark):
    good = "plain words of an ordinary text that say this and that about nothing number "
    bad = "sym### bol*** heavy$$$ text%%% with&&& very||| many### marks*** in$$$ it%%% number "
    rows = [(i, (bad if i % 10 == 0 else good) + str(i), "en" if i % 2 else None, None, None, None, None) for i in range(4000)]
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1, 0) for i in range(3500)] + [(None, 1, 1), (5, None, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.apply_rules(frame(spark, rows), labels).collect()}
    assert len(out) == 4000 and all(out[i].kept == (i % 10 != 0) for i in out)
    few = quality.apply_rules(frame(spark, rows), labels.limit(0))
    assert few.where("not kept").count() == 0  # no labels: no evidence, no rejection beyond the base rule
    kept = {r.doc_id: r.kept for r in quality.apply_rules(frame(spark), labels).collect()}
    assert kept[5] is False and kept[11] is False
