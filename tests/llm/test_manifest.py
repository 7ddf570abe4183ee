"""The Merkle manifest against trees built level by level."""

import hashlib
import zlib

import pytest
from corpus import awkward, frame
from pyspark.sql import functions as F

from stowage.llm import manifest

SMALL = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([h(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return levels


def postorder(levels):
    out = []

    def visit(level, i):
        if level:
            for child in (2 * i, 2 * i + 1):
                if child < len(levels[level - 1]):
                    visit(level - 1, child)
        out.append((level, i))

    visit(len(levels) - 1, 0)
    return out


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text), altered as the query alters them."""
    def leaf(r, more=0):
        i, source, lang, n, text = r
        return h(*(field(x) for x in (i, source, lang, None if n is None else n + more, text)))

    runs = {}
    for r in rows:
        runs.setdefault(r[2], []).append(r)
    names = sorted(runs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        own = sorted(runs[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = own, levels_of([leaf(r) for r in own])
    top = levels_of([trees[n][1][-1][0] for n in names])
    out = []
    for at, name in enumerate(names):
        own, levels = trees[name]
        for i, r in enumerate(own):
            got = leaf(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            siblings = []
            for tree, place in ((levels, i), (top, at)):
                for row in tree[:-1]:
                    other = row[place ^ 1] if place ^ 1 < len(row) else ""
                    siblings.append(other)
                    got = h(other, got) if place & 1 else h(got, other)
                    place >>= 1
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], h(*siblings), got, got == top[-1][0]))
    return sorted(out, key=repr)


def proved(docs, levels=manifest.LEVELS):
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return sorted((tuple(r) for r in manifest.prove(docs, {"n_chars": altered}, levels).drop("proof").collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 16, 21, 33, 100])
def test_places_are_those_of_a_postorder_walk(n):
    levels = levels_of([str(i) for i in range(n)])
    order = postorder(levels)
    where = {node: at for at, node in enumerate(order)}
    assert all(manifest.position(level, i, n) == at for (level, i), at in where.items())
    assert [levels[level][i] for level, i in order][-1] == levels[-1][0]
    for leaf in range(n):
        for level, (side, at) in enumerate(manifest.sibling_positions(leaf, n)):
            i = leaf >> level ^ 1
            assert (side, at) == (("N", -1) if i >= len(levels[level]) else ("L" if i < leaf >> level else "R", where[level, i]))


@pytest.mark.parametrize("n", [1, 2, 7, 12])
def test_builder_logs_in_order_of_completion(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    levels = levels_of([x.hex() for x in leaves])
    assert [x.hex() for x in manifest.append_log(leaves, manifest.height(n))] == [levels[level][i] for level, i in postorder(levels)]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_proofs(spark, levels):
    """With small builders, several tiers."""
    rows = awkward()
    assert proved(frame(spark), levels) == brute([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    if levels > 1:
        assert proved(small, levels) == brute([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in small.collect()])


def test_nothing_and_one_row(spark):
    assert proved(frame(spark, [])) == []
    one = (5, "a", "en", None, None, None, None)
    (row,) = proved(frame(spark, [one]))
    assert row[1] == row[2] == row[3] == row[5] and row[6] and row[4] == h()


def test_equal_rows_are_leaves_of_their_own(spark):
    rows = [(1, "same", "en", "src", 4, None, None)] * 700 + [(2, "x" * 3_000_000, "fr", None, 3_000_000, None, None)]
    assert proved(frame(spark, rows)) == brute([(r[0], r[3], r[2], r[4], r[1]) for r in rows])


def test_whole_log(spark):
    """Nodes of all tiers stand at the places of one postorder walk of the run."""
    n = 45
    leaves = [hashlib.sha256(bytes([i])).hexdigest() for i in range(n)]
    rows = spark.createDataFrame([("r", i, n, i, bytes.fromhex(x), None) for i, x in enumerate(leaves)], "run string, place long, total long, doc_id long, digest binary, claimed binary")
    levels = levels_of(leaves)
    log = sorted(((r.position, r.level, bytes(r.digest).hex()) for r in manifest.log_rows(manifest.build_log(rows, 2), 2).collect()))
    assert log == [(at, level, levels[level][i]) for at, (level, i) in enumerate(postorder(levels))]
