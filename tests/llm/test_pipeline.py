"""Each stage on its own input against brute force or its promise, on a small table."""

import importlib

import pytest
from corpus import WORD, frame

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """name -> (input rows, output rows)."""
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {}
    for name, stage in pipeline.STAGES:
        result = pipeline.written(stage(spark, docs, SMALL), "test")
        out[name] = docs.collect(), result.collect(), result.columns
        docs = result
    return out


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_columns(stages):
    assert all(columns == COLUMNS for name, (_, _, columns) in stages.items() if name != "packing")


def test_quality_keeps_or_drops_whole_documents(stages):
    before, after, _ = stages["quality rules"]
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(gone) < 0.2 * len(before)


def test_lines(stages):
    from test_lines import brute

    before, after, _ = stages["line dedup"]
    assert sorted((r.doc_id, r.text) for r in after) == sorted((x[0], x[3]) for x in brute([(r.doc_id, r.text) for r in before]))
    assert all(r.n_chars == len(r.text) for r in after)


def test_one_of_each_group(stages):
    before, after, _ = stages["near duplicates"]
    sets = [shingles(r.text) for r in before]
    label = list(range(len(before)))
    for x in range(len(before)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                label = [label[y] if k == label[x] else k for k in label]
    groups = {}
    for x, r in enumerate(before):
        groups.setdefault(label[x] if sets[x] else ("empty", x), []).append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(min(g) for g in groups.values())


def test_suffix(stages):
    from collections import Counter

    before, after, _ = stages["suffix dedup"]
    texts = {r.doc_id: r.text.encode() for r in before}
    seen = Counter(t[p : p + 200] for t in texts.values() for p in range(len(t) - 199))
    kept = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept[i] = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in after} == kept


def test_packing_takes_all_documents(stages):
    before, after, _ = stages["packing"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    fill = {}
    for r in after:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.02 * sum(fill.values()) / 1024 + 2


def test_stages_take_awkward_rows(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    for rows in (None, []):
        docs = frame(spark, rows)
        for name, stage in pipeline.STAGES:
            docs = pipeline.written(stage(spark, docs, SMALL), "test")
            assert docs.count() > 0 or rows == []
