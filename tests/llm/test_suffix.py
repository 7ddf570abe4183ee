import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus import awkward, frame, rows_of

from stowage.llm import suffix

SMALL = "/root/testdata/sf0.001"
OUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, size):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + size] for _, t in texts for p in range(len(t) - size + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                gone[p : p + size] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("alphabet", [2, 3, 6])
def test_expansion_finds_exactly_the_repeated_strings(alphabet):
    rng = np.random.default_rng(alphabet)
    for _ in range(10):
        size = int(rng.integers(8, 30))
        s = np.concatenate([np.append(rng.integers(1, alphabet + 1, rng.integers(5, 90)), 0) for _ in range(6)]).astype(np.uint16)
        strings = [tuple(s[i : i + size]) if i + size <= len(s) and 0 not in s[i : i + size] else None for i in range(len(s))]
        count = Counter(strings)
        assert (suffix.repeated_starts(s, size) == np.array([x is not None and count[x] > 1 for x in strings])).all()


def test_awkward_rows_match_brute_force(spark):
    for size in (200, 64):
        assert rows_of(suffix.remove_repeats(frame(spark), size), *OUT) == brute([r[:2] for r in awkward()], size)


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows_of(suffix.remove_repeats(docs), *OUT) == brute([(r.doc_id, r.text) for r in docs.collect()], 200)


def test_crowds_are_split_by_strings(spark, monkeypatch):
    passage = " ".join(f"shared{i}" for i in range(40))
    rows = [(i, f"{'own' * (i % 40)} number {i} " + passage + f" tail {i * 7919} " * 9, None, None, None, None, None) for i in range(1200)]
    whole = rows_of(suffix.remove_repeats(frame(spark, rows)), *OUT)
    monkeypatch.setattr(suffix, "CROWD", 5)
    assert whole == brute([r[:2] for r in rows], 200)
    found = [pa.RecordBatch.from_pydict({"h": pa.array([1] * 8), "c": pa.array([*range(7), 6]), "f": pa.array([0] * 8), "r": pa.array(range(8)), "lo": pa.array([0] * 8), "hi": pa.array([9] * 8), "times": pa.array([1] * 8), "loop": pa.array([False] * 8)})]
    assert pa.Table.from_batches(suffix.sort_out(iter(found))).column("what").to_pylist() == [3] * 6 + [4, 0]


def test_no_rows(spark):
    assert suffix.remove_repeats(frame(spark, [])).count() == 0
