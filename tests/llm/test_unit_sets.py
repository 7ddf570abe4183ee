"""The shingle sets of a unit are made block by block, and are those of the unit taken whole."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from stowage.llm import scan, setjoin


def test_sets_of_a_unit_by_blocks():
    rng = random.Random(41)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 5, 60, 3000]))) for _ in range(1200)] + [None, "", "end"]
    rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    raw, offsets = scan.text_buffer(rows.column("text"))
    assert len(raw) > 2 << 20  # several blocks
    tracemalloc.start()
    whole = setjoin.Sets(raw, offsets, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    got = setjoin.unit_sets(rows, 5)
    peak_by_blocks = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    for c in ("values", "doc", "bounds", "n"):
        assert np.array_equal(getattr(got, c), getattr(whole, c))
    assert peak_by_blocks < 0.8 * peak
    none = setjoin.unit_sets(rows.slice(0, 0), 5)
    assert len(none.n) == len(none.values) == 0 and none.bounds.tolist() == [0]
