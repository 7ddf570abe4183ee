"""Byte-level BPE by recursive queries of an embedded SQL engine, one per partition.

Each task splits its texts, and a recursive query over token positions contracts every distinct word: positions join
the merge table, each word's leftmost pair of least rank becomes one token, until no pair is left. An ordered
aggregation gathers a word's ids, another one decodes them. Texts are then the ids of their words in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import freed

LONG = 64  # bytes of a word from which equal pairs are contracted together, see LONG_STEP
CACHE = 700_000  # distinct words that a worker remembers, over all its tasks; more are encoded anew
DOCS = 1600  # texts whose new words are encoded together: every query costs its rounds, however few its words
WORDS = 40_000  # words of one recursive query
BYTES = 1 << 18  # bytes of its words, or one word; a query of long words has a fourth
ROWS = 4_000_000  # rows that a query's rounds may leave; after that many it starts again from where it is

SHORT_STEP = """
    WITH pairs AS (
        SELECT w, pos, tok, d, lead(tok) OVER seq AS next_tok, lag(pos) OVER seq AS before_pos
        FROM step WHERE NOT done AND d < {rounds} WINDOW seq AS (PARTITION BY w ORDER BY pos)),
    best AS (SELECT w, min(CAST(m AS BIGINT) << 32 | pos) AS b FROM pairs JOIN merges ON tok = l AND next_tok = r GROUP BY w)
    SELECT pairs.w, pos, CASE WHEN pos = (b & 4294967295) THEN CAST(b >> 32 AS INTEGER) ELSE tok END, b IS NULL, d + 1
    FROM pairs LEFT JOIN best ON pairs.w = best.w
    WHERE b IS NULL OR before_pos IS NULL OR before_pos <> (b & 4294967295)
"""
# The same for long words. While no merge of the new token has a lower rank (safe), the leftmost pair of least rank stays
# the same pair until it is used up, so all its places, left to right and not overlapping, are contracted in one round.
LONG_STEP = """
    WITH pairs AS (
        SELECT w, pos, tok, d, lead(tok) OVER seq AS next_tok, lag(pos) OVER seq AS before_pos, row_number() OVER seq AS k
        FROM step WHERE NOT done AND d < {rounds} WINDOW seq AS (PARTITION BY w ORDER BY pos)),
    hit AS (SELECT w, pos, k, m, safe FROM pairs JOIN merges ON tok = l AND next_tok = r),
    least AS (SELECT w, min(m) AS m FROM hit GROUP BY w),
    chosen AS (SELECT hit.*, k - row_number() OVER seq AS run, k = min(k) OVER (PARTITION BY w) AS leftmost
               FROM hit JOIN least USING (w, m) WINDOW seq AS (PARTITION BY w ORDER BY k)),
    take AS (SELECT w, pos, m FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY k) AS n FROM chosen) WHERE n % 2 = 1 AND (safe OR leftmost))
    SELECT pairs.w, pairs.pos, coalesce(take.m, tok), least.m IS NULL, d + 1
    FROM pairs LEFT JOIN least ON pairs.w = least.w LEFT JOIN take ON take.w = pairs.w AND take.pos = pairs.pos
    WHERE NOT EXISTS (SELECT 1 FROM take gone WHERE gone.w = pairs.w AND gone.pos = pairs.before_pos)
"""
ENCODE = """
WITH RECURSIVE step(w, pos, tok, done, d) AS (SELECT w, pos, tok, false, 0 FROM start UNION ALL ({step}))
SELECT w, done, list(tok ORDER BY pos) AS ids FROM step WHERE done OR d = {rounds} GROUP BY w, done
"""
DECODE = "SELECT w, string_agg(piece, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary USING (tok) GROUP BY w"


class Codec:
    """The merge table and vocabulary of a rank file, in an engine of one thread and bounded memory."""

    def __init__(self, ranks_file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        splits = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        l, r, m = (pa.array(x, pa.int32()) for x in zip(*splits, strict=True))  # noqa: E741
        unsafe = {part for left, right, merged in splits for part in (left, right) if merged < part}
        self._table("merges", {"l": l, "r": r, "m": m, "safe": pa.array([i not in unsafe for _, _, i in splits])})
        self._table("vocabulary", {"tok": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array([t.hex() for t in ranks])})

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _rows(self, sql: str) -> pa.Table:
        return self.db.sql(sql).to_arrow_table().combine_chunks()

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of every word, each on its own."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        whole = self._whole(words)
        for k, token in whole:
            out[k] = np.array([token], np.int32)
        rest = size > 0
        rest[[k for k, _ in whole]] = False
        for pick, step, most in ((rest & (size < LONG), SHORT_STEP, BYTES), (rest & (size >= LONG), LONG_STEP, BYTES // 4)):
            at = np.flatnonzero(pick)
            total = np.append(0, np.cumsum(size[at]))
            i = 0
            while i < len(at):
                j = max(i + 1, min(i + WORDS, int(np.searchsorted(total, total[i] + most, "right")) - 1))
                self._contract(at[i:j], [self.byte[np.frombuffer(words[k], np.uint8)] for k in at[i:j]], step, out)
                i = j
        return out

    def _whole(self, words: list[bytes]) -> list[tuple[int, int]]:
        """The words that are a token as they stand, as the library takes them before any merge."""
        self._table("asked", {"w": pa.array(range(len(words)), pa.int32()), "piece": pa.array([w.hex() for w in words], pa.string())})
        rows = self._rows("SELECT w, tok FROM asked JOIN vocabulary USING (piece)")
        return list(zip(rows.column("w").to_pylist(), rows.column("tok").to_pylist(), strict=True))

    def _contract(self, names: np.ndarray, tokens: list[np.ndarray], step: str, out: list[np.ndarray]) -> None:
        """Contracts the words until no pair is left; as many rounds at a time as leave at most ROWS rows (one at least)."""
        while len(names):
            n = np.array([len(x) for x in tokens])
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self._table("start", {"w": pa.array(np.repeat(names, n).astype(np.int32)), "pos": pa.array(pos.astype(np.int32)), "tok": pa.array(np.concatenate(tokens).astype(np.int32))})
            rounds = max(1, ROWS // len(pos))
            rows = self._rows(ENCODE.format(step=step.format(rounds=rounds), rounds=rounds))
            ids = rows.column("ids").chunk(0)
            flat, cut = ids.values.to_numpy(), ids.offsets.to_numpy()
            names, tokens = [], []
            for w, done, i, j in zip(rows.column("w").to_pylist(), rows.column("done").to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if done:
                    out[w] = flat[i:j].copy()
                else:
                    names.append(w)
                    tokens.append(flat[i:j])

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of every sequence of ids."""
        out = [b""] * len(ids)
        n = np.array([len(x) for x in ids], np.int64)
        parts = np.append(np.flatnonzero(np.diff(np.cumsum(n) // (4 * BYTES), prepend=-1)), len(ids))
        for first, last in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True):
            n = np.array([len(x) for x in ids[first:last]], np.int64)
            if not n.sum():
                continue
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self._table("ids", {"w": pa.array(np.repeat(np.arange(first, last), n).astype(np.int32)), "pos": pa.array(pos.astype(np.int32)), "tok": pa.array(np.concatenate(ids[first:last]).astype(np.int32))})
            rows = self._rows(DECODE)
            for w, text in zip(rows.column("w").to_pylist(), rows.column("hex").to_pylist(), strict=True):
                out[w] = bytes.fromhex(text)
        return out


#: A worker's codec and what it has learned: word -> ids, word -> decoded bytes, of the rank file that it used last.
_learned: dict[bytes, tuple[Codec, dict[str, bytes], dict[str, bytes]]] = {}


def learned(ranks_file: bytes) -> tuple[Codec, dict[str, bytes], dict[str, bytes]]:
    """Workers live on between tasks; a word that one task has encoded is known to the next."""
    key = hashlib.sha256(ranks_file).digest()
    if key not in _learned:
        _learned.clear()
        _learned[key] = Codec(ranks_file), {}, {}
    return _learned[key]


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded (bytes): per row of `docs`, in no order.

    Each match of `pattern` is a word of its own; special tokens' strings are ordinary text. Null texts are empty: no
    ids. Texts and words of any length are whole; equal words are encoded once per worker while it remembers them. The
    rank file is read by the driver and goes to the executors with the plan (1 MB for 50,000 tokens).
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        codec, ids, text = learned(shared.value)

        def learn(words: list[str]) -> None:
            found = codec.encode([w.encode() for w in words])
            ids.update(zip(words, (x.astype("<u4").tobytes() for x in found), strict=True))
            text.update(zip(words, codec.decode(found), strict=True))

        for whole in batches:
            for at in range(0, len(whole), DOCS):
                rows = whole.slice(at, DOCS)
                words = [split.findall(t) if t else [] for t in rows.column("text").to_pylist()]
                if len(ids) > CACHE:
                    ids.clear()
                    text.clear()
                new = list(dict.fromkeys(w for d in words for w in d if w not in ids))
                if new:
                    learn(new)
                coded = [b"".join(map(ids.__getitem__, d)) for d in words]
                plain = [b"".join(map(text.__getitem__, d)) for d in words]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(coded, pa.binary()), pa.array(plain, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id long, n_tokens long, ids binary, decoded binary")
