import base64
import random

import public_tokenizers
import tiktoken
from corpus import awkward, frame

from stowage.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(RANKS, "rb") as f:
    CONTENT = f.read()
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}, special_tokens={})


def test_words_match_the_library():
    rng = random.Random(3)
    words = ["", " the", "x" * 3000, "ab" * 700 + "é" * 99, " " * 500, "你好" * 60, *("".join(rng.choices("aeinrst hou", k=rng.randint(1, 200))) for _ in range(400)), *("".join(rng.choices("ab", k=300)) for _ in range(40))]
    codec = bpe.Codec(CONTENT)
    ids = codec.encode([w.encode() for w in words])
    for w, got in zip(words, ids, strict=True):
        assert got.tolist() == ENCODING._core_bpe.encode_single_piece(w.encode()) if w else not len(got)
    assert codec.decode(ids) == [w.encode() for w in words]
    assert codec.decode([]) == []


def test_texts_match_the_library_and_come_back(spark):
    for docs in (frame(spark), spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), frame(spark, [])):
        texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
        got = sorted(((r.doc_id, bytes(r.decoded).decode(), r.n_tokens, bytes(r.ids)) for r in bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN).collect()), key=lambda x: repr(x[:2]))
        assert [x[:2] for x in got] == texts
        for _, text, n, ids in got:
            assert (n, ids) == (len(e := ENCODING.encode_ordinary(text)), b"".join(i.to_bytes(4, "little") for i in e))


def test_nothing_is_lost_when_words_are_forgotten(spark, monkeypatch):
    assert len(awkward()) > 10
    monkeypatch.setattr(bpe, "WORDS", 3)
    codec = bpe.Codec(CONTENT)
    assert codec.decode(codec.encode([b"one", b" two", b" three", b" four", b""])) == [b"one", b" two", b" three", b" four", b""]


def test_rounds_start_again_from_where_they_are(monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoin shrdlu", k=k)).encode() for k in (5000, 80, 3, 70, 900)] + [b"ab" * 9000]
    monkeypatch.setattr(bpe, "ROWS", 20_000)
    monkeypatch.setattr(bpe, "BYTES", 2000)
    codec = bpe.Codec(CONTENT)
    ids = codec.encode(words)
    assert [x.tolist() for x in ids] == [ENCODING._core_bpe.encode_single_piece(w) for w in words]
    assert codec.decode(ids) == words
