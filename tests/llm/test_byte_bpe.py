"""Byte-level BPE by ranks against the library's own encoding."""

import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from locushift.llm import byte_bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.codec(PATH, public_tokenizers.PATTERN)


def same(own, library, texts):
    got = list(own.run([t.encode() for t in texts]))
    want = library.encode_ordinary_batch(texts)
    return all(g == (",".join(map(str, w)), len(w), t.encode()) for g, w, t in zip(got, want, texts, strict=True))


def test_whole_tables(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    assert sorted(map(tuple, byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, with_ids=False).collect())) == sorted(want)


def test_odd_rows(spark, library):
    texts = [None, "", " ", "<|endoftext|>", "a" * 3000, " \n" * 500 + "x", "it's we'LL\r\n\r\n  'd", "日本語" * 700, "é́ ü　 x\x85\x1cy", "same words " * 2000, "word " * 300_000]
    frame = spark.createDataFrame([(i if i != 3 else None, t, "x", [1]) for i, t in enumerate(texts)] + [(1, "", "x", [1])], "doc_id long, text string, lang string, ids array<int>")
    found = byte_bpe.encode_documents(frame, PATH, public_tokenizers.PATTERN)
    by = {(r.doc_id, r.n_tokens): list(r.ids) for r in found.collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert by[i if i != 3 else None, len(ids)] == ids
    data = {r.doc_id: bytes(r.data) for r in byte_bpe.decode_documents(found, PATH, public_tokenizers.PATTERN).collect()}
    assert data[7].decode() == texts[7] and data[0] == b"" and data[None] == b"<|endoftext|>"
    assert byte_bpe.encode_documents(frame.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_every_character(own, library):
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    assert same(own, library, [every, " ".join(every[:70_000])])


def test_random_texts(own, library):
    rng = random.Random(5)
    some = " \t\n\x0b\x1c\x85　'stmd12aé!​日ñ"
    assert same(own, library, ["".join(rng.choice(some) for _ in range(rng.randrange(80))) for _ in range(3000)])


def test_long_pieces_in_time(own, library):
    rng = random.Random(6)
    assert same(own, library, ["".join(rng.choice("abcdefgh") for _ in range(200_000)), " " * 100_000 + "x"])


def test_perfect_hash():
    keys = [f"key {i * i}".encode() for i in range(5000)] + [b""]
    h = byte_bpe.PerfectHash(keys)
    assert h.find(keys) == list(range(5001)) and sorted(h.values) == list(range(5001))
    assert h.find([b"stranger", b"key 2"]) == [-1, -1] and byte_bpe.PerfectHash([]).find([b"x"]) == [-1]
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"twice", b"twice"])


def test_tier_one_answers_what_is_in_the_vocabulary(own):
    own_tokens = list(own.bytes_of.values())[300:600]
    assert [len(x) for x in own.encoded(own_tokens)] == [1] * 300


def test_caches_stay_bounded(own):
    before = own.pieces.most
    try:
        own.pieces.most = 50
        for i in range(20):
            list(own.run([" ".join(f"q{i}x{j}" for j in range(40)).encode(), b"z" * 1000]))
        assert len(own.pieces) + len(own.pieces.old) <= 2 * (50 + 42) and "z" * 1000 not in own.pieces
    finally:
        own.pieces.most = before
