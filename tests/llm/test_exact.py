"""Operators whose result is fixed, against plain Python over the same rows."""

import hashlib
from collections import Counter

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, ranges string"


def made(spark, texts):
    rows = [(i if i != 7 else None, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


LONG = " ".join(f"w{i * i % 9973}" for i in range(4000))
COMMON = " ".join(f"c{i}" for i in range(60))
ODD = [
    None, "", "one", " \n\t ", "a b c", "a b c", LONG, LONG, f"x y {COMMON} z", f"before {COMMON}\nafter it", f"{COMMON} {COMMON}",
    "same " * 300, "é ü　x  <|endoftext|> y" * 40, "no\x0bspace\x0chere" * 50, "end ", "tab\tsep\r\nline " * 30, "日本語" * 200, "!?" * 500,
]


@pytest.fixture(scope="module")
def frames(spark, data):
    return [made(spark, ODD), spark.read.parquet(f"{data}/documents.parquet"), made(spark, [])]


def texts(frame):
    return [(r.doc_id, (r.text or "")) for r in frame.select("doc_id", "text").collect()]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def repeated(sequences, length):
    count = Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if count[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_substring_dedup(frames):
    from locushift.llm import substring_dedup

    for frame in frames:
        own = [(d, t.encode().split()) for d, t in texts(frame)]
        want = [(d, len(w), sum(g), sha(b" ".join(x for x, o in zip(w, g) if not o))) for (d, w), g in zip(own, repeated([w for _, w in own], 35))]
        assert rows(substring_dedup.report(frame)) == sorted(want, key=str)


def test_substring_dedup_keeps_columns(frames):
    from locushift.llm import substring_dedup

    out = substring_dedup.dedup(frames[0])
    assert out.columns == frames[0].columns and out.count() == len(ODD)
    by = {r.doc_id: r for r in out.collect()}
    assert by[0].text is None and by[8].text == "x y z" and by[9].text == "before\nafter it" and by[8].n_chars == 5


def test_suffix_dedup(frames):
    from locushift.llm import suffix_dedup

    for frame in frames:
        own = [(d, t.encode()) for d, t in texts(frame)]
        want = []
        for (d, b), g in zip(own, repeated([b for _, b in own], 200)):
            runs = sum(1 for i, x in enumerate(g) if x and not (i and g[i - 1]))
            want.append((d, len(b), sum(g), runs, sha(bytes(x for x, o in zip(b, g) if not o))))
        assert rows(suffix_dedup.report(frame)) == sorted(want, key=str)


def test_bpe_codec(frames):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from locushift.llm import bpe_codec

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for frame in frames:
        want = []
        for d, text in texts(frame):
            ids = t.encode(text, add_special_tokens=False).ids
            want.append((d, ids, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())))
        assert rows(bpe_codec.encode_documents(frame, public.path("byte_bpe_50k.json"))) == sorted(want, key=str)


def test_bpe_codec_repairs_bad_cuts():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from locushift.llm import bpe_codec

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))

    class Anywhere(bpe_codec.ChunkCodec):
        def split(self, data):
            s = data.decode()
            return [s[i : i + 7] for i in range(0, len(s), 7)]

    for text in ("The quick brown fox   jumps over\n\n the lazy dog's 12345 tails" * 5, "a" * 100, "     x     " * 9, "word  word  " * 9):
        chunks = next(Anywhere(t).run([text.encode()]))
        assert ",".join(c.decimal for c in chunks) == ",".join(map(str, t.encode(text, add_special_tokens=False).ids))
        assert b"".join(c.decoded for c in chunks) == text.encode()


def fingerprint(text):
    from xxhash import xxh64_intdigest

    w = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(own, radius=3):
    label = {f: f for f in own}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    fps = list(own)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                label[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_simhash(frames):
    from locushift.llm import simhash_dedup

    for frame in frames:
        own = [(d, fingerprint(t)) for d, t in texts(frame)]
        root = components({f for _, f in own})
        least = {}
        for d, f in own:
            if d is not None:
                least[root[f]] = min(d, least.get(root[f], d))
        want = [(d, f"{f:016x}", least.get(root[f])) for d, f in own]
        assert rows(simhash_dedup.report(frame)) == sorted(want, key=str)


def test_simhash_links_in_dense_groups(spark):
    import numpy as np

    from locushift.llm import simhash_dedup

    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, 40)
    fps = {int(c) ^ int(sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), replace=False))) for c in np.repeat(centres, 60)}
    fps |= {0, 1, 3, 7, 15, 31, 255}
    root = components({f for f in fps})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for tile in (16, 2048):
        found = dict(simhash_dedup.connected(simhash_dedup.links(frame, 3, tile=tile)).collect())
        groups = {}
        for f in fps:
            groups.setdefault(root[f], set()).add(f)
        for g in groups.values():
            assert {found.get(f, f) for f in g} == {min(g)}


def test_simhash_keeps_one(frames):
    from locushift.llm import simhash_dedup

    out = simhash_dedup.keep_one(frames[0])
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == frames[0].columns and {4, 6} <= ids and 5 not in ids and 1 not in ids


def removed_by_hand(frame):
    words_, bytes_ = [(d, t.encode().split()) for d, t in texts(frame)], [(d, t.encode()) for d, t in texts(frame)]
    by_words = [(d, len(w), sum(g), sha(b" ".join(x for x, o in zip(w, g) if not o))) for (d, w), g in zip(words_, repeated([w for _, w in words_], 35))]
    by_bytes = []
    for (d, b), g in zip(bytes_, repeated([b for _, b in bytes_], 200)):
        by_bytes.append((d, len(b), sum(g), sum(1 for i, x in enumerate(g) if x and not (i and g[i - 1])), sha(bytes(x for x, o in zip(b, g) if not o))))
    return sorted(by_words, key=str), sorted(by_bytes, key=str)


def test_hot_anchors(spark, monkeypatch):
    """Buckets are split again and again where they may hold two spans only; results stay the same."""
    from locushift.llm import anchors, substring_dedup, suffix_dedup

    texts_ = [f"{' '.join(f'a{i * j % 97}' for j in range(40))} {COMMON} {' '.join(f'b{i + j * j}' for j in range(20))}" for i in range(60)]
    texts_ += [f"{COMMON[:150]} {i} {'z ' * 40}{COMMON[20:140]} {i * i}" for i in range(20)]
    frame = made(spark, texts_ + texts_[:3])
    want = removed_by_hand(frame)
    assert (rows(substring_dedup.report(frame)), rows(suffix_dedup.report(frame))) == want
    monkeypatch.setattr(anchors, "MOST", 2)
    assert (rows(substring_dedup.report(frame)), rows(suffix_dedup.report(frame))) == want


def test_texts_of_few_symbols(spark):
    """Runs of one symbol, short periods, and texts over two letters; equal rows, ids and null ids beside them."""
    import random

    from locushift.llm import substring_dedup, suffix_dedup

    rng = random.Random(4)
    texts_ = ["a" * 3000, "ab" * 900 + "c", "x" + "a" * 260 + "y", "abc " * 400, "".join(rng.choice("ab") for _ in range(4000)), " ".join(rng.choice("ab") for _ in range(1500)), "q " * 33 + "q", "q " * 34 + "q", "a" * 199, "a" * 199]
    frame = made(spark, texts_).union(made(spark, texts_[4:8]))
    assert (rows(substring_dedup.report(frame)), rows(suffix_dedup.report(frame))) == removed_by_hand(frame)


def test_very_long_text(spark):
    """Ten million bytes of noise, in which one passage, a long run and a short period come again."""
    import random

    from locushift.llm import suffix_dedup

    rng = random.Random(8)
    noise = rng.randbytes(4_900_000).hex()
    passage = rng.randbytes(500).hex()
    parts = [noise[:3_000_000], passage, noise[3_000_000:7_000_000], "z" * 100_000, noise[7_000_000:9_000_000], "w" + passage + "w", noise[9_000_000:], "uvw" * 500]
    frame = spark.createDataFrame([(1, "".join(parts)), (2, None)], "doc_id long, text string")
    kept = "".join([parts[0], parts[2], parts[4], "ww", parts[6]])
    got = {r.doc_id: r for r in suffix_dedup.report(frame).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[1].kept_sha256) == (len("".join(parts)) - len(kept), 4, sha(kept.encode()))
    assert (got[2].n_bytes, got[2].n_removed, got[2].kept_sha256) == (0, 0, sha(b""))


def test_long_runs_are_few_spans(spark):
    import numpy as np

    from locushift.llm import anchors, suffix_dedup

    found = anchors.spans(made(spark, ["a" * 100_000, "abcdef" * 10_000]), suffix_dedup.byte_symbols, 200, 32)
    assert found.count() <= 4 and found.agg({"m": "max"}).first()[0] == 100_000 - 199
    text = np.frombuffer(b"a" * 100_000, np.uint8)
    h, place, first, last = anchors.anchored_spans(text, np.array([len(text)]), 200, 32)
    assert len(h) == 100_000 - 199 and len(set(h.tolist())) == 1
    some = anchors.anchored_spans(text, np.array([len(text)]), 200, 32, block=1000)
    assert all((x == y).all() for x, y in zip((h, place, first, last), some))


def test_near_groups_by_five_words(spark):
    import random

    from locushift.llm import simhash_dedup

    rng = random.Random(2)
    base = [[f"v{rng.randint(0, 5000)}" for _ in range(200)] for _ in range(40)]
    out = []
    for i, w in enumerate(base):
        out.append((i, " ".join(w)))
        for j in range(3):
            own = list(w)
            own[rng.randrange(200)] = f"new{j}"
            own[rng.randrange(200)] = f"newer{j}"
            out.append((100 + 3 * i + j, " ".join(own)))
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_groups(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(40)) and all(got[100 + 3 * i + j] == i for i in range(40) for j in range(3))


def test_near_groups_decide_by_exact_sets(spark):
    """Pairs at a Jaccard similarity of exactly 0.8 are groups, pairs at 0.794 are not; repeats don't count."""
    import random

    from locushift.llm import simhash_dedup

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rng, out = random.Random(5), []
    for i in range(80):
        a = [f"w{rng.randint(0, 9999)}" for _ in range(274)]
        b = [f"new{x}" if x % 40 == 20 and x < 240 else w for x, w in enumerate(a)]
        if i % 2:
            b[-1] = "last"
        x, y = shingles(a), shingles(b)
        assert len(x & y) / len(x | y) == (239 / 301 if i % 2 else 0.8)
        out += [(i, " ".join(a)), (100 + i, " ".join(b))]
    lines = [[f"w{rng.randint(0, 9999)}" for _ in range(12)] for _ in range(20)]
    out += [(90, " ".join(sum(lines, []))), (190, " ".join(sum(lines, []) + lines[-1] * 60))]
    for tile in (2048, 16):
        got = {r.doc_id: r.component_id for r in simhash_dedup.near_groups(spark.createDataFrame(out, "doc_id long, text string"), tile=tile).collect()}
        assert [i for i in range(0, 80, 2) if got[100 + i] != i] == [] and [i for i in range(1, 80, 2) if got[100 + i] != 100 + i] == [] and got[190] == 90


def test_keep_one_tells_rows_by_id_and_text(spark):
    import random

    from locushift.llm import simhash_dedup

    rng = random.Random(9)
    x, y, z, v = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(4))
    made_ = [(7, x, 0), (7, y, 1), (3, y, 2), (None, z, 3), (None, v, 4), (None, v, 5), (None, y, 6), (8, v + " end", 7), (9, None, 8), (9, "", 9), (11, z + " x y", 10), (11, z + " x y", 11)]
    frame = spark.createDataFrame(made_, "doc_id int, text string, row int")
    got = sorted((r.doc_id, r.text) for r in simhash_dedup.keep_one(frame).collect() if r.row < 8)
    assert got == sorted([(7, x), (3, y), (8, v + " end")]) and simhash_dedup.keep_one(frame).count() == 5
    got = sorted((r.doc_id or 0, r.text) for r in simhash_dedup.keep_one(frame.where("doc_id is null")).collect())
    assert got == sorted([(0, y), (0, z), (0, v)])
