import hashlib
from collections import Counter

import numpy as np

from locushift.llm import weighted_fingerprint as W


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_collisions_follow_weighted_jaccard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    off = []
    for _ in range(40):
        a, b = (np.repeat(base, rng.integers(0, 6, 60)) for _ in range(2))
        got = (W.elements(W.weighted(a)) == W.elements(W.weighted(b))).mean()
        off.append(got - jaccard(a.tolist(), b.tolist()))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.09


def test_report(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    for frame, own in ((docs, rows), (docs.limit(1), None)):
        own = own or [(r.doc_id, r.text) for r in frame.collect()]
        got = {r.doc_id: r for r in W.report(frame, rows=32).collect()}
        assert len(got) == len(own)
        for i, (d, text) in enumerate(own):
            following = own[(i + 1) % len(own)][1]
            half = len(text) // 2
            changed = text[: len(text) - half] + following[:half]
            r = got[d]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
            whole = [W.weighted(W.shingles(x.encode())) for x in (text, changed, following)]
            a, b, c = map(W.elements, whole)
            assert (r.fingerprint, r.edited_fingerprint) == (a.tobytes().hex(), b.tobytes().hex())
            assert (r.near_edited, r.near_next) == ((a == b).mean(), (a == c).mean())


def test_odd_rows(spark):
    rows = [(3, None), (3, None), (2, ""), (None, "a b"), (None, "a b"), (1, "x " * 9), (0, "w"), (0, "w2")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, r string")
    got = W.report(frame, rows=1).collect()
    assert len(got) == len(rows)
    assert {r.fingerprint for r in got if r.doc_id == 3} == {r.fingerprint for r in got if r.doc_id == 2}
    assert W.report(frame.where("false")).count() == 0
