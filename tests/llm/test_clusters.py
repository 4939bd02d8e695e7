"""Centroid clustering against plain Lloyd rounds over the same rows."""

import hashlib
import math

import numpy as np

from locushift.llm import dual_tree_kmeans as kmeans

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance double"


def lloyd(rows, k=40, rounds=5):
    """(vec_id, cluster, distance, ...) by brute force."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(float(np.float32(x)) * 256) < 2**27 for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(v) for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in set(own):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            cents[j] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    by = {j: sum(d for _, c, d in found if c == j) for _, j, _ in found}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, c, d, by[c], sum(by.values()), sha[c]) for i, c, d in found], key=str)


def got(spark, rows, schema=SCHEMA):
    frame = spark.createDataFrame([(i, v, 1, "clash", 0.5) for i, v in rows], schema)
    return sorted(map(tuple, kmeans.report(frame).collect()), key=str)


def vectors(n, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, 64))
    return [(i, (middle[i % 6] + spread * rng.normal(size=64)).tolist()) for i in range(n)]


def test_against_plain_lloyd(spark):
    rows = vectors(300, 1)
    assert got(spark, rows) == lloyd(rows)


def test_odd_rows(spark):
    rows = vectors(90, 2)
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(200)]  # a hot vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, same), (None, [0.5] * 64)]  # repeated rows and ids, null ids
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [None] + [1.0] * 63), (2005, [math.nan] * 64), (2006, [math.inf] + [0.0] * 63), (2007, [1e30] * 64)]
    rows += [(3000, [0.0] * 64), (3001, [-0.001] * 64), (3002, [500_000.0] * 64), (3003, [-500_000.0] * 64)]  # floor below zero, large components
    assert got(spark, rows) == lloyd(rows)


def test_ties_go_to_the_smaller_number_and_equal_centroids(spark):
    rows = [(i, [float((i // 2) % 3)] + [0.0] * 63) for i in range(60)]  # three places, so most of the 40 centroids are equal
    assert got(spark, rows) == lloyd(rows)


def test_few_and_no_vectors(spark):
    assert got(spark, vectors(3, 4)) == lloyd(vectors(3, 4))
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0])]) == []


def test_settings_are_restored(spark):
    before = spark.conf.get(kmeans.BATCH)
    got(spark, vectors(50, 5))
    assert spark.conf.get(kmeans.BATCH) == before


def test_cover_tree():
    points = np.random.default_rng(3).integers(-200, 200, (500, 64))
    points[100:150] = points[0]
    t = kmeans.grow(points, 8)
    assert sorted(t.order) == list(range(500)) and (t.points == points[t.order]).all()
    dist = lambda a, b: np.sqrt(((a - b) ** 2).sum(-1))
    for i in range(len(t.first)):
        own = t.points[t.first[i] : t.after[i]]
        assert dist(own, t.points[t.centre[i]]).max() <= t.radius[i] + 1e-6
        below = range(t.child[i], t.child[i] + t.children[i])
        centres = t.points[t.centre[list(below)]]
        for j, c in enumerate(below):
            assert t.radius[c] <= t.radius[i] / 2
            if j:
                assert dist(centres[:j], centres[j]).min() > t.radius[i] / 2


def test_most_comparisons_are_pruned():
    rng = np.random.default_rng(7)
    middle = rng.integers(-300, 300, (40, 64))
    points = (middle[rng.integers(0, 40, 1000)] + rng.integers(-8, 8, (1000, 64))).astype(np.int64)
    cents = kmeans.grow(middle.astype(np.int64), 1)
    t = kmeans.grow(points, kmeans.LEAF)
    node, whole, point, cluster, compared = kmeans.nearest(t, cents, cents.order)
    out = np.empty(1000, np.int64)
    size = t.after[node] - t.first[node]
    out[kmeans.runs(t.first[node], size)] = np.repeat(whole, size)
    out[point] = cluster
    assert (out == ((t.points[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)).all()
    assert compared < 1000 * 40 / 10
