"""Centroid clustering: Lloyd's rounds by dual trees, exact in integers.

Vectors stay where they were read: each block of up to ``BLOCK`` of them grows a cover tree of its own, once, and the
trees are written as a table (one row a block). A node covers a run of points around one of them, its centre; the
centres of its children lie more than half its radius apart and cover their points within that half. Each round grows
such a tree over the centroids, too, and walks both together: a pair of nodes goes once no centroid below the one can
be nearest to any vector below the other. A vector node that one centroid is left for is counted as a whole, from
prefix sums; what remains at the leaves is compared exactly. A round moves one row a centroid and task, and the driver
holds the centroids alone. No vector is shuffled, so that neither a vector that a third of all rows share nor a very
large cluster makes one task longer.

Defined results: a vector of another length, with a null or with a component that is not finite is left out, and so is
one with a component whose integer is beyond 2**27 in size (its distances would not fit a long); a null id hashes as
none, so it comes last among the candidates for a start; rows that share an id and a hash start in the order of their
components; equal vectors get equal clusters and each row its own result; with fewer vectors than ``k`` there are as
many centroids as vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH, materialize

BLOCK = 1024
LEAF = 16
MOST = 1 << 27
#: Bounds are compared with this much room, far more than the rounding of a square root.
ROOM = 1e-9
TREE = "ids array<bigint>, points array<int>, first array<int>, after array<int>, centre array<int>, radius array<double>, child array<int>, children array<int>"


@contextmanager
def batches_of(spark, rows: int):
    """Arrow batches of ``rows`` rows for the actions within."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


class Tree:
    """A cover tree: ``points`` in tree order, and for each node the run of points, the centre and the children."""

    def __init__(self, points, order, first, after, centre, radius, child, children):
        self.points, self.order, self.first, self.after, self.centre, self.radius, self.child, self.children = points, order, first, after, centre, radius, child, children


def grow(points: np.ndarray, leaf: int) -> Tree:
    """A node is split while it has over ``leaf`` points that are not all equal."""
    n, real = len(points), points.astype(np.float64)
    order = np.empty(n, np.int64)
    nodes: list[tuple[int, int, int, float, int, int]] = []

    def away(own: np.ndarray, c: int) -> np.ndarray:
        d = real[own] - real[c]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    queue = [(np.arange(n), away(np.arange(n), 0), 0)] if n else []
    for own, dist, at in queue:  # grows while it is read; the first of own is the centre
        radius = float(dist.max())
        if len(own) <= leaf or radius == 0:
            order[at : at + len(own)] = own
            nodes.append((at, at + len(own), int(own[0]), radius, 0, 0))
            continue
        begin = len(queue)
        near, place = dist <= radius / 2, at
        while len(own):
            queue.append((own[near], dist[near], place))
            place += int(near.sum())
            own = own[~near]
            if len(own):
                dist = away(own, int(own[0]))
                near = dist <= radius / 2
        nodes.append((at, place, int(queue[begin][0][0]), radius, begin, len(queue) - begin))
    first, after, centre, radius, child, children = (np.array(x) for x in zip(*nodes, strict=True)) if nodes else [np.empty(0, np.int64)] * 6
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    return Tree(points[order], order, first, after, where[centre], radius, child, children)


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), then those of the next run."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def nearest(tree: Tree, cents: Tree, number: np.ndarray, most_pairs: int = 1 << 16) -> tuple[np.ndarray, ...]:
    """(node, centroid) of nodes that go to one centroid as a whole; (point, centroid) of all other points; and how many
    exact comparisons of a point with a centroid that took. number: the centroids' numbers, in tree order."""
    bound = np.full(len(tree.first), np.inf)
    q, r = np.zeros(min(1, len(bound)), np.int64), np.zeros(min(1, len(bound)), np.int64)
    whole, exact = [], []
    while len(q):
        d = tree.points[tree.centre[q]] - cents.points[cents.centre[r]]
        dist = np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64))
        np.minimum.at(bound, q, dist + tree.radius[q])
        keep = dist - tree.radius[q] - cents.radius[r] <= bound[q] * (1 + ROOM) + ROOM
        q, r = q[keep], r[keep]
        alone = (np.bincount(q, minlength=len(bound))[q] == 1) & (cents.after[r] - cents.first[r] == 1)
        whole.append((q[alone], cents.first[r[alone]]))
        q, r = q[~alone], r[~alone]
        # The larger node of a pair is split; a vector node only once none of its pairs waits for a centroid node's split.
        split = (cents.children[r] > 0) & ((cents.radius[r] >= tree.radius[q]) | (tree.children[q] == 0))
        waits = np.bincount(q, split, minlength=len(bound))[q] > 0
        down = ~waits & (tree.children[q] > 0)
        done = ~waits & ~down
        exact.append((q[done], r[done]))
        stay = waits & ~split
        below_r, below_q = cents.children[r[split]], tree.children[q[down]]
        bound[runs(tree.child[q[down]], below_q)] = np.repeat(bound[q[down]], below_q)
        q, r = (
            np.concatenate([q[stay], np.repeat(q[split], below_r), runs(tree.child[q[down]], below_q)]),
            np.concatenate([r[stay], runs(cents.child[r[split]], below_r), np.repeat(r[down], below_q)]),
        )
    q, r = (np.concatenate(x) for x in zip(*exact, strict=True)) if exact else (np.empty(0, np.int64),) * 2
    # Members of a centroid leaf (more than one where centroids are equal), then points of the vector leaf.
    size = cents.after[r] - cents.first[r]
    q, c = np.repeat(q, size), runs(cents.first[r], size)
    by = np.argsort(q, kind="stable")
    q, c = q[by], c[by]
    size = tree.after[q] - tree.first[q]
    ends, points, found, start, compared = np.cumsum(size), [], [], 0, int(size.sum())
    while start < len(q):
        stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_pairs, "right")), start + 1)
        stop = int(np.searchsorted(q, q[stop - 1], "right"))  # all pairs of a leaf together
        p, k = runs(tree.first[q[start:stop]], size[start:stop]), np.repeat(c[start:stop], size[start:stop])
        d = tree.points[p] - cents.points[k]
        d = np.einsum("ij,ij->i", d, d)
        own, p = np.unique(p, return_inverse=True)
        least, best = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), len(number))
        np.minimum.at(least, p, d)
        ties = d == least[p]
        np.minimum.at(best, p[ties], number[k[ties]])
        points.append(own)
        found.append(best)
        start = stop
    nodes, wholly = (np.concatenate(x) for x in zip(*whole, strict=True)) if whole else (np.empty(0, np.int64),) * 2
    none = np.empty(0, np.int64)
    return nodes, number[wholly], np.concatenate(points or [none]), np.concatenate(found or [none]), compared


def integers(df: DataFrame, ids: str, vector: str, dims: int, scale: int) -> DataFrame:
    """id, v: the vectors kept, as integers."""
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fine = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < MOST))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(ids).cast("long").alias("id"), v.alias("v"))


def trees(vectors: DataFrame, dims: int) -> DataFrame:
    """One row a block of vectors: their ids and integers in tree order, and the nodes of their cover tree."""
    names = [x.split()[0] for x in TREE.split(", ")]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.float64()), *[pa.list_(pa.int32())] * 2]

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                points = own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                t = grow(points, LEAF)
                ids = own.column("id").take(pa.array(t.order))
                lists = [t.points.ravel().astype(np.int32), t.first, t.after, t.centre, t.radius, t.child, t.children]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([ids.to_pylist(), *lists], kinds, strict=True)], names=names)

    return vectors.mapInArrow(work, TREE)


def trees_of(batch: pa.RecordBatch, dims: int):
    """(ids, tree) of each block."""
    for i in range(batch.num_rows):
        points, *nodes = (batch.column(x)[i].values.to_numpy(zero_copy_only=False) for x in ("points", "first", "after", "centre", "radius", "child", "children"))
        points = points.astype(np.int64).reshape(-1, dims)
        yield batch.column("ids")[i].values, Tree(points, None, *[x if x.dtype == np.float64 else x.astype(np.int64) for x in nodes])


def round_sums(blocks: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, tuple[int, list[int]]]:
    """By centroid that has any: its number of vectors and their sums. At most one row a centroid and task is shuffled."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64())] + [(f"s{j}", pa.int64()) for j in range(dims)])
    given = np.array(centroids, np.int64).reshape(-1, dims)

    def work(batches):
        cents = grow(given, 1)
        n, sums = np.zeros(len(given), np.int64), np.zeros((len(given), dims), np.int64)
        for batch in batches:
            for _, tree in trees_of(batch, dims):
                node, whole, point, cluster, _ = nearest(tree, cents, cents.order)
                prefix = np.concatenate([np.zeros((1, dims), np.int64), np.cumsum(tree.points, 0)])
                first, after = tree.first[node], tree.after[node]
                np.add.at(n, whole, after - first)
                np.add.at(sums, whole, prefix[after] - prefix[first])
                np.add.at(n, cluster, 1)
                np.add.at(sums, cluster, tree.points[point])
        own = np.flatnonzero(n)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), *[pa.array(np.ascontiguousarray(sums[own, j])) for j in range(dims)]], schema=schema)

    parts = blocks.mapInArrow(work, "cluster int, n long, " + ", ".join(f"s{j} long" for j in range(dims)))
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(dims)]).collect()
    return {r[0]: (r[1], list(r[2:])) for r in rows}


def members(blocks: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """id, cluster, distance (squared) of every vector."""
    given = np.array(centroids, np.int64).reshape(-1, dims)

    def work(batches):
        cents = grow(given, 1)
        for batch in batches:
            for ids, tree in trees_of(batch, dims):
                node, whole, point, cluster, _ = nearest(tree, cents, cents.order)
                out = np.empty(len(tree.points), np.int64)
                size = tree.after[node] - tree.first[node]
                out[runs(tree.first[node], size)] = np.repeat(whole, size)
                out[point] = cluster
                d = tree.points - given[out]
                yield pa.RecordBatch.from_arrays([ids, pa.array(out.astype(np.int32)), pa.array(np.einsum("ij,ij->i", d, d))], names=["id", "cluster", "distance"])

    return blocks.mapInArrow(work, "id long, cluster int, distance long")


def clusters(df: DataFrame, ids: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector kept, written to the shared folder, and the final centroids (k * dims integers)."""
    spark = df.sparkSession
    vectors = integers(df, ids, vector, dims, scale)
    start = vectors.orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k)
    centroids = [list(r.v) for r in start.collect()]
    with batches_of(spark, BLOCK):
        blocks = materialize(trees(vectors, dims), "kmeans-trees")
    with batches_of(spark, 8):
        for _ in range(rounds if centroids else 0):
            for c, (n, sums) in round_sums(blocks, centroids, dims).items():
                centroids[c] = [s // n for s in sums]
        return materialize(members(blocks, centroids, dims), "kmeans-members"), centroids


def report(df: DataFrame, k: int = 40, rounds: int = 5) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = clusters(df, k=k, rounds=rounds)
    inertia = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # a row a centroid
    own = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))]).cast("array<long>")
    sha = F.array(*[F.lit(hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for x in centroids]).cast("array<string>")
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(sha, F.col("cluster")).alias("centroid_sha256")
    )


def report_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256) -> str:
    """The same by SQL: one pair of tables a round."""
    steps = [
        f"v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x::DOUBLE * {scale}) < {MOST})) = {dims})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v AS m FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS (SELECT rid, min(p) AS p FROM (SELECT rid, {{'d': list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}} AS p FROM v CROSS JOIN c{i}) GROUP BY rid)"
        )
        if i < rounds:
            steps += [
                f"s{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.p.c AS c, unnest(range({dims})) AS j, unnest(v.v) AS x FROM v JOIN a{i} a USING (rid)) GROUP BY c, j)",
                f"c{i + 1} AS (SELECT c, coalesce(new, m) AS m FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS new FROM s{i} GROUP BY c) USING (c))",
            ]
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.p.c::INTEGER AS cluster, a.p.d AS distance, sum(a.p.d) OVER (PARTITION BY a.p.c)::BIGINT AS cluster_inertia,
       sum(a.p.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (rid) JOIN c{rounds} f ON f.c = a.p.c"""
