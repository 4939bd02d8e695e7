"""Resampling of samples of any size: bootstrap, shuffled labels, paired differences and permuted fits.

No sample is collected. A draw is split over ranges of the score (or blocks of rows) first, then within each; every task
makes the same split from the same generator, so results depend on the ranges and the seed alone. What reaches the driver
is a row a range (at most ``order.MOST_BUCKETS``) or a few numbers a draw.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import bucketed
from .resample import FLOOR, LOGIT, RIDGE, ROUNDS, SETTLED, standardised_columns

#: Rows whose driver values change places with each other; a larger sample is permuted within several such blocks.
BLOCK = 1 << 17
CELLS = 2_000_000
PARTS = "id long, _bucket int, won double, p double, q double"


def combined(parts: DataFrame, *keys: str) -> DataFrame:
    """keys, id and auroc from each range's drawn positives p, negatives q and twice the pairs won within it."""
    below = F.coalesce(F.sum("q").over(W.partitionBy(*keys, "id").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    pairs = parts.withColumn("won", F.col("won") + 2 * F.col("p") * below)
    return pairs.groupBy(*keys, "id").agg(F.try_divide(F.sum("won"), 2 * F.sum("p") * F.sum("q")).alias("auroc"))


def by_counts(sample: DataFrame, score: str, n: int, seed: int, draw) -> DataFrame:
    """id, auroc of n draws. ``draw(rng, p, q, n_pos, n_neg)`` shares positives and negatives out over places with the
    counts p and q: first over ranges of the score, then, in each range, over its distinct scores."""
    per = sample.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("x")).agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("q"))
    dealt = bucketed(per, "x")
    ranges = dealt.groupBy("_bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).orderBy("_bucket").collect()
    place = {r["_bucket"]: i for i, r in enumerate(ranges)}
    p_all, q_all = (np.array([r[c] for r in ranges], np.int64) for c in "pq")

    def work(key, f):
        import pandas as pd

        at, f = place[key[0]], f.sort_values("x")
        p, q, rows = f["p"].to_numpy(np.int64), f["q"].to_numpy(np.int64), []
        for i in range(n):
            share = draw(np.random.default_rng([seed, i]), p_all, q_all, int(p_all.sum()), int(q_all.sum()))
            a, b = draw(np.random.default_rng([seed, i, at + 1]), p, q, int(share[0][at]), int(share[1][at]))
            rows.append((i, key[0], float((a * (2.0 * (np.cumsum(b) - b) + b)).sum()), float(a.sum()), float(b.sum())))
        return pd.DataFrame(rows, columns=["id", "_bucket", "won", "p", "q"])

    return combined(dealt.repartition(max(1, len(ranges)), "_bucket").groupBy("_bucket").applyInPandas(work, PARTS))


def bootstrap_auroc(sample: DataFrame, score: str, n: int = 2000, seed: int = 0) -> DataFrame:
    """id, auroc: positives and negatives (``label``) drawn with replacement, each as many as there are.

    A draw of rows is a multinomial draw of the counts of distinct scores.
    """

    def draw(rng, p, q, n_pos, n_neg):
        return [rng.multinomial(m, c / c.sum()) if m else np.zeros(len(c), np.int64) for c, m in ((p, n_pos), (q, n_neg))]

    return by_counts(sample, score, n, seed, draw)


def label_shuffle(sample: DataFrame, score: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """id, auroc under shuffled labels: the positives among each distinct score's rows are a multivariate
    hypergeometric draw (which numpy makes for samples below 10**9 rows)."""

    def draw(rng, p, q, n_pos, n_neg):
        own = rng.multivariate_hypergeometric(p + q, n_pos, method="marginals")
        return own, p + q - own

    return by_counts(sample, score, n, seed, draw)


def times(key: np.ndarray, ids: np.ndarray, _cut=np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))) -> np.ndarray:
    """How often the rows with hash ``key`` (down) are drawn in the draws ``ids`` (across): Poisson with mean 1."""
    with np.errstate(over="ignore"):
        h = key.view(np.uint64)[:, None] + (ids.astype(np.uint64)[None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finaliser of splitmix64
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_cut, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, "right").astype(float)


def paired_bootstrap(sample: DataFrame, one: str, other: str, n: int = 2000, seed: int = 0) -> DataFrame:
    """id, delta: differences of two scores' AUROC under one resample for both.

    A row (by ``ord``) is drawn a Poisson number of times, a function of its hash and the draw, so that it is drawn alike
    wherever either score sorts it. Draws without positives or without negatives are NULL.
    """
    both = sample.where(F.col(one).isNotNull() & F.col(other).isNotNull()).select("label", F.xxhash64(F.lit(seed), "ord").alias("key"), F.col(one).cast("double").alias("x0"), F.col(other).cast("double").alias("x1"))
    dealt = [bucketed(both.select("label", "key", F.col(f"x{i}").alias("x")), "x").withColumn("which", F.lit(i)) for i in range(2)]

    def work(key, f):
        import pandas as pd

        f = f.sort_values("x", kind="stable")
        x, y, hashed = f["x"].to_numpy(), f["label"].to_numpy(bool)[:, None], f["key"].to_numpy(np.int64)
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        out, step = [], max(1, CELLS // len(x))
        for s in range(0, n, step):
            ids = np.arange(s, min(n, s + step))
            w = times(hashed, ids)
            p, q = (np.add.reduceat(np.where(c, w, 0.0), first, axis=0) for c in (y, ~y))
            out.append(pd.DataFrame({"which": key[0], "id": ids, "_bucket": key[1], "won": (p * (2 * (np.cumsum(q, axis=0) - q) + q)).sum(axis=0), "p": p.sum(axis=0), "q": q.sum(axis=0)}))
        return pd.concat(out)

    rows = dealt[0].union(dealt[1])
    parts = rows.repartition(2 * sample.sparkSession.sparkContext.defaultParallelism, "which", "_bucket").groupBy("which", "_bucket").applyInPandas(work, "which int, " + PARTS)
    return combined(parts, "which").groupBy("id").agg(F.sum(F.when(F.col("which") == 0, F.col("auroc")).otherwise(-F.col("auroc"))).alias("delta"))


def permuted_fits(sample: DataFrame, baseline: str, driver: str, n: int, seed: int = 0, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood and coefficients (intercept, baseline, driver) of logistic fits of ``label``: without the driver,
    with it, and n times with the driver permuted. Each Newton round is one aggregate for all fits that are still open.

    A permutation moves rows within blocks of about ``block`` rows, dealt by a hash of ``ord``: under the hypothesis that
    the driver adds nothing, all such orders are as likely. A sample of at most ``block`` rows is permuted as a whole.
    """
    spark = sample.sparkSession
    rows = standardised_columns(sample.select("ord", "label", F.lit(0.0).alias("_b"), F.lit(0.0).alias("_d"), baseline, driver), _b=F.col(baseline).cast("double"), _d=F.col(driver).cast("double"))
    blocks = max(1, -(-sample.count() // block))
    chunks = max(1, 2 * spark.sparkContext.defaultParallelism // blocks)
    dealt = rows.select("ord", F.col("label").cast("double").alias("y"), "_b", "_d", F.pmod(F.xxhash64(F.lit(seed), "ord"), F.lit(blocks)).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"))
    dealt = dealt.repartition(blocks * chunks, "_block", "_chunk").cache()
    beta, ll, open_ = np.zeros((n + 2, 3)), np.zeros(n + 2), np.arange(n + 2)
    upper = [(i, j) for i in range(3) for j in range(i, 3)]
    names = [*[f"g{i}" for i in range(3)], *[f"h{i}{j}" for i, j in upper], "ll"]

    def newton(beta, open_):
        def work(key, f):
            import pandas as pd

            f = f.sort_values("ord")
            y, b, d = (f[c].to_numpy(float) for c in ("y", "_b", "_d"))
            out = []
            for i in open_[open_ % chunks == key[1]]:
                own = np.zeros(len(d)) if i == 0 else d if i == 1 else d[np.random.default_rng([seed, int(i), int(key[0])]).permutation(len(d))]
                x = np.stack([np.ones(len(d)), b, own])
                p = 1 / (1 + np.exp(-np.clip(beta[i] @ x, -LOGIT, LOGIT)))
                h, safe = (x * np.maximum(p * (1 - p), FLOOR)) @ x.T, np.clip(p, 1e-12, 1 - 1e-12)
                out.append((int(i), *(x @ (y - p)), *[h[u] for u in upper], float((y * np.log(safe) + (1 - y) * np.log(1 - safe)).sum())))
            return pd.DataFrame(out, columns=["id", *names])

        parts = dealt.groupBy("_block", "_chunk").applyInPandas(work, "id long, " + ", ".join(f"{c} double" for c in names))
        return parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in names]).orderBy("id").toPandas()

    try:
        for _ in range(ROUNDS):
            sums = newton(beta, open_)
            at = sums["id"].to_numpy()
            if not len(at):
                break
            ll[at] = sums["ll"].to_numpy()
            h = np.zeros((len(at), 3, 3))
            for i, j in upper:
                h[:, i, j] = h[:, j, i] = sums[f"h{i}{j}"].to_numpy()
            g = sums[[f"g{i}" for i in range(3)]].to_numpy() - RIDGE * beta[at]
            step = np.linalg.solve(h + RIDGE * np.eye(3), g[:, :, None])[:, :, 0]
            beta[at] += step
            open_ = at[np.abs(step).max(axis=1) >= SETTLED]
            if not len(open_):
                break
    finally:
        dealt.unpersist()
    return ll, beta


def likelihood_ratio(sample: DataFrame, baseline: str, driver: str, n: int = 1000, seed: int = 0, block: int = BLOCK) -> dict:
    """What the driver adds to the baseline: LR statistic, coefficient, and p by permuting the driver."""
    ll, beta = permuted_fits(sample, baseline, driver, n, seed, block)
    lr = 2 * (ll[1:] - ll[0])
    return {"lr": float(lr[0]), "coef": float(beta[1, 2]), "p": float((1 + (lr[1:] >= lr[0]).sum()) / (n + 1))}
