"""Resampling without a collected sample, against the same draws made row by row in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locushift.operators import draws, evaluate, order, resample


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    y = rng.random(600) < 0.3
    a, b = np.round(rng.normal(size=600) + 0.7 * y, 1), np.round(rng.normal(size=600) + 0.2 * y, 1)
    rows = [(i, bool(y[i]), float(a[i]), float(b[i])) for i in range(600)]
    return spark.createDataFrame(rows, "ord long, label boolean, a double, b double").repartition(3).cache(), y, a, b


def column(df, name):
    return np.array([r[name] for r in df.orderBy("id").collect()], float)


def test_ranges_add_up(sample):
    """Counts that are left as they are give the sample's own figure, however many ranges hold them."""
    df, y, a, _ = sample

    def as_it_is(rng, p, q, n_pos, n_neg):
        assert (n_pos, n_neg) == (p.sum(), q.sum())
        return p, q

    assert column(draws.by_counts(df, "a", 3, 0, as_it_is), "auroc") == pytest.approx([resample.auroc(a[y], a[~y])] * 3, abs=1e-12)


@pytest.mark.parametrize("ranges", [1, 16, 128])
def test_draws_spread_like_draws_of_rows(sample, monkeypatch, ranges):
    df, y, a, _ = sample
    monkeypatch.setattr(order, "BUCKETS", ranges)
    rng, p, q = np.random.default_rng(4), a[y], a[~y]
    got = column(draws.bootstrap_auroc(df, "a", 600), "auroc")
    want = np.array([resample.auroc(rng.choice(p, len(p)), rng.choice(q, len(q))) for _ in range(600)])
    assert abs(got.mean() - want.mean()) < 0.005 and abs(got.std() / want.std() - 1) < 0.15
    got = column(draws.label_shuffle(df, "a", 600), "auroc")
    want = np.array([resample.auroc(a[s], a[~s]) for s in (rng.permutation(y) for _ in range(600))])
    assert abs(got.mean() - 0.5) < 0.005 and abs(got.std() / want.std() - 1) < 0.15
    again = column(draws.label_shuffle(df.repartition(7), "a", 600), "auroc")
    assert (got == again).all()


def test_paired_draws_against_weighted_rows(sample, monkeypatch):
    df, y, a, b = sample
    monkeypatch.setattr(draws, "CELLS", 200)  # draws in several steps
    key = np.array([r[0] for r in df.select("ord", F.xxhash64(F.lit(5), "ord").alias("k")).orderBy("ord").select("k").collect()])
    got, w = column(draws.paired_bootstrap(df, "a", "b", 40, 5), "delta"), draws.times(key, np.arange(40))

    def weighted(x, w):
        won = (x[y][:, None] > x[~y][None]) + 0.5 * (x[y][:, None] == x[~y][None])
        return w[y] @ won @ w[~y] / (w[y].sum() * w[~y].sum())

    assert got == pytest.approx([weighted(a, w[:, i]) - weighted(b, w[:, i]) for i in range(40)], abs=1e-12)
    many = draws.times(np.random.default_rng(6).integers(-(1 << 63), 1 << 63, 50_000), np.arange(4))
    assert abs(many.mean() - 1) < 0.02 and abs(many.var() - 1) < 0.03 and abs(np.corrcoef(many.T) - np.eye(4)).max() < 0.02


def test_permuted_fits_against_fits_of_rows(sample):
    df, y, a, b = sample
    z = lambda v: (v - v.mean()) / v.std()
    ll, beta = draws.permuted_fits(df, "b", "a", 12, seed=2)
    assert ll[0] == pytest.approx(resample.logistic(z(b)[:, None], y.astype(float))[1], abs=1e-8)
    for i in range(1, 14):
        d = z(a) if i == 1 else z(a)[np.random.default_rng([2, i, 0]).permutation(len(a))]
        own, found = resample.logistic(np.column_stack([z(b), d]), y.astype(float))
        assert beta[i] == pytest.approx(own, abs=1e-7) and ll[i] == pytest.approx(found, abs=1e-8)


@pytest.mark.parametrize("block", [100, 1 << 17])
def test_likelihood_ratio_by_blocks(sample, block):
    df = sample[0]
    assert draws.likelihood_ratio(df, "b", "a", 60, block=block)["p"] == pytest.approx(1 / 61)
    noise = df.withColumn("n", F.rand(11))
    assert draws.likelihood_ratio(noise, "b", "n", 60, block=block)["p"] > 0.03
    flat = draws.likelihood_ratio(df.withColumn("n", F.lit(2.0)), "b", "n", 5, block=block)
    assert flat["lr"] == pytest.approx(0, abs=1e-9) and flat["coef"] == 0


def test_one_class_only(sample):
    df = sample[0].where("label")
    assert all(r.auroc is None for r in draws.bootstrap_auroc(df, "a", 5).collect())
    assert all(r.delta is None for r in draws.paired_bootstrap(df, "a", "b", 5).collect())
    with pytest.raises(SystemExit):
        evaluate.classes(df)
