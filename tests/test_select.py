"""Selection by histograms against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locushift.operators import prepare, select, stats


def values(kind, n=600, seed=1):
    rng = random.Random(seed)
    if kind == "spread":
        return [rng.uniform(-5, 5) for _ in range(n)]
    if kind == "ties":
        return [float(rng.randint(0, 4)) for _ in range(n)]
    if kind == "tails":
        return [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 308) for _ in range(n)]
    return [0.0, 1e-320, -1e308, 1e308, 1.0, 1.0 + 2**-52] * (n // 6)


@pytest.mark.parametrize("kind", ["spread", "ties", "tails", "odd"])
def test_kth_and_first_rows(spark, kind):
    rows = [(i, "abc"[i % 7 % 3], v) for i, v in enumerate(values(kind))] + [(1000, "a", None), (1001, "b", float("nan")), (1002, "d", 2.0)]
    df = spark.createDataFrame(rows, "ord long, g string, x double").repartition(3)
    k = {"a": 1, "b": 77, "c": 10_000, "d": 1, "e": 3}
    wanted = spark.createDataFrame(list(k.items()), "g string, _k int")
    by = {g: sorted(v for _, h, v in rows if h == g and v is not None and v == v) for g in k}
    got = {r.g: (r.value, r.below) for r in select.kth(df, ["g"], "x", wanted).collect()}
    assert got == {g: (by[g][n - 1], sum(v < by[g][n - 1] for v in by[g])) for g, n in k.items() if n <= len(by[g])}
    finite = df.where(F.col("x").isNotNull() & ~F.isnan("x"))
    got = sorted(tuple(r) for r in select.first_rows(finite, ["g"], "x", wanted.withColumnRenamed("_k", "_want")).collect())
    want = [r for g, n in k.items() for r in sorted((r for r in rows if r[1] == g and r[2] is not None and r[2] == r[2]), key=lambda r: (r[2], r[0]))[:n]]
    assert got == sorted(want)


def test_quantile(spark):
    rows = [(i, i % 3, v) for i, v in enumerate(values("spread"))] + [(5000, 9, 4.0)]
    got = {r.g: r.q for r in select.quantile(spark.createDataFrame(rows, "ord long, g int, x double"), ["g"], "x", 0.9, "q").collect()}
    assert got == pytest.approx({g: float(np.quantile([v for _, h, v in rows if h == g], 0.9)) for g in (0, 1, 2, 9)})


def negatives(spark, n=900):
    rng = random.Random(4)
    rows = [(i, f"chr{i % 3}", i * 10, i * 10 + 5, rng.random() < 0.1, rng.random()) for i in range(n)]
    return spark.createDataFrame(rows, "ord long, chrom string, start_pos long, end_pos long, label boolean, confound double")


def test_draws_are_those_of_the_windows(spark):
    df = negatives(spark).cache()
    ids = lambda x: sorted(r.ord for r in x.select("ord").collect())
    assert ids(stats.matched_negatives(df, "confound", small=-1)) == ids(stats.matched_negatives(df, "confound"))
    assert ids(stats.random_negatives(df, 120, small=-1)) == ids(stats.random_negatives(df, 120))
    assert ids(stats.random_negatives(df, 10_000, small=-1)) == ids(df.where("not label"))


def test_large_cells_are_cut_first(spark):
    rng = random.Random(6)
    weights = spark.createDataFrame([(i % 2, i // 2, float(rng.randint(0, 9))) for i in range(800)], "cell int, row long, value double")
    frequency = spark.createDataFrame([(i, i % 5 + 1, 100.0) for i in range(400)], "row long, n_docs long, n_total double")
    tokens = lambda **k: {r.cell: list(r.tokens) for r in prepare.sentences(weights, frequency, most=50, **k).collect()}
    assert tokens(small=10) == tokens() and all(len(x) == 50 for x in tokens().values())


def test_no_window_over_a_whole_group(spark, capsys):
    df = negatives(spark)
    stats.matched_negatives(df, "confound", small=-1).explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" not in plan and "row_number" not in plan
