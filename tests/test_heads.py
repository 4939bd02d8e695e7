"""Heads on shift vectors against fits made fold by fold in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locushift.operators import evaluate, resample

HEAD = "ord long, label boolean, gene string, features array<double>"


def made(n=900, genes=5, seed=3, nameless=40):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    gene = [f"g{i % genes}" if i < 100 else "" if i < 100 + nameless // 2 else None for i in range(n)]
    label = np.arange(n) < 100 + nameless
    x[label] += [0.8, -0.5, 0]
    return x, label, gene


def frame(spark, x, label, gene):
    return spark.createDataFrame([(i, bool(y), g if y else None, [float(v) for v in r]) for i, (r, y, g) in enumerate(zip(x, label, gene))], HEAD)


def test_each_fold_equals_a_fit_in_memory(spark):
    x, label, gene = made()
    rows, n = resample.gene_folds(frame(spark, x, label, gene).repartition(3))
    fold = {r.ord: r.fold for r in rows.select("ord", "fold").collect()}
    assert n == 5 and all(fold[i] == -1 for i in range(100, 140)) and {fold[i] for i in range(140, 900)} == set(range(5))
    got = {r.ord: r.score for r in resample.leave_one_gene_out(frame(spark, x, label, gene)).collect()}
    assert set(got) == set(range(900)) - set(range(100, 140))  # positives without a gene are learned from, not scored
    own = np.array([fold[i] for i in range(900)])
    for g in range(5):
        beta, _ = resample.logistic(x[own != g], label[own != g].astype(float))
        for i in np.flatnonzero(own == g):
            assert got[i] == pytest.approx(beta[0] + x[i] @ beta[1:], abs=1e-6)


def test_transfer_equals_a_fit_in_memory(spark):
    x, label, gene = made(seed=4)
    df = frame(spark, x, label, gene)
    got = {r.ord: r.score for r in resample.transfer(df.where("ord % 3 < 2"), df.where("ord % 2 = 0")).collect()}
    train = np.arange(900) % 3 < 2
    beta, _ = resample.logistic(x[train], label[train].astype(float))
    assert set(got) == {i for i in range(0, 900, 2) if not train[i]}
    assert all(s == pytest.approx(beta[0] + x[i] @ beta[1:], abs=1e-6) for i, s in got.items())
    with pytest.raises(ValueError):
        resample.transfer(df.where("label"), df)


def claim(spark, shared, n=2500, seed=6):
    rng = np.random.default_rng(seed)
    signed = rng.uniform(0.01, 1, n)
    vector = rng.normal(size=(n, 12))
    chosen = rng.choice(n, 240, replace=False, p=signed / signed.sum())
    gene, second = [None] * n, np.zeros(n, bool)
    for i, j in enumerate(chosen):
        panel = i % 2
        if panel:
            second[j] = True
        else:
            gene[j] = f"g{i % 8}"
        vector[j, 0 if shared or not panel else 5] += 4
    rows = [(i, "chr1", i * 10, i * 10 + 5, [float(v) for v in vector[i]], float(rng.random()), float(signed[i]), gene[i] is not None, bool(second[i]), gene[i]) for i in range(n)]
    return spark.createDataFrame(rows, "ord long, chrom string, start_pos long, end_pos long, vector array<double>, driver_score double, signed double, label boolean, second boolean, gene string")


def test_transfer_leaves_out_all_training_regions(spark):
    df = claim(spark, True).withColumn("second", F.col("second") | (F.col("label") & (F.col("ord") % 2 == 0)))  # panels share positives
    rows = resample.head_features(df, 4).drop("vector").cache()
    train = evaluate.matched_sample(rows.withColumn("_size", F.abs("signed")), "_size")
    used = {r.ord for r in train.select("ord").collect()}
    out = evaluate.head_scores(rows, "second").collect()
    assert out and not used & {r.ord for r in out}
    assert sum(r.label for r in out) == df.where("second").where(~F.col("ord").isin(list(used))).count()


@pytest.mark.parametrize("shared", [True, False])
def test_heads_transfer_shared_directions_only(spark, shared):
    df = claim(spark, shared).cache()
    panel = evaluate.heads(df, 8, test="second", n_boot=200)
    assert panel["beats_both"] == shared and (panel["auroc_head"] > 0.8 if shared else panel["auroc_head"] < 0.65)
    if shared:
        genes = evaluate.heads(df, 8, n_boot=200)
        assert genes["beats_both"] and genes["n_pos"] == 120 and genes["low_driver"] <= genes["delta_driver"] <= genes["high_driver"]


def test_a_newton_round_runs_few_tasks_whatever_made_the_sample(spark, monkeypatch):
    """A cached sample has the partitions of the shuffle before it, each a Python task of every round."""
    tasks, sums = [], resample.newton_sums
    monkeypatch.setattr(resample, "newton_sums", lambda sample, *rest: tasks.append(sample.rdd.getNumPartitions()) or sums(sample, *rest))
    df = frame(spark, *made(n=300)).repartition(40)
    assert resample.leave_one_gene_out(df).count() == 260
    assert resample.transfer(df.where("ord % 3 < 2"), df).count() == 100
    assert len(tasks) > 4 and max(tasks) < 10
