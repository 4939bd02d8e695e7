import numpy as np
import pytest
from pyspark.sql import functions as F

from locushift.operators import gates, nominate


def matrix(spark, values, n_a=3):
    return spark.createDataFrame([(i, j, j < n_a, float(v)) for i, row in enumerate(values) for j, v in enumerate(row)], "ord long, sample int, is_a boolean, value double")


def planted(effect, n=800, samples=6, seed=0):
    rng = np.random.default_rng(seed)
    contrast = rng.normal(size=n)[:, None] * np.where(np.arange(samples) < samples / 2, 1, -1)
    return np.exp(rng.normal(3, 1, n)[:, None] + effect * contrast + rng.normal(0, 0.1, (n, samples)))


def reference(values, n_a, most):
    cpm = np.log1p(values / np.where(values.sum(axis=0) == 0, 1, values.sum(axis=0)) * 1e6)
    top = cpm[np.argsort(-cpm.mean(axis=1), kind="stable")[:most]]
    c = np.corrcoef(top.T)
    same = np.equal.outer(np.arange(len(c)) < n_a, np.arange(len(c)) < n_a)
    upper = np.triu(np.ones_like(c, bool), 1)
    s = np.linalg.svd(top - top.mean(axis=1, keepdims=True), compute_uv=False) ** 2
    return c[upper & same].mean() - c[upper & ~same].mean(), s[0] / s.sum()


def test_gate1_matches_numpy_and_decides(spark):
    for effect, admitted in ((1.0, True), (0.0, False)):
        v = planted(effect)
        a = gates.admissibility(matrix(spark, v))
        coherence, pc1 = reference(v, 3, 50_000)
        assert a.coherence_margin == pytest.approx(coherence) and a.pc1_frac == pytest.approx(pc1)
        assert a.admit == admitted == (not a.reasons) and a.universe_truncated and a.universe_n == 800
    v = planted(1.0)
    a = gates.admissibility(matrix(spark, v), universe=300)
    assert (a.coherence_margin, a.pc1_frac) == pytest.approx(reference(v, 3, 300)) and not a.universe_truncated


def test_gate1_over_all_regions(spark, monkeypatch):
    monkeypatch.setattr(gates, "UNIVERSE", 300)
    v = planted(1.0)
    a = gates.admissibility(matrix(spark, v), universe=None)
    assert (a.coherence_margin, a.pc1_frac) == pytest.approx(reference(v, 3, 800)) and a.universe_n == 800 and not a.universe_truncated
    assert gates.admissibility(matrix(spark, v[:200]), universe=None).universe_truncated


def test_gate1_is_steady(spark):
    v = planted(1.0)
    base = gates.admissibility(matrix(spark, v), universe=800)
    padded = gates.admissibility(matrix(spark, np.vstack([v, np.zeros((1500, 6))])), universe=800)
    assert padded.pc1_frac == pytest.approx(base.pc1_frac)
    scaled = v.copy()
    scaled[:, 0] *= 10
    assert gates.admissibility(matrix(spark, scaled), universe=800).pc1_frac == pytest.approx(base.pc1_frac, abs=1e-3)


def test_gate1_needs_replicates(spark):
    a = gates.admissibility(matrix(spark, planted(1.0)[:, :2], n_a=1))
    assert not a.admit and "replicates" in a.reasons[0] and a.coherence_margin is None


ADMIT, REJECT = {"admit": True}, {"admit": False, "reasons": ["low PC1"]}
MODEL, SIGNED = {"primary": "GET"}, {"primary": "signed-Delta"}


@pytest.fixture(scope="module")
def weights(spark):
    return spark.range(1000).select(F.col("id").alias("ord"), F.lit("chr1").alias("chrom"), (F.col("id") * 100).alias("start_pos"), (F.col("id") * 100 + 50).alias("end_pos"), (F.col("id") / 999).alias("driver_score"), ((1000 - F.col("id")) / 1000 * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("direction")).cache()


@pytest.mark.parametrize("gate1, gate2, word", [(None, MODEL, "Gate 1 has not"), (REJECT, MODEL, "low PC1"), (ADMIT, None, "Gate 2 has not"), (None, None, "Gate 1 has not")])
def test_refusals(weights, gate1, gate2, word):
    rows, block = nominate.nominated(weights, gate1, gate2)
    assert rows.count() == 0 and rows.columns[3] == "rank" and word in block.pop("refusal_reason")
    assert block == {"score_source": None, "score_norm": None, "top_frac": None, "n_nominated": 0, "refused": True}


def test_primary_scores(weights):
    rows, block = nominate.nominated(weights, ADMIT, MODEL)
    assert [r.start_pos for r in rows.orderBy("rank").collect()] == [99900 - 100 * i for i in range(10)] and block == {"score_source": "GET", "score_norm": "rank", "top_frac": 0.01, "n_nominated": 10, "refused": False, "refusal_reason": None}
    rows, block = nominate.nominated(weights, ADMIT, SIGNED)
    assert [r.start_pos for r in rows.orderBy("rank").collect()] == [100 * i for i in range(10)] and block["score_norm"] == "rank" and block["score_source"] == "signed-Delta"
    assert nominate.stray(rows, weights) == 0


def test_unmeasured_rows_are_never_signed(weights):
    half = weights.withColumn("direction", F.when(F.col("ord") % 2 == 0, F.col("direction")))
    rows, block = nominate.nominated(half, ADMIT, SIGNED, 0.011)
    assert block["n_nominated"] == 6 and all(r.direction is not None for r in rows.collect())
    with pytest.raises(ValueError):
        nominate.nominated(half.withColumn("direction", F.lit(None).cast("double")), ADMIT, SIGNED)


def test_ranks_are_dense_under_ties(weights):
    tied = weights.withColumn("driver_score", F.round("driver_score", 1))
    rows = nominate.nominated(tied, ADMIT, MODEL)[0].orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11)) and [r.start_pos for r in rows] == sorted(r.start_pos for r in rows)


def test_provenance_ignores_case():
    assert nominate.provenance("get", {"GET": "x"}) == "x" and nominate.provenance("get", {}) is None and nominate.provenance("epiagent") == "predicted-model-native"


def test_score_selection_gives_its_reason():
    base = {"delta": 0.17, "low": 0.08, "high": 0.26, "lr": 18.6, "p": 0.001, "coef": 0.67}
    won = gates.select_score(base)
    assert won.primary == "GET" and won.delta_auroc_ci == [0.08, 0.26] and "interval +0.080 to +0.260" in won.reason and "p 0.001" in won.reason
    lost = gates.select_score(base | {"low": -0.1, "coef": -0.67})
    assert lost.primary == "signed-Delta" and "adds nothing" in lost.reason
    assert gates.select_score(base | {"low": None, "p": None}).primary == "signed-Delta"
