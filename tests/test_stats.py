import numpy as np
import pytest
from pyspark.sql import functions as F

from locushift.operators import evaluate, resample, stats


def frame(spark, score, label, **more):
    rows = [(i, "chr1", i * 100, i * 100 + 50, float(s), bool(y), *[float(v[i]) if v[i] is not None else None for v in more.values()]) for i, (s, y) in enumerate(zip(score, label))]
    return spark.createDataFrame(rows, "ord long, chrom string, start_pos long, end_pos long, score double, label boolean" + "".join(f", {m} double" for m in more))


def test_auroc_cases(spark):
    one = lambda s, y: stats.auroc(frame(spark, s, y), "score").first().auroc
    assert one([1, 2, 3, 4], [0, 0, 1, 1]) == 1 and one([1, 1, 1, 1], [0, 1, 0, 1]) == 0.5 and one([1, 2], [0, 0]) is None
    rng = np.random.default_rng(1)
    s, y = np.round(rng.normal(size=400), 1), rng.random(400) < 0.3
    assert one(s, y) == pytest.approx(resample.auroc(s[y], s[~y]))
    assert np.isnan(resample.auroc(s[:0], s))


def test_quantiles_and_bins_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.exponential(size=500), 2)
    df = frame(spark, x, np.zeros(500))
    edges = stats.quantile_edges(df, "score", 20)
    want = np.unique(np.quantile(x, np.linspace(0, 1, 21)))
    assert edges == pytest.approx(want.tolist())
    bins = [r.b for r in df.select("ord", stats.bin_of(F.col("score"), edges).alias("b")).orderBy("ord").collect()]
    assert bins == np.digitize(x, want[1:-1]).tolist()
    assert stats.quantile_edges(frame(spark, [2, 2, 2], [0, 0, 1]), "score") == [2, 2 + 1e-9]


def test_matched_negatives(spark):
    rng = np.random.default_rng(3)
    c = rng.random(2000)
    y = rng.random(2000) < 0.1 * c
    df = frame(spark, c, y, confound=c)
    neg = stats.matched_negatives(df, "confound", seed=1)
    rows = neg.collect()
    assert len({r.ord for r in rows}) == len(rows) and not any(r.label for r in rows) and len(rows) == 3 * y.sum()
    assert abs(np.mean([r.confound for r in rows]) - c[y].mean()) < 0.05 < abs(c[~y].mean() - c[y].mean())
    again = stats.matched_negatives(df.repartition(7), "confound", seed=1)
    assert {r.ord for r in again.collect()} == {r.ord for r in rows} != {r.ord for r in stats.matched_negatives(df, "confound", seed=2).collect()}
    assert stats.random_negatives(df, 50).count() == 50


def test_first_by_key_is_exact(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 3 * 10 + 5).alias("want"))
    got = sorted((r.g, r.k) for r in stats.first_by_key(df, "g", "want", "k", salts=8).collect())
    all_ = sorted((r.g, r.k) for r in df.collect())
    assert got == sorted(x for g in range(3) for x in [y for y in all_ if y[0] == g][: g * 10 + 5])


def test_folds(spark):
    df = frame(spark, np.arange(100), np.arange(100) >= 90)
    assert stats.fold_enrichment(df, "score", 0.05).first().fold == pytest.approx(10)
    assert stats.fold_enrichment(df.withColumn("label", F.lit(False)), "score", 0.05).first().fold is None
    assert [(r.share, r.k, r.fold) for r in stats.fold_sweep(df, "score", [0.01, 0.2]).orderBy("share").collect()] == [(0.01, 1, 10), (0.2, 20, 5)]
    assert stats.take(50, 0.05) == 2 and stats.take(3, 0.01) == 1


def test_signs(spark):
    df = spark.createDataFrame([(0.5, 1), (-0.5, 1), (0.0, 1), (None, 1), (0.01, 1)], "direction double, expected int")
    r = stats.sign_accuracy(df).first()
    assert (r.accuracy, r.n_signed) == (pytest.approx(2 / 3), 3)
    rows = stats.accuracy_by_size(df).orderBy("bin").collect()
    assert [r.n for r in rows] == [1, 0, 0, 0, 0, 2] and rows[1].accuracy is None
    assert stats.sign_accuracy(df.where("direction = 0")).first().accuracy is None


def test_logistic_forms_agree(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 2))
    y = rng.random(800) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))
    beta, ll = resample.logistic(x, y.astype(float))
    df = spark.createDataFrame([(float(a), float(b), bool(v)) for (a, b), v in zip(x, y)], "a double, b double, y boolean")
    assert resample.logistic_frame(df, ["a", "b"], "y") == pytest.approx(beta, abs=1e-6) and ll < 0
    assert beta == pytest.approx([0.5, 1.0, -2.0], abs=0.5)


def planted(rng, n, extra, confounded=False):
    signed = rng.uniform(-1, 1, n)
    y = np.zeros(n, bool)
    up = np.flatnonzero(signed > 0)
    y[rng.choice(up, n // 12, replace=False, p=(signed[up] / signed[up].sum() if confounded else None))] = True
    return signed, y, signed + extra * y + rng.normal(0, 0.3, n)


@pytest.mark.parametrize("extra, wins", [(0.6, True), (0.0, False)])
def test_increment_over_the_baseline(spark, extra, wins):
    signed, y, driver = planted(np.random.default_rng(6), 3000, extra)
    df = frame(spark, driver, y, signed=signed).withColumnRenamed("score", "driver_score").cache()
    r = evaluate.against_baseline(df, n_boot=200, n_perm=100)
    assert (r["low"] > 0) == wins and (r["p"] < 0.05) == wins and r["n_pos"] == y.sum()
    from locushift.operators.gates import select_score

    assert select_score(r, "M").primary == ("M" if wins else "signed-Delta")


def test_confounded_score_loses_on_matched_negatives(spark):
    rng = np.random.default_rng(7)
    c = rng.random(4000)
    y = rng.random(4000) < 0.25 * c**2
    df = frame(spark, c + rng.normal(0, 0.05, 4000), y, confound=c).withColumnRenamed("score", "driver_score").cache()
    r = evaluate.against_positives(df, n_boot=200, n_perm=100)
    assert r["confound_gap"] > 0.1 and r["auroc"] < 0.6 and r["low"] <= r["auroc"] <= r["high"]
    with pytest.raises(ValueError):
        evaluate.kept(df, opening=True)


def test_genes_are_few(spark):
    genes = spark.createDataFrame([("g1", 3, 4)], "gene string, n_correct long, n_signed long")
    assert resample.gene_bootstrap(spark, genes) == {"accuracy": 0.75, "low": None, "high": None}
    with pytest.raises(ValueError):
        resample.collected(genes.union(genes), "gene", most=1)


def head(spark, shared, n=1500, dim=10, genes=6):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, dim))
    gene = [None] * n
    for i in range(genes * 20):
        gene[i] = f"g{i % genes}"
        x[i, 0 if shared else 1 + i % genes] += 3
    return spark.createDataFrame([(i, g is not None, g, [float(v) for v in x[i]]) for i, g in enumerate(gene)], "ord long, label boolean, gene string, features array<double>")


@pytest.mark.parametrize("shared", [True, False])
def test_heads_generalise_only_over_shared_signal(spark, shared):
    df = head(spark, shared)
    rows = resample.leave_one_gene_out(df).toPandas()
    assert len(rows) == df.count()
    auc = resample.auroc(rows.score[rows.label].to_numpy(), rows.score[~rows.label].to_numpy())
    assert (auc > 0.9) if shared else (auc < 0.7)
    with pytest.raises(ValueError):
        resample.leave_one_gene_out(df.where("gene is null or gene = 'g1'"))
    out = resample.transfer(df.where("ord % 2 = 0"), df)
    assert out.count() == df.where("ord % 2 = 1").count()


def test_principal_axes_match_svd(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 5)) * [5, 3, 1, 1, 1] + 7
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "ord long, vector array<double>")
    mean, axes, sd = resample.principal_axes(df, 2)
    z = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    got = np.array([r.pca for r in resample.projected(df, mean, axes, sd).orderBy("ord").collect()])
    want = z @ vt[:2].T / (z @ vt[:2].T).std(axis=0)
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8


def test_registered_queries_do_the_whole_job(spark, data, monkeypatch):
    """Panels that cover all rows, and as many draws as the operators make."""
    from locushift import catalog
    from locushift.operators import evaluate, resample

    panels, asked = [], []
    monkeypatch.setattr(resample, "transfer", lambda train, test, **k: panels.extend([train, test]))
    monkeypatch.setattr(evaluate, "against_positives", lambda df, **k: asked.append(k) or {"x": 1.0})
    monkeypatch.setattr(evaluate, "against_baseline", lambda df, **k: asked.append(k) or {"x": 1.0})
    catalog.QUERIES["transfer_scores"](spark, data)
    ids = [{r.ord for r in p.select("ord").collect()} for p in panels]
    assert not ids[0] & ids[1] and ids[0] | ids[1] == {r.ord for r in catalog.QUERIES["pca_features"](spark, data).collect()}
    for name in ("bootstrap_ci", "lr_test"):
        catalog.QUERIES[name](spark, data)
    assert asked == [{}, {}] and catalog.QUERIES["shuffle_null"](spark, data).count() == 1000


def test_signs_of_anchors_are_counted_once(spark, monkeypatch):
    """A region takes the gene of the first anchor by start; all figures come from counts by gene and size, written once."""
    from locushift.operators import evaluate
    from locushift.sources import scratch

    made, kept = [], scratch.kept
    monkeypatch.setattr(scratch, "kept", lambda df, name: made.append(kept(df, name)) or made[-1])
    rows = [(i, "a", 10 * i, 10 * i + 10, None if i % 5 == 0 else (0.0 if i % 7 == 0 else (i % 4 - 1.5) / 3)) for i in range(60)]
    anchors = [(0, "a", 0, 155, "g0"), (1, "a", 120, 420, "g1"), (2, "a", 130, 200, "g2"), (3, "a", 450, 500, None)]
    df = spark.createDataFrame(rows, "ord long, chrom string, start_pos long, end_pos long, direction double")
    named = spark.createDataFrame(anchors, "ord long, chrom string, start_pos long, end_pos long, gene string")
    out = evaluate.signs(df, named, named.where("ord = 2"), n_boot=50)
    hit = [(d, next(g for _, _, a, b, g in anchors if s < b and e > a)) for _, _, s, e, d in rows if d is not None and any(s < b and e > a for _, _, a, b, _ in anchors)]
    signed = [(d, g) for d, g in hit if g is not None and d != 0]
    assert (out["opening"]["n_signed"], out["opening"]["accuracy"], out["opening"]["n_genes"]) == (len(signed), sum(d > 0 for d, _ in signed) / len(signed), 2)
    closing = [d for _, _, s, e, d in rows if d and s < 200 and e > 130]
    assert out["closing"]["accuracy"] == sum(d < 0 for d in closing) / len(closing) and out["closing"]["low"] is None
    assert [(r["bin"], r["n"]) for r in out["opening"]["strata"]] == [(i, sum(a <= abs(d) < b for d, _ in signed)) for i, (a, b) in enumerate(zip(stats.EDGES, stats.EDGES[1:]))]
    assert [x.columns for x in made] == [["gene", "bin", "n_correct", "n_signed"]] * 2
    none = evaluate.signs(df, named.where("ord = 9"), named, n_boot=5)["opening"]
    assert (none["accuracy"], none["n_signed"], none["n_genes"], [r["n"] for r in none["strata"]]) == (None, 0, 0, [0] * 6)
