"""Small models, heads and the bootstrap over genes, of which a genome has few (checked). See ``draws`` for samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

MOST_ROWS = 200_000


def collected(df: DataFrame, *columns: str, most: int = MOST_ROWS):
    """A sample as a pandas frame in a fixed order; refuses one that is too large to resample in memory."""
    rows = df.select(*columns).orderBy(*columns).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"the sample has over {most} rows; draw fewer negatives")
    return rows


def auroc(positive: np.ndarray, negative: np.ndarray) -> float:
    if not len(positive) or not len(negative):
        return float("nan")
    s = np.sort(negative)
    low, high = np.searchsorted(s, positive, "left"), np.searchsorted(s, positive, "right")
    return float((low + 0.5 * (high - low)).mean() / len(negative))


def replicates(spark, n: int, one: Callable[[np.random.Generator], tuple], schema: str, seed: int = 0, tasks: int = 8) -> DataFrame:
    """``one`` for replicate ids 0 to n - 1, each with its own generator, so results don't depend on the tasks."""

    def work(frames):
        import pandas as pd

        for f in frames:
            rows = [(int(i), *one(np.random.default_rng([seed, int(i)]))) for i in f["id"]]
            yield pd.DataFrame(rows, columns=["id", *[c.split()[0] for c in schema.split(", ")]])

    return spark.range(0, n, 1, tasks).mapInPandas(work, f"id long, {schema}")


def interval(draws: DataFrame, column: str) -> tuple[float | None, float | None]:
    """Central 95 % of the finite draws."""
    row = draws.where(~F.isnan(column)).agg(F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))).first()[0]
    return tuple(row) if row else (None, None)


def one_sided_p(draws: DataFrame, column: str, observed: float) -> float:
    row = draws.agg(F.count_if(F.col(column) >= observed).alias("k"), F.count(F.lit(1)).alias("n")).first()
    return (1 + row["k"]) / (row["n"] + 1)


RIDGE, ROUNDS, SETTLED, LOGIT, FLOOR = 1e-6, 100, 1e-9, 30.0, 1e-9


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on all coefficients; x gets an intercept in front. Coefficients, log likelihood."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -LOGIT, LOGIT)))
        w = np.maximum(p * (1 - p), FLOOR)
        step = np.linalg.solve((x.T * w) @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < SETTLED:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -LOGIT, LOGIT))), 1e-12, 1 - 1e-12)
    return beta, float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def logistic_frame(df: DataFrame, features: list[str], label: str, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """The same fit over a table of any size: each round is one aggregate of k + k (k + 1) / 2 sums."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(label).cast("double")
    k, beta = len(x), np.zeros(len(features) + 1)
    for _ in range(rounds):
        z = sum((v * float(b) for v, b in zip(x, beta, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(LOGIT)), F.lit(-LOGIT))))
        own = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)], (y - p).alias("e"), F.greatest(p * (1 - p), F.lit(FLOOR)).alias("w"))
        sums = own.agg(*[F.sum(F.col(f"x{i}") * F.col("e")).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge * np.eye(k)
        step = np.linalg.solve(h, np.array([sums[f"g{i}"] for i in range(k)]) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < SETTLED:
            break
    return beta


def gene_bootstrap(spark, genes: DataFrame, n: int = 2000, seed: int = 0) -> dict:
    """Accuracy with a clustered interval from (gene, n_correct, n_signed); NULL bounds for fewer than two genes."""
    rows = collected(genes, "gene", "n_correct", "n_signed")
    right, all_ = rows["n_correct"].to_numpy(float), rows["n_signed"].to_numpy(float)
    accuracy = right.sum() / all_.sum() if all_.sum() else None
    if len(rows) < 2:
        return {"accuracy": accuracy, "low": None, "high": None}

    def one(rng):
        at = rng.integers(len(right), size=len(right))
        return (float(right[at].sum() / all_[at].sum()) if all_[at].sum() else float("nan"),)

    draws = replicates(spark, n, one, "accuracy double", seed)
    mean = draws.where(~F.isnan("accuracy")).agg(F.avg("accuracy")).first()[0]
    low, high = interval(draws, "accuracy")
    return {"accuracy": mean, "low": low, "high": high}


# --- heads on shift vectors ---------------------------------------------------------------------------------------


def gram(df: DataFrame, vector: str = "vector") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (divided by n) of a vector column; partial sums per partition, added by Spark."""

    def work(frames):
        import pandas as pd

        total = None
        for f in frames:
            x = np.stack([np.asarray(v, float) for v in f[vector]]) if len(f) else None
            if x is not None:
                x = np.column_stack([np.ones(len(x)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    sums = df.select(vector).mapInPandas(work, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    m = sums.reshape(int(round(len(sums) ** 0.5)), -1)
    n = int(m[0, 0])
    mean = m[0, 1:] / n
    return n, mean, m[1:, 1:] / n - np.outer(mean, mean)


def principal_axes(df: DataFrame, k: int, vector: str = "vector") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, axes (dim, k) and the projections' population deviations; each axis's largest entry is positive."""
    _, mean, cov = gram(df, vector)
    value, axis = np.linalg.eigh(cov)
    axis = axis[:, ::-1][:, :k]
    axis = axis * np.sign(axis[np.abs(axis).argmax(axis=0), np.arange(axis.shape[1])])
    return mean, axis, np.sqrt(np.maximum(value[::-1][:k], 0))


def projected(df: DataFrame, mean: np.ndarray, axes: np.ndarray, sd: np.ndarray, vector: str = "vector", name: str = "pca") -> DataFrame:
    """Adds the scaled projections, as expressions."""
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    part = lambda j: F.aggregate(F.zip_with(F.col("_centred"), F.array(*[F.lit(float(a)) for a in axes[:, j]]), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x) / float(sd[j] or 1.0)
    return df.withColumn("_centred", centred).withColumn(name, F.array(*[part(j) for j in range(axes.shape[1])])).drop("_centred")


def standardised_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds each column less its mean, over its population deviation (1 if that is 0)."""
    own = df.withColumns(columns)
    stats = own.agg(*[f(k).alias(f"_{k}_{n}") for k in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    scaled = {k: (F.col(k) - F.col(f"_{k}_mean")) / F.coalesce(F.nullif(F.col(f"_{k}_sd"), F.lit(0.0)), F.lit(1.0)) for k in columns}
    return own.join(F.broadcast(stats)).withColumns(scaled).select(*own.columns)


def head_features(df: DataFrame, k: int, vector: str = "vector", signed: str = "signed", magnitude: bool = True) -> DataFrame:
    """Adds ``features``: the components of the shift, its standardised L2 norm (unless without magnitude) and the
    standardised signed value; scaling the components takes the size of a shift away, and the norm brings it back."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    own = standardised_columns(projected(df, *principal_axes(df, k, vector), vector=vector), _norm=norm, _signed=F.col(signed))
    return own.withColumn("features", F.concat("pca", F.array(*["_norm"] * magnitude, "_signed"))).drop("pca", "_norm", "_signed")


def newton_sums(sample: DataFrame, beta: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """A row for each of ``folds``: training positives, training rows, gradient and Hessian of its fit at its ``beta``, over
    all rows of other folds. Each batch takes all fits at once; a task hands on one row a fit and number."""
    k = beta.shape[1]

    def work(frames):
        import pandas as pd

        total = np.zeros((len(folds), 2 + k + k * k))
        for f in frames:
            if not len(f):
                continue
            x = np.column_stack([np.ones(len(f)), np.stack([np.asarray(v, float) for v in f["features"]])])
            y, out = f["label"].to_numpy(float), f["fold"].to_numpy()[:, None] == folds[None]
            p = 1 / (1 + np.exp(-np.clip(x @ beta.T, -LOGIT, LOGIT)))
            used = ~out
            total[:, 0] += (used * y[:, None]).sum(0)
            total[:, 1] += used.sum(0)
            total[:, 2 : 2 + k] += ((y[:, None] - p) * used).T @ x
            total[:, 2 + k :] += (np.maximum(p * (1 - p), FLOOR) * used).T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    sums = sample.select("features", "label", "fold").mapInPandas(work, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(folds) * (2 + k + k * k))
    for r in sums:
        out[r.i] = r.v
    return out.reshape(len(folds), -1)


def fits(sample: DataFrame, n: int, ridge: float = RIDGE) -> dict[int, np.ndarray]:
    """Coefficients of n logistic fits, the i-th over all rows whose ``fold`` is not i, by Newton's method; none for a fit
    without positives or without negatives. Only sums of n fits times squared features reach the driver, round by round.

    sample: label, features array, fold (below 0: never left out).
    """
    first = sample.select(F.size("features")).first()
    if first is None:
        return {}
    k = first[0] + 1
    beta, open_ = np.zeros((n, k)), np.arange(n)
    usable = np.ones(n, bool)
    for _ in range(ROUNDS):
        sums = newton_sums(sample, beta[open_], open_)
        usable[open_] = (sums[:, 0] > 0) & (sums[:, 0] < sums[:, 1])
        h = sums[:, 2 + k :].reshape(-1, k, k) + ridge * np.eye(k)
        g = sums[:, 2 : 2 + k] - ridge * beta[open_]
        step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        beta[open_] += step
        open_ = open_[usable[open_] & (np.abs(step).max(axis=1) >= SETTLED)]
        if not len(open_):
            break
    return {i: beta[i] for i in range(n) if usable[i]}


def scored(df: DataFrame, beta: dict[int, np.ndarray], name: str = "score") -> DataFrame:
    """Adds the linear score of each row by the fit of its ``fold``; rows of a fold without a fit go."""
    rows = df.sparkSession.createDataFrame([(i, [float(x) for x in b]) for i, b in beta.items()], "fold int, _beta array<double>")
    value = F.aggregate(F.zip_with("features", F.slice("_beta", 2, F.size("features")), lambda x, b: x * b), F.get("_beta", F.lit(0)), lambda s, x: s + x)
    return df.join(F.broadcast(rows), "fold").withColumn(name, value).drop("_beta")


def gene_folds(sample: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """Adds ``fold``: a number for each gene that has positives, a seeded one of these for each negative, and -1 for
    positives without a gene, which no fold holds out but every fit learns from. Also the number of genes.

    Genes are as many as a genome has; their names are numbered on the driver.
    """
    named = F.col("label") & F.col("gene").isNotNull() & (F.col("gene") != "")
    genes = [r[0] for r in sample.where(named).select("gene").distinct().orderBy("gene").collect()]
    if len(genes) < 2:
        raise ValueError("leave-one-gene-out needs two genes or more")
    numbers = sample.sparkSession.createDataFrame(list(enumerate(genes)), "_fold int, _gene string")
    drawn = F.pmod(F.xxhash64(F.lit(seed), "ord"), F.lit(len(genes))).cast("int")
    fold = F.when(~F.col("label"), drawn).otherwise(F.coalesce("_fold", F.lit(-1)))
    joined = sample.join(F.broadcast(numbers), F.col("label") & (F.col("gene") == F.col("_gene")), "left")
    return joined.withColumn("fold", fold).drop("_fold", "_gene"), len(genes)


def leave_one_gene_out(sample: DataFrame, seed: int = 0, ridge: float = RIDGE, also: tuple[str, ...] = ()) -> DataFrame:
    """ord, label, score (and other columns asked for): each gene's positives, and a seeded fold of the negatives, scored
    by a head fitted without them. The sample stays distributed: each Newton round is one aggregate for all fits.

    sample: ord, label, gene (NULL for negatives), features array.
    """
    rows, n = gene_folds(kept(sample.select("ord", "label", "gene", "features", *also), "head-sample"), seed)
    rows = kept(rows, "head-folds")
    return scored(rows, fits(rows, n, ridge)).select("ord", "label", "score", *also)


def transfer(train: DataFrame, test: DataFrame, ridge: float = RIDGE, also: tuple[str, ...] = ()) -> DataFrame:
    """Scores of the test panel's rows, without the training regions, by a head fitted on the training panel.

    The sample of a fit is written and read again: a Newton round then runs neither what led to it nor a Python task for
    each partition of a shuffle, as it would over a cached one, but one for each part of the files.
    """
    train = kept(train.select("ord", "label", "features"), "head-sample")
    beta = fits(train.withColumn("fold", F.lit(-1)), 1, ridge)
    if not beta:
        raise ValueError("the training panel needs positives and negatives")
    return scored(test.join(train.select("ord"), "ord", "left_anti").withColumn("fold", F.lit(0)), beta).select("ord", "label", "score", *also)
