"""Gate 1 (are the replicates admissible?) and Gate 2 (does the model's score beat the signed baseline?)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import top_k

UNIVERSE, LEAST_REPLICATES, LEAST_COHERENCE, LEAST_PC1, LEVEL = 50_000, 2, 0.10, 0.80, 0.05


@dataclass
class Admissibility:
    admit: bool
    pc1_frac: float | None
    coherence_margin: float | None
    n_a: int
    n_b: int
    universe_n: int
    universe_truncated: bool
    reasons: list[str] = field(default_factory=list)

    as_dict = asdict


def wide(matrix: DataFrame, samples: list | None = None) -> tuple[DataFrame, list]:
    """Long rows (ord, sample, value) to one row per region, missing cells 0; samples are few by contract."""
    samples = samples or sorted(r[0] for r in matrix.select("sample").distinct().collect())
    table = matrix.groupBy("ord").pivot("sample", samples).agg(F.sum("value"))
    return table.select("ord", *[F.coalesce(F.col(f"`{s}`").cast("double"), F.lit(0.0)).alias(f"s{i}") for i, s in enumerate(samples)]), samples


def log_cpm(table: DataFrame, n: int) -> DataFrame:
    """log1p of counts per million; depth is taken over all regions, a depth of 0 counts as 1."""
    depth = table.agg(*[F.sum(f"s{i}").alias(f"d{i}") for i in range(n)])
    cells = [F.log1p(F.col(f"s{i}") / F.when(F.col(f"d{i}") == 0, F.lit(1.0)).otherwise(F.col(f"d{i}")) * 1e6).alias(f"s{i}") for i in range(n)]
    return table.join(F.broadcast(depth)).select("ord", *cells)


def accessible(cpm: DataFrame, n: int, most: int = UNIVERSE) -> DataFrame:
    """The most accessible regions by mean log CPM."""
    mean = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0)) / n
    return top_k(cpm.withColumn("mean_cpm", mean), "mean_cpm", most)


def coherence(cpm: DataFrame, is_a: list[bool]) -> DataFrame:
    """One row: mean correlation of samples within states, across states, and their difference (NULL if either is empty)."""
    pairs = list(combinations(range(len(is_a)), 2))
    corr = cpm.agg(*[F.corr(f"s{i}", f"s{j}").alias(f"c{i}_{j}") for i, j in pairs])

    def mean(same: bool):
        own = [F.nanvl(F.col(f"c{i}_{j}"), F.lit(None).cast("double")) for i, j in pairs if (is_a[i] == is_a[j]) == same]
        return sum(own[1:], own[0]) / len(own) if own else F.lit(None).cast("double")

    return corr.select(mean(True).alias("within"), mean(False).alias("across")).withColumn("coherence", F.col("within") - F.col("across"))


def pc1_fraction(cpm: DataFrame, n: int) -> float | None:
    """Share of the first principal component: of the samples' Gram matrix after centring each region."""
    mean = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0)) / n
    centred = cpm.select(*[(F.col(f"s{i}") - mean).alias(f"z{i}") for i in range(n)])
    sums = centred.agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    if sums[0] is None:
        return None
    value = np.linalg.eigvalsh(np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]))
    return float(value[-1] / value.sum()) if value.sum() > 0 else None


def admissibility(matrix: DataFrame, universe: int | None = UNIVERSE) -> Admissibility:
    """Gate 1 over long rows (ord, sample, is_a, value), on the ``universe`` most accessible regions; None: on all regions,
    however many, of which fewer than UNIVERSE still count as truncated."""
    states = {r["sample"]: r["is_a"] for r in matrix.select("sample", "is_a").distinct().collect()}
    table, samples = wide(matrix)
    is_a = [bool(states[s]) for s in samples]
    cpm = log_cpm(table, len(samples))
    top = (cpm if universe is None else accessible(cpm, len(samples), universe)).cache()
    try:
        n = top.count()
        c = coherence(top, is_a).first()["coherence"]
        pc1 = pc1_fraction(top, len(samples))
    finally:
        top.unpersist()
    n_a, n_b = sum(is_a), len(is_a) - sum(is_a)
    reasons = []
    if min(n_a, n_b) < LEAST_REPLICATES:
        reasons.append(f"a state has fewer than {LEAST_REPLICATES} replicates ({n_a} and {n_b})")
    if c is None or not c >= LEAST_COHERENCE:
        reasons.append(f"replicate coherence {'unknown' if c is None else f'{c:.3f}'} is below {LEAST_COHERENCE}")
    if pc1 is None or not pc1 >= LEAST_PC1:
        reasons.append(f"PC1 fraction {'unknown' if pc1 is None else f'{pc1:.3f}'} is below {LEAST_PC1}")
    return Admissibility(not reasons, pc1, c, n_a, n_b, n, n < (UNIVERSE if universe is None else universe), reasons)


@dataclass
class ScoreSelection:
    primary: str
    delta_auroc: float | None
    delta_auroc_ci: list[float | None]
    lr_p: float | None
    lr_coef: float | None
    reason: str

    as_dict = asdict


def select_score(result: dict, model_id: str = "GET") -> ScoreSelection:
    """The model's score if it beats the signed baseline by interval or by likelihood ratio; else the baseline."""
    low, high, p, coef = (result[k] for k in ("low", "high", "p", "coef"))
    text = lambda x, form: "unknown" if x is None else format(x, form)
    gain = f"AUROC gain {text(result['delta'], '+.3f')}, interval {text(low, '+.3f')} to {text(high, '+.3f')}"
    ratio = f"likelihood ratio p {text(p, '.3g')}, coefficient {text(coef, '+.2f')}"
    grounds = [gain] * (low is not None and low > 0) + [ratio] * (p is not None and p < LEVEL and (coef or 0) > 0)
    reason = f"{model_id} adds to the signed baseline: {'; '.join(grounds)}" if grounds else f"{model_id} adds nothing to the signed baseline: {gain}; {ratio}"
    return ScoreSelection(model_id if grounds else "signed-Delta", result["delta"], [low, high], p, coef, reason)
