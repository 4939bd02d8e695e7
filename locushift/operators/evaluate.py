"""Evaluations of a score: against positives, against a signed baseline, and of its signs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import draws, resample, stats
from .intervals import PLACE, with_first


def kept(df: DataFrame, confound: str | None = None, signed: str | None = None, opening: bool = False, threshold: float = 0.0, also: tuple[str, ...] = ()) -> DataFrame:
    """Measured rows, on request only the opening ones (signed above the threshold)."""
    if opening and signed is None:
        raise ValueError("opening-only needs a signed track")
    for c in (confound, signed, *also):
        if c:
            df = df.where(F.col(c).isNotNull())
    return df.where(F.col(signed) > threshold) if opening else df


def closing(df: DataFrame, signed: str, threshold: float = 0.0) -> DataFrame:
    return df.where(-F.col(signed) > threshold)


def matched_sample(df: DataFrame, confound: str, n_per_pos: int = 3, n_bins: int = 20, seed: int = 0) -> DataFrame:
    """All positives and their matched negatives."""
    negatives = stats.matched_negatives(df, confound, n_per_pos=n_per_pos, n_bins=n_bins, seed=seed)
    return df.where("label").unionByName(negatives)


def classes(sample: DataFrame) -> tuple[int, int]:
    """How many positives and negatives; there must be both."""
    n = sample.agg(F.count_if("label"), F.count_if(~F.col("label"))).first()
    if not all(n):
        raise SystemExit("the sample needs positives and matched negatives")
    return n[0], n[1]


def against_positives(df: DataFrame, score: str = "driver_score", confound: str = "confound", seed: int = 0, n_boot: int = 2000, n_perm: int = 1000, share: float = 0.05, **matching) -> dict:
    """AUROC on matched and on random negatives, interval, p by shuffled labels, and top-share fold."""
    df = df.where(F.col(confound).isNotNull())
    sample = matched_sample(df, confound, seed=seed, **matching).cache()
    try:
        n_pos, n_neg = classes(sample)
        random = stats.random_negatives(df, n_neg, seed=seed + 1)
        at_random = stats.auroc(df.where("label").unionByName(random), score).first()[0]
        observed = stats.auroc(sample, score).first()[0]
        low, high = resample.interval(draws.bootstrap_auroc(sample, score, n_boot, seed), "auroc")
        null = draws.label_shuffle(sample, score, n_perm, seed)
        return {
            "n_pos": n_pos, "n_neg": n_neg, "auroc": observed, "low": low, "high": high, "auroc_random": at_random, "confound_gap": at_random - observed,
            "p": resample.one_sided_p(null, "auroc", observed), "fold": stats.fold_enrichment(df, score, share).first()[0],
        }
    finally:
        sample.unpersist()


def against_baseline(df: DataFrame, score: str = "driver_score", signed: str = "signed", opening: bool = True, seed: int = 0, n_boot: int = 2000, n_perm: int = 1000, share: float = 0.05, **matching) -> dict:
    """Paired AUROC difference to the signed baseline, incremental likelihood ratio, and both folds."""
    df = kept(df, signed=signed, opening=opening, also=(score,)).withColumn("_size", F.abs(signed))
    sample = matched_sample(df, "_size", seed=seed, **matching).cache()
    try:
        n_pos, n_neg = classes(sample)
        low, high = resample.interval(draws.paired_bootstrap(sample, score, signed, n_boot, seed), "delta")
        lr = draws.likelihood_ratio(sample, signed, score, n_perm, seed)
        a, b = (stats.auroc(sample, c).first()[0] for c in (score, signed))
        folds = {f"fold_{k}": stats.fold_enrichment(df, c, share).first()[0] for k, c in (("driver", score), ("signed", signed))}
        return {"n_pos": n_pos, "n_neg": n_neg, "auroc_driver": a, "auroc_signed": b, "delta": a - b, "low": low, "high": high, **lr, **folds}
    finally:
        sample.unpersist()


def head_scores(df: DataFrame, test: str | None = None, seed: int = 0, **matching) -> DataFrame:
    """ord, label, score, driver_score, signed of rows that no head learned from that scores them: over genes left out one
    by one, or, with ``test`` (the label column of a second panel), of that panel by a head of the first.

    Either panel has its positives and negatives matched by the size of ``signed``; in a transfer, regions of the training
    sample are neither positives nor negatives of the test. Samples are written, not cached (see ``resample.transfer``).
    """
    sized, also = df.withColumn("_size", F.abs("signed")), ("driver_score", "signed")
    train = matched_sample(sized, "_size", seed=seed, **matching)
    if test is None:
        return resample.leave_one_gene_out(train, seed, also=also)
    train = scratch.kept(train, "head-train")
    used = train.select("ord", F.lit(True).alias("_used"))
    second = scratch.kept(sized.join(used, "ord", "left").withColumn("label", F.col(test) & F.col("_used").isNull()).drop("_used"), "head-second")
    return resample.transfer(train, matched_sample(second, "_size", seed=seed + 1, **matching), also=also)


def heads(df: DataFrame, k: int = 16, opening: bool = True, threshold: float = 0.0, magnitude: bool = True, test: str | None = None, seed: int = 0, n_boot: int = 2000, **matching) -> dict:
    """Whether a fitted head beats the zero-shot score and the signed baseline on what it has not learned from.

    df: ord, region, vector, driver_score, signed, label and gene (or, for a transfer, the test panel's label column).
    """
    own = scratch.kept(kept(df, signed="signed", opening=opening, threshold=threshold, also=("driver_score",)), "head-rows")
    features = scratch.kept(resample.head_features(own, k, magnitude=magnitude).drop("vector"), "head-features")
    sample = scratch.kept(head_scores(features, test, seed, **matching), "head-scores")
    n_pos, n_neg = classes(sample)
    out = {"n_pos": n_pos, "n_neg": n_neg, **{f"auroc_{n}": stats.auroc(sample, c).first()[0] for n, c in (("head", "score"), ("driver", "driver_score"), ("signed", "signed"))}}
    for name, column in (("driver", "driver_score"), ("signed", "signed")):
        low, high = resample.interval(draws.paired_bootstrap(sample, "score", column, n_boot, seed), "delta")
        out |= {f"delta_{name}": out["auroc_head"] - out[f"auroc_{name}"], f"low_{name}": low, f"high_{name}": high}
    return out | {"beats_both": all(out[f"low_{n}"] is not None and out[f"low_{n}"] > 0 for n in ("driver", "signed"))}


def signs(df: DataFrame, opening: DataFrame, closing_: DataFrame, seed: int = 0, n_boot: int = 2000) -> dict:
    """Accuracy of directions over anchor sets expected to open and to close, by gene and by size, and balanced."""
    base = stats.opening_rate(df).first()[0]
    out: dict = {"opening_rate": base}
    for name, anchors, sign in (("opening", opening, 1), ("closing", closing_, -1)):
        measured = df.where("direction is not null").select(*PLACE, "direction", F.lit(sign).alias("expected"))
        counts = scratch.kept(stats.sign_counts(with_first(measured, anchors).where("gene is not null"), "gene"), "signs")
        genes = counts.groupBy("gene").agg(F.sum("n_correct").alias("n_correct"), F.sum("n_signed").alias("n_signed"))
        own = counts.agg(F.try_divide(F.sum("n_correct"), F.sum("n_signed")).alias("accuracy"), F.coalesce(F.sum("n_signed"), F.lit(0)).alias("n_signed")).first().asDict()
        sizes = counts.groupBy("bin").agg((F.sum("n_correct") / F.sum("n_signed")).alias("accuracy"), F.sum("n_signed").alias("n"))
        boot = resample.gene_bootstrap(df.sparkSession, genes, n_boot, seed)
        rate = base if sign > 0 or base is None else 1 - base
        out[name] = own | {"n_genes": genes.count(), "low": boot["low"], "high": boot["high"], "beats_base": boot["low"] is not None and rate is not None and boot["low"] > rate, "strata": [r.asDict() for r in stats.strata(sizes).orderBy("bin").collect()]}
    both = [out[k]["accuracy"] for k in ("opening", "closing")]
    out["balanced_accuracy"] = None if None in both else sum(both) / 2
    return out
