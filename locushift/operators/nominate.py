"""Nominations: a ranked list, or a refusal with its reason."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import direction_field, score_field
from .order import top_k
from .score import primary

TOP = 0.01
#: Species of the assemblies, and where each model's direction comes from (looked up without case).
SPECIES = {"hg38": "human", "hg19": "human", "mm10": "mouse", "mm39": "mouse"}
PROVENANCE = {"GET": "input-measured", "ChromFound": "input-measured", "EpiAgent": "predicted-model-native", "ATACformer": "external-attach", "ChromBERT": "external-attach"}
NOMINATION = "chrom string, start_pos long, end_pos long, rank int, nomination_score double, direction double"


def refusal(gate1: dict | None, gate2: dict | None) -> str | None:
    """Why nothing may be nominated; None if something may. The first reason that holds counts."""
    if gate1 is None:
        return "Gate 1 has not been run: replicates are not known to be admissible"
    if not gate1.get("admit"):
        return "Gate 1 rejected the transition: " + "; ".join(gate1.get("reasons") or ["not admitted"])
    if gate2 is None:
        return "Gate 2 has not been run: no primary score has been chosen"
    return None


def nominated(weights: DataFrame, gate1: dict | None, gate2: dict | None, top: float = TOP, norm: str = "rank") -> tuple[DataFrame, dict]:
    """The nominations (empty after a refusal) and the manifest's block on them. norm: how driver_score was normalised."""
    spark = weights.sparkSession
    why = refusal(gate1, gate2)
    if why:
        return spark.createDataFrame([], NOMINATION), {"score_source": None, "score_norm": None, "top_frac": None, "n_nominated": 0, "refused": True, "refusal_reason": why}
    signed = gate2["primary"] == "signed-Delta"
    n = weights.where("direction is not null").count() if signed else weights.count()
    if signed and not n:
        raise ValueError("the primary score is signed-Delta, but no direction has been measured")
    scored = primary(weights, "signed" if signed else "driver")
    k = max(1, math.ceil(n * top))
    best = top_k(scored, "primary_score", k)
    rows = best.select("chrom", "start_pos", "end_pos", "rank", score_field(F.col("primary_score")).alias("nomination_score"), direction_field(F.col("direction")).alias("direction"))
    return rows, {"score_source": gate2["primary"], "score_norm": "rank" if signed else norm, "top_frac": top, "n_nominated": k, "refused": False, "refusal_reason": None}


def provenance(model: str, models: dict[str, str] = PROVENANCE) -> str | None:
    return {k.lower(): v for k, v in models.items()}.get(model.lower())


def stray(nominations: DataFrame, weights: DataFrame) -> int:
    """Nominations that are not among the weights; 0 in a sound bundle."""
    return nominations.join(weights, ["chrom", "start_pos", "end_pos"], "left_anti").count()


def trusted_direction(df: DataFrame, least: float = 0.05) -> DataFrame:
    """Adds whether a direction is large enough for its sign to be trusted (guidance, not part of any file)."""
    return df.withColumn("direction_trusted", F.coalesce(F.abs("direction") >= least, F.lit(False)))
