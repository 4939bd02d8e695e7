"""Importance scores and the signed open/close channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp
from .order import row_numbers


def driver_score(df: DataFrame, raw: str = "shift", method: str = "rank", name: str = "driver_score") -> DataFrame:
    """rank: ordinal percentile (ties by ord); minmax: scaled to [0, 1], all 0 if constant."""
    df = df.drop(name)
    if method == "rank":
        ranked = row_numbers(df, raw, name="_rank")
        return ranked.select(*df.columns, ((F.col("_rank") - 1) / F.greatest(F.col("_rank_n") - 1, F.lit(1))).alias(name))
    if method == "minmax":
        stats = df.agg(F.min(raw).alias("_low"), F.max(raw).alias("_high"))
        scaled = F.when(F.col("_high") > F.col("_low"), (F.col(raw) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.lit(0.0))
        return df.join(F.broadcast(stats)).select(*df.columns, scaled.alias(name))
    raise ValueError(f"the method is rank or minmax, not {method!r}")


def direction(df: DataFrame, delta: str = "delta", method: str = "maxabs", name: str = "direction") -> DataFrame:
    """maxabs: scaled by the largest measured size (all 0 if that is 0); raw: clipped; signed-rank. NULL stays NULL."""
    df = df.drop(name)
    if method == "raw":
        return df.withColumn(name, clamp(F.col(delta), -1.0, 1.0))
    if method == "maxabs":
        scale = F.lit(df.agg(F.max(F.abs(delta))).first()[0])  # at once: later passes over df don't look for it again
        scaled = F.when(F.col(delta).isNull(), F.lit(None)).when(scale > 0, F.col(delta) / scale).otherwise(F.lit(0.0))
        return df.select(*df.columns, scaled.alias(name))
    if method == "signed-rank":
        measured = df.where(F.col(delta).isNotNull()).withColumn("_size", F.abs(delta))
        ranked = row_numbers(measured, "_size", name="_rank")
        signed = F.signum(delta) * (F.col("_rank") - 1) / F.greatest(F.col("_rank_n") - 1, F.lit(1))
        out = ranked.select(*df.columns, signed.alias(name))
        return out.unionByName(df.where(F.col(delta).isNull()).withColumn(name, F.lit(None).cast("double")))
    raise ValueError(f"the method is maxabs, raw or signed-rank, not {method!r}")


def tally(df: DataFrame, name: str = "direction") -> DataFrame:
    """One row: opening, closing, flat and unmeasured regions."""
    d = F.col(name)
    return df.agg(F.count_if(d > 0).alias("opening"), F.count_if(d < 0).alias("closing"), F.count_if(d == 0).alias("flat"), F.count_if(d.isNull()).alias("unmeasured"))


def primary(df: DataFrame, which: str) -> DataFrame:
    """The score that nominations rank by: driver_score, or the rank of the measured directions' size."""
    if which == "driver":
        return df.withColumn("primary_score", F.col("driver_score"))
    if which == "signed":
        measured = df.where("direction is not null").withColumn("_size", F.abs("direction"))
        return driver_score(measured, "_size", "rank", "primary_score").select(*df.columns, "primary_score")
    raise ValueError(f"the primary score is driver or signed, not {which!r}")
