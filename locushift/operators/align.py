"""Two states on shared regions: alignment, embedding shift, signed delta, value attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import l2_shift

REGION = ["chrom", "start_pos", "end_pos"]


def last_of_each(df: DataFrame, keys: list[str] = REGION, ord_: str = "ord") -> DataFrame:
    """Of rows with equal keys, the one with the largest ord: one aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ord_).alias("_row")).select(*keys, "_row.*")


def check_states(meta_a: dict, meta_b: dict) -> None:
    if meta_a.get("assembly") != meta_b.get("assembly"):
        raise ValueError(f"states lie on different assemblies: {meta_a.get('assembly')} and {meta_b.get('assembly')}")
    if meta_a.get("dim") != meta_b.get("dim"):
        raise ValueError(f"states have embeddings of different dimension: {meta_a.get('dim')} and {meta_b.get('dim')}")


def aligned(a: DataFrame, b: DataFrame, signal: bool = True) -> DataFrame:
    """ord, region, shift (L2 of the embeddings) and delta (b - a; NULL if unmeasured) of shared regions.

    Order is a's; of equal regions in b the last counts; each equal region in a is matched. One join gives both
    channels. signal: whether both states carry a signal at all; if not, delta is NULL throughout.
    """
    right = last_of_each(b).select(*REGION, F.col("embedding").alias("_eb"), *([F.col("signal").alias("_sb")] if signal else []))
    joined = a.join(right, REGION)
    delta = F.col("_sb").cast("double") - F.col("signal").cast("double") if signal else F.lit(None).cast("double")
    return joined.select("ord", *REGION, l2_shift(F.col("embedding"), F.col("_eb")).alias("shift"), delta.alias("delta"))


def require_shared(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the states share no regions")
    return df


def attach_value(regions: DataFrame, track: DataFrame, value: str = "value", name: str = "value", default: float | None = None) -> DataFrame:
    """A track's value by exact region, the last of equal ones; missing is NULL or ``default``, with a flag for the latter."""
    own = last_of_each(track).select(*REGION, F.col(value).cast("double").alias("_v"), F.lit(True).alias("_has"))
    joined = regions.join(own, REGION, "left")
    if default is None:
        return joined.select(*regions.columns, F.col("_v").alias(name))
    return joined.select(*regions.columns, F.coalesce("_v", F.lit(default)).alias(name), F.coalesce("_has", F.lit(False)).alias(f"has_{name}"))


def joined_exactly(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join of which every left row must find its partner (surrogate keys, name joins)."""
    missing = left.join(right, keys, "left_anti").limit(1).count()
    if missing:
        raise KeyError(f"a key of {keys} is missing on the right")
    return left.join(right, keys)


def tokens_to_regions(sentences: DataFrame, universe: DataFrame, first: int = 4, most: int = 8190) -> DataFrame:
    """Exploded sentences: at most ``most`` tokens each, token t standing for the universe's row t - first."""
    kept = sentences.select(*[c for c in sentences.columns if c != "tokens"], F.posexplode(F.slice("tokens", 1, most)).alias("place", "token"))
    return kept.withColumn("row", F.col("token") - first).join(universe, "row")
