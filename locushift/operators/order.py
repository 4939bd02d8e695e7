"""Ranks and running sums over whole tables without one task that holds all rows.

Rows are dealt into value ranges whose bounds are estimated quantiles, as many as the rows need; a window runs within
each range, and the ranges before it are added as an offset, one row per range. A value that fills a range of its own
is dealt further by ``ord``, where that breaks its ties. Bounds and the offsets of ranks are counted at once, so that
whatever takes the ranks runs their rows once, not once more for every rank that they went through before.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS, MOST_BUCKETS, ROWS = 16, 512, 1_000_000
#: More top rows than this are taken by rank, not by one task.
SMALL = 10_000


def below(x: Column, bounds: list[float]) -> Column:
    """How many of the bounds lie below x."""
    place = F.lit(0)
    for b in bounds if len(bounds) <= 64 else ():
        place = place + F.when(x > F.lit(float(b)), 1).otherwise(0)
    if len(bounds) <= 64:
        return place
    return F.aggregate(F.array(*[F.lit(float(b)) for b in bounds]), F.lit(0), lambda n, b: n + (x > b).cast("int"))


def bucketed(df: DataFrame, x: str, name: str = "_bucket", buckets: int | None = None, ties: str | None = None) -> DataFrame:
    """Adds the value range of ``x``; any bounds give right results, good ones even work.

    buckets: how many ranges; by default one per ROWS rows, within limits. ties: a column by which rows of a value that
    is a bound itself are dealt further.
    """
    shares = [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)]
    found = [F.count(F.lit(1)), F.percentile_approx(F.col(x).cast("double"), shares, 4096)]
    n, values, *rest = df.agg(*found, *([F.percentile_approx(F.col(ties).cast("double"), [i / BUCKETS for i in range(1, BUCKETS)], 1024)] if ties else [])).first()
    step = MOST_BUCKETS // min(MOST_BUCKETS, buckets or max(BUCKETS, 1 << (n // ROWS).bit_length()))
    bounds = sorted(set((values or [])[step - 1 :: step]))
    if not ties:
        return df.withColumn(name, below(F.col(x), bounds))
    within = sorted(set(rest[0] or []))
    equal = F.col(x).cast("double").isin(bounds) if bounds else F.lit(False)
    own = (2 * below(F.col(x), bounds) + equal.cast("int")) * (len(within) + 1)
    return df.withColumn(name, own + F.when(equal, below(F.col(ties), within)).otherwise(0))


def offsets(df: DataFrame, bucket: str = "_bucket", **sums: Column) -> DataFrame:
    """Per range, what the ranges before it add up to."""
    per = df.groupBy(bucket).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()])
    before = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return per.select(bucket, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in sums], *[F.sum(k).over(W.partitionBy()).alias(f"{k}_total") for k in sums])


def row_numbers(df: DataFrame, x: str, ord_: str = "ord", name: str = "rn", descending: bool = False, buckets: int | None = None) -> DataFrame:
    """Adds 1-based ``name`` by x (ties by ord) and ``name_n``, the number of rows; x must not be NULL."""
    own = df.withColumn("_x", -F.col(x) if descending else F.col(x))
    dealt = bucketed(own, "_x", buckets=buckets, ties=ord_)
    at, places, before = [], [], 0
    for bucket, n in dealt.groupBy("_bucket").count().orderBy("_bucket").collect():  # a row a range
        at, places, before = [*at, bucket], [*places, before], before + n
    off = df.sparkSession.createDataFrame(pa.table({"_bucket": pa.array(at, pa.int32()), "n_before": pa.array(places, pa.int64())}))
    ranked = dealt.withColumn("_rn", F.row_number().over(W.partitionBy("_bucket").orderBy("_x", ord_)))
    joined = ranked.join(F.broadcast(off), "_bucket")
    return joined.select(*df.columns, (F.col("_rn") + F.col("n_before")).cast("long").alias(name), F.lit(before).cast("long").alias(f"{name}_n"))


def average_ranks(df: DataFrame, x: str, name: str = "avg_rank", buckets: int | None = None) -> DataFrame:
    """Adds the 1-based rank of x, ties averaged. Only distinct values with their counts are ranked."""
    dealt = bucketed(df.groupBy(F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_k")), "_x", buckets=buckets)
    off = offsets(dealt, n=F.col("_k"))
    before = F.coalesce(F.sum("_k").over(W.partitionBy("_bucket").orderBy("_x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("_r", before + (F.col("_k") + 1) / F.lit(2.0)).join(F.broadcast(off), "_bucket").select("_x", (F.col("_r") + F.col("n_before")).alias(name))
    return df.join(ranked, F.col(x).eqNullSafe(F.col("_x"))).select(*df.columns, name)


def top_k(df: DataFrame, x: str, k: int, ord_: str = "ord", name: str = "rank") -> DataFrame:
    """The k rows with the largest x (ties by ord), ranked from 1: a few by take-ordered, more by their rank."""
    if k > SMALL:
        return row_numbers(df, x, ord_, name, descending=True).where(F.col(name) <= k).withColumn(name, F.col(name).cast("int")).drop(f"{name}_n")
    best = df.orderBy(F.desc(x), ord_).limit(k)
    return best.withColumn(name, F.row_number().over(W.orderBy(F.desc(x), ord_)).cast("int"))
