"""Selection within groups without sorting them: each group's k-th value by histograms, then a plain filter.

A pass counts each group's rows by ``BINS`` ranges between the least and the largest value that may still be the k-th,
and keeps the range that the k-th falls into, with the least and the largest value seen there. Counts are partial sums a
task, so a group of any size is a few thousand rows after the map side; what is sorted are those counts. Ranges are of
equal width but for the second pass, whose are equal in the logarithm, so that values of any spread of sizes are told
apart in a fixed number of passes; what a pass leaves of the groups, a row each, is written and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import kept

BINS = 4096
#: One pass by equal width, one by logarithm, which leaves values within a factor of 2 or so, and five to tell these apart.
PASSES = 8
#: Groups of at most so many rows are ranked by a window instead; this changes the plan only.
SMALL = 1_000_000


def logarithm(x: Column) -> Column:
    """Grows with x: the sign and, apart by over 2000, the binary logarithm of the size."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))


def bin_in(x: Column, low: Column, high: Column) -> Column:
    """The bin of x between low and high, the ends in the first and the last one. Halves keep the widest range finite."""
    share = F.try_divide(x / 2 - low / 2, high / 2 - low / 2)
    return F.when(x == low, 0).when(x == high, BINS - 1).otherwise(F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(0)), F.lit(BINS - 1))).cast("int")


def kth(df: DataFrame, groups: list[str], x: str, k: DataFrame) -> DataFrame:
    """groups, value, below: the k-th smallest x of each group, and how many rows of the group lie below that value.

    k: groups and ``_k``, from 1; a group with fewer rows, or without any, has no row. NULL and NaN don't count.
    """
    rows = df.select(*groups, F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    first = rows.groupBy(*groups).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count(F.lit(1)).alias("_n")).join(k, groups)
    first = first.where((F.col("_k") >= 1) & (F.col("_k") <= F.col("_n"))).select(*groups, "_low", "_high", F.col("_k").cast("long").alias("_k"), F.lit(0).cast("long").alias("_below"))
    found = kept(first, "kth")
    settled, order = found.where("_low = _high"), W.partitionBy(*groups).orderBy("_range")
    for i in range(PASSES):
        open_ = found.where("_low < _high")
        if open_.isEmpty():
            break
        scale = logarithm if i == 1 else lambda c: c
        near = rows.join(open_, groups).where((F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high")))
        place = bin_in(scale(F.col("_x")), scale(F.col("_low")), scale(F.col("_high")))
        counts = near.groupBy(*groups, place.alias("_range"), "_k", "_below").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        upto = counts.withColumn("_upto", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)))
        before = F.col("_upto") - F.col("_n")
        found = kept(upto.where((F.col("_upto") >= F.col("_k")) & (before < F.col("_k"))).select(*groups, "_low", "_high", (F.col("_k") - before).alias("_k"), (F.col("_below") + before).alias("_below")), "kth")
        settled = settled.unionByName(found.where("_low = _high"))
    else:
        if not found.where("_low < _high").isEmpty():
            raise ArithmeticError("values are still not told apart")
    return settled.select(*groups, F.col("_low").alias("value"), F.col("_below").alias("below"))


def first_rows(df: DataFrame, groups: list[str], x: str, want: DataFrame, ord_: str = "ord") -> DataFrame:
    """Of each group the ``_want`` rows with the smallest x, ties by ord (unique in the group), or all rows of a smaller
    group. want: groups and ``_want``; groups that it lacks go."""
    sizes = df.where(F.col(x).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).join(want, groups)
    k = sizes.select(*groups, F.least("_n", "_want").alias("_k"))
    at = kth(df, groups, x, k).select(*groups, F.col("value").alias("_cut"), F.col("below").alias("_under"))
    cut = kept(at.join(k, groups), "cuts")
    equal = df.join(cut, groups).where(F.col(x).cast("double") == F.col("_cut")).select(*groups, ord_)
    last = kth(equal, groups, ord_, cut.select(*groups, (F.col("_k") - F.col("_under")).alias("_k"))).select(*groups, F.col("value").alias("_last"))
    cuts = cut.join(last, groups).select(*groups, "_cut", "_last")
    own = F.col(x).cast("double")
    return df.join(cuts, groups).where((own < F.col("_cut")) | ((own == F.col("_cut")) & (F.col(ord_).cast("double") <= F.col("_last")))).select(df.columns)


def quantile(df: DataFrame, groups: list[str], x: str, share: float, name: str = "quantile") -> DataFrame:
    """groups, name: the exact quantile of each group, interpolated between the two values around it."""
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    place = rows.groupBy(*groups).agg(((F.count(F.lit(1)) - 1) * share).alias("_at"))
    at = lambda f, n: kth(rows, groups, x, place.select(*groups, (f("_at") + 1).cast("long").alias("_k"))).select(*groups, F.col("value").alias(n))
    both = place.join(at(F.floor, "_a"), groups).join(at(F.ceil, "_b"), groups)
    return both.select(*groups, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias(name))
