"""Statistics of a score against labels. Rows with a NULL score are left out; an empty class gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import sampling_key
from .order import average_ranks, bucketed, offsets, row_numbers, top_k
from .select import SMALL as SMALL_GROUP
from .select import first_rows


def auroc(df: DataFrame, score: str = "driver_score", label: str = "label", name: str = "auroc") -> DataFrame:
    """One row: chance that a positive scores above a negative, ties counted half.

    Rows shrink to distinct scores first; negatives below a score are a running sum within value ranges.
    """
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count_if(label).alias("_p"), F.count_if(~F.col(label)).alias("_q"))
    dealt = bucketed(per, "_s")
    off = offsets(dealt, p=F.col("_p"), q=F.col("_q"))
    below = F.coalesce(F.sum("_q").over(W.partitionBy("_bucket").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = F.col("_p") * (F.col("_below") + F.col("q_before") + F.lit(0.5) * F.col("_q"))
    joined = dealt.withColumn("_below", below).join(F.broadcast(off), "_bucket")
    return joined.agg(F.try_divide(F.sum(wins), (F.sum("_p") * F.sum("_q")).cast("double")).alias(name))


def take(n: int, share: float) -> int:
    """Rows in the top share, at least one; halves round to even."""
    return max(1, int(round(share * n)))


def fold_enrichment(df: DataFrame, score: str, share: float, label: str = "label", ord_: str = "ord", name: str = "fold") -> DataFrame:
    """One row: share of positives among the top rows over that among all (NULL without positives)."""
    df = df.where(F.col(score).isNotNull())
    k = take(df.count(), share)
    top = top_k(df, score, k, ord_).agg(F.avg(F.col(label).cast("double")).alias("_top"))
    return top.join(F.broadcast(df.agg(F.avg(F.col(label).cast("double")).alias("_base")))).select(F.try_divide("_top", "_base").alias(name))


def fold_sweep(df: DataFrame, score: str, shares: list[float], label: str = "label", ord_: str = "ord") -> DataFrame:
    """share, k, fold for several shares in one pass over the ranks."""
    ranked = row_numbers(df.where(F.col(score).isNotNull()), score, ord_, descending=True)
    n = ranked.count()
    ks = {s: take(n, s) for s in shares}
    hits = ranked.agg(F.avg(F.col(label).cast("double")).alias("base"), *[F.sum(F.when(F.col("rn") <= k, F.col(label).cast("double"))).alias(f"h{i}") for i, k in enumerate(ks.values())])
    rows = F.array(*[F.struct(F.lit(s).alias("share"), F.lit(k).cast("long").alias("k"), F.try_divide(F.col(f"h{i}") / k, "base").alias("fold")) for i, (s, k) in enumerate(ks.items())])
    return hits.select(F.explode(rows).alias("r")).select("r.*")


def exact_quantiles(df: DataFrame, x: str, shares: list[float], ord_: str = "ord") -> list[float]:
    """Linearly interpolated quantiles, from the few ranks that they need; no task holds all values."""
    ranked = row_numbers(df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"), ord_), "x", ord_)
    n = ranked.count()
    if not n:
        return []
    at = [s * (n - 1) for s in shares]
    ranks = sorted({int(a) + d for a in at for d in (1, 2) if int(a) + d <= n})
    value = {r["rn"]: r["x"] for r in ranked.where(F.col("rn").isin(ranks)).select("rn", "x").collect()}
    out = []
    for a in at:
        low, t = value[int(a) + 1], a - int(a)
        high = value.get(int(a) + 2, low)
        out.append(low + (high - low) * t if t < 0.5 else high - (high - low) * (1 - t))
    return out


def quantile_edges(df: DataFrame, x: str, n_bins: int = 20, ord_: str = "ord") -> list[float]:
    """Distinct quantiles at n_bins + 1 points; [min, max + 1e-9] when fewer than two remain."""
    edges = sorted(set(exact_quantiles(df, x, [i / n_bins for i in range(n_bins + 1)], ord_)))
    return edges if len(edges) > 1 or not edges else [edges[0], edges[-1] + 1e-9]


def bin_of(x: Column, edges: list[float]) -> Column:
    """0-based bin: how many inner edges lie at or below x."""
    place = F.lit(0)
    for e in edges[1:-1]:
        place = place + F.when(x >= F.lit(float(e)), 1).otherwise(0)
    return F.when(x.isNotNull(), place)


def first_by_key(df: DataFrame, group: str, want: str, key: str, salts: int = 32) -> DataFrame:
    """Per group its first ``want`` rows by key: first within salted parts of the group, then among what they leave."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    part = salted.withColumn("_r", F.row_number().over(W.partitionBy(group, "_salt").orderBy(key))).where(F.col("_r") <= F.col(want))
    return part.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(key))).where(F.col("_r") <= F.col(want)).drop("_r", "_salt")


def hash_number(key: str) -> Column:
    """The first 52 bits of a hexadecimal hash, which a double holds exactly."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double")


def drawn(pool: DataFrame, group: str, want: DataFrame, key: str = "_key", small: int = SMALL_GROUP, ord_: str = "ord") -> DataFrame:
    """Per group its first rows by a hash: by a window in groups of up to ``small`` rows, else by selection, so that no
    task sorts a large group. want: group, ``_want`` and ``_q``, how many rows there are."""
    largest = want.agg(F.max("_q")).first()[0] or 0
    if largest <= small:
        return first_by_key(pool.join(F.broadcast(want.select(group, "_want")), group), group, "_want", key).drop("_want")
    return first_rows(pool.withColumn("_number", hash_number(key)), [group], "_number", want.select(group, "_want"), ord_).drop("_number")


def matched_negatives(df: DataFrame, confound: str, label: str = "label", n_per_pos: int = 3, n_bins: int = 20, seed: int = 0, small: int = SMALL_GROUP) -> DataFrame:
    """Negatives drawn from the positives' bins of the confound, up to n_per_pos each, by a seeded hash of the region."""
    known = df.where(F.col(confound).isNotNull())
    binned = known.withColumn("_bin", bin_of(F.col(confound), quantile_edges(known, confound, n_bins))).withColumn("_key", sampling_key(seed))
    per = binned.groupBy("_bin").agg(F.count_if(label).alias("_p"), F.count_if(~F.col(label)).alias("_q"))
    want = per.where("_p > 0 and _q > 0").select("_bin", "_q", F.least(F.col("_q"), n_per_pos * F.col("_p")).alias("_want"))  # a row a bin
    return drawn(binned.where(~F.col(label)), "_bin", want, small=small).select(df.columns)


def random_negatives(df: DataFrame, n: int, label: str = "label", seed: int = 1, small: int = SMALL_GROUP) -> DataFrame:
    """n negatives by a seeded hash, whatever their confound: a few by take-ordered, more by selection."""
    keyed = df.where(~F.col(label)).withColumn("_key", sampling_key(seed))
    if n <= small:
        return keyed.orderBy("_key").limit(n).drop("_key")
    want = df.sparkSession.range(1).select(F.lit(0).alias("_one"), F.lit(n).alias("_want"))
    own = keyed.withColumn("_one", F.lit(0)).withColumn("_number", hash_number("_key"))
    return first_rows(own, ["_one"], "_number", want).select(df.columns)


def sign_accuracy(df: DataFrame, by: list[str] | None = None, name: str = "direction", expected: str = "expected") -> DataFrame:
    """accuracy and n_signed over measured, non-flat directions; NULL accuracy when there are none."""
    d = F.col(name)
    right = F.when(d != 0, (F.signum(d) == F.col(expected)).cast("double"))
    return df.groupBy(*(by or [])).agg(F.avg(right).alias("accuracy"), F.count(right).alias("n_signed"))


EDGES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.5, 1.01)


def size_bin(name: str, edges=EDGES) -> Column:
    """The bin [low, high) of a direction's size; NULL outside."""
    size, place = F.abs(F.col(name)), F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        place = F.when((size >= a) & (size < b), F.lit(i)).otherwise(place)
    return place


def sign_counts(df: DataFrame, *by: str, name: str = "direction", expected: str = "expected") -> DataFrame:
    """n_correct and n_signed of the non-flat directions, by the given columns and the bin of their size."""
    d = F.col(name)
    return df.where(d != 0).groupBy(*by, size_bin(name).alias("bin")).agg(F.sum((F.signum(d) == F.col(expected)).cast("long")).alias("n_correct"), F.count(F.lit(1)).alias("n_signed"))


def strata(per: DataFrame, edges=EDGES) -> DataFrame:
    """bin, low, high, n, accuracy for every bin of size; those that ``per`` lacks have n 0."""
    bins = per.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    return bins.join(per, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def accuracy_by_size(df: DataFrame, edges=EDGES, name: str = "direction", expected: str = "expected") -> DataFrame:
    """Sign accuracy by bins [low, high) of the direction's size; empty bins stay, with n 0."""
    d = F.col(name)
    per = df.where(d != 0).groupBy(size_bin(name, edges).alias("bin")).agg(F.avg((F.signum(d) == F.col(expected)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return strata(per, edges)


def opening_rate(df: DataFrame, name: str = "direction") -> DataFrame:
    d = F.col(name)
    return df.where(d != 0).agg(F.avg((d > 0).cast("double")).alias("opening_rate"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return average_ranks(average_ranks(both, x, "_rx"), y, "_ry").agg(F.corr("_rx", "_ry").alias("spearman"))


def top_overlap_fold(df: DataFrame, x: str, y: str, share: float = 0.05) -> DataFrame:
    """Rows in the top share of both scores over what chance would give."""
    n = df.count()
    k = take(n, share)
    both = top_k(df, x, k).select("ord").join(top_k(df, y, k).select("ord"), "ord")
    return both.agg((F.count(F.lit(1)) / F.lit(k * k / n)).alias("overlap_fold"))


def capped_share(x: Column, cap: Column) -> Column:
    """A positive value over its cap, clipped to [0, 1]; a missing or zero cap counts as 1."""
    return F.least(F.greatest(x / F.coalesce(F.nullif(cap, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
