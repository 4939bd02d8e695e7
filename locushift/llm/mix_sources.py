"""Mixing sources to target weights (native).

Tokens are aggregated per source, targets become repetition rates, and each document is taken
``floor(rate)`` times plus one Bernoulli copy whose chance is the rate's fraction. The draw is a hash of the
document's id and text, and of its number among the rows that have the same id, source and text, so equal rows draw
apart, a source without ids comes near its target, and reruns and retried tasks agree.

Defined results: a null text has no words; null is a source of its own and comes last; documents of
a source without words are taken zero times; of equal rows, each draws for itself (which one gets which draw is
open, as nothing tells them apart); an empty table gives an empty mix; extra columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, let, materialize, n_words, packed

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
SMALL = 100_000


def in_order(df: DataFrame, order: list[Column], few: bool, **sums: str) -> DataFrame:
    """Adds ``rn`` (from 0) in the given order and, per name, the sum of a column over the rows before.

    A few rows (checked to be at most ``SMALL``) are one window; more are dealt into ranges, each a window, and what
    the ranges before add up to comes back to them.
    """
    if few:
        whole = W.orderBy(*order)
        before = whole.rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn("rn", F.row_number().over(whole) - 1).withColumns({k: F.coalesce(F.sum(c).over(before), F.lit(0.0)) for k, c in sums.items()})
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    whole = W.partitionBy("_range").orderBy(*order)
    before = whole.rowsBetween(W.unboundedPreceding, -1)
    ranges = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    per = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    per = per.select("_range", *[F.coalesce(F.sum(x).over(ranges), F.lit(0)).alias(x) for x in ("_n", *[f"_{k}" for k in sums])])
    own = dealt.withColumn("rn", F.row_number().over(whole) - 1).withColumns({k: F.coalesce(F.sum(c).over(before), F.lit(0.0)) for k, c in sums.items()})
    return own.join(F.broadcast(per), "_range").withColumns({"rn": F.col("rn") + F.col("_n")} | {k: F.col(k) + F.col(f"_{k}") for k in sums}).select(*df.columns, "rn", *sums)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, bool]:
    """``(source, size)`` rows to one row per source: source, source_size, target; and whether these are few.

    A source takes ``min(most * size, level * weight)``. The level follows from the sources in order of the
    level at which each is full: the first whose own level can still be reached is the last one left open, so
    one running sum over the sources replaces the rounds of resharing. Sums are of whole numbers, so their order
    does not show.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    few = totals.limit(SMALL + 1).count() <= SMALL
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rn") % len(weights) + 1).cast("int"))
    own = in_order(totals, [F.col("source").asc_nulls_last()], few).withColumn("weight", picked).withColumnRenamed("rn", "number")
    own = own.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    everything = own.agg((F.sum("source_size") * F.lit(float(share))).alias("budget"), F.sum("weight").alias("all_weight"))
    own = in_order(own, [F.col("full_at"), F.col("number")], few, filled="cap", full_weight="weight").join(F.broadcast(everything))
    own = own.withColumn("level", (F.col("budget") - F.col("filled")) / (F.col("all_weight") - F.col("full_weight")))
    level = own.where(F.col("level") <= F.col("full_at")).agg(F.min(F.struct("full_at", "number", "level"))["level"].alias("_level"))
    target = F.least("cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("cap")))
    return materialize(own.join(F.broadcast(level)).select("source", "source_size", target.alias("target")), "targets"), few


def draw(doc_id: Column, digest: Column, number: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id, the text's digest, the number among equal rows and the seed alone."""
    text = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), digest, number.cast("string"), F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies_of(size: Column, total: Column, target: Column, drawn: Column) -> Column:
    rate = F.when(total > 0, target / total).otherwise(F.lit(0.0))
    return let(rate, lambda r: (F.floor(r) + F.when(drawn < r - F.floor(r), 1).otherwise(0)).cast("int"))


def with_targets(df: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """Adds _total and _target by source: by broadcast of a few, else by a shuffle whose large partitions Spark splits."""
    own = targets.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_total"), F.col("target").alias("_target"))
    return df.join(F.broadcast(own) if few else own.hint("merge"), F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def numbered(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Adds ``name``, a number from 0 among the rows of a key, without one task that holds all rows of a key."""
    part, place = fresh(rows, "_part"), fresh(rows, "_place")
    own = rows.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id())
    own = materialize(own.withColumn(name, F.row_number().over(W.partitionBy(*key, part).orderBy(place)) - 1), "numbered")
    per = own.groupBy(*key, part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(key)], F.col(part).alias("_of"), before.alias("_before"))
    same = F.col(part) == F.col("_of")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_of{i}"))
    return own.join(per, same).withColumn(name, F.col(name) + F.col("_before")).select(*rows.columns, name)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of ``docs``."""
    rows = packed(docs, "doc_id", "source", "text").withColumn("_size", n_words(F.col("text"))).withColumn("_digest", digest(F.col("text"))).drop("text")
    targets, few = source_targets(rows.select("source", F.col("_size").alias("size")), weights, share, most)
    key = ["doc_id", "source", "_digest"]
    equal = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(key)]), "equal-rows")
    some = equal.limit(SMALL + 1).count()
    alone = rows.withColumn("_number", F.lit(0))
    if some:
        side = F.broadcast(equal) if some <= SMALL else equal
        same = F.col("doc_id").eqNullSafe(F.col("_e0")) & F.col("source").eqNullSafe(F.col("_e1")) & (F.col("_digest") == F.col("_e2"))
        alone = rows.join(side, same, "left_anti").withColumn("_number", F.lit(0))
        alone = alone.unionByName(numbered(rows.join(side, same, "left_semi"), key, "_number"))
    copies = copies_of(F.col("_size"), F.col("_total"), F.col("_target"), draw(F.col("doc_id"), F.col("_digest"), F.col("_number"), seed))
    return with_targets(alone, targets, few).select("_row", F.explode(F.array_repeat(F.lit(1), copies))).select("_row.*")


def report(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, chunk: int = 10_000) -> DataFrame:
    """Per document: size, source_size, target and the words that the mix takes.

    Equal rows travel as one row with their number, and come apart again in chunks, each of which is a row of its own.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest(F.col("text")).alias("_digest"))
    rows = materialize(rows.groupBy("doc_id", "source", "size", "_digest").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    targets, few = source_targets(rows.select("source", (F.col("size") * F.col("_n")).alias("size")), weights, share, most)
    alone = rows.where("_n = 1").withColumn("_number", F.lit(0).cast("long"))
    many = rows.where("_n > 1").withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk).cast("long"))))
    many = many.repartition("doc_id", "_digest", "_from").withColumn("_number", F.explode(F.sequence("_from", F.least(F.col("_from") + chunk, F.col("_n")) - 1))).drop("_from")
    m = with_targets(alone.unionByName(many), targets, few)
    copies = copies_of(F.col("size"), F.col("_total"), F.col("_target"), draw(F.col("doc_id"), F.col("_digest"), F.col("_number"), seed))
    return m.select("doc_id", "size", F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * copies).cast("long").alias("taken"))


REPORT_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size, md5(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS number FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rn FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, rn, [3.0, 1.0, 2.0][rn % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS budget FROM totals
), rounds AS (
  SELECT 0 AS step, rn, weight, cap, budget, false AS is_full FROM weighted
  UNION ALL
  SELECT step + 1, rn, weight, cap, budget,
         is_full OR (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * weight
                    / sum(CASE WHEN NOT is_full THEN weight END) OVER () > cap
  FROM rounds WHERE step < (SELECT count(*) FROM totals)
), settled AS (
  SELECT rn, CASE WHEN is_full THEN cap
             ELSE (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * weight / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target
  FROM rounds WHERE step = (SELECT max(step) FROM rounds)
), rates AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM weighted JOIN settled USING (rn)
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || digest || ':' || number || ':mix-1'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""
