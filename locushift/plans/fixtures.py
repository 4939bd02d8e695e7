"""Region-shaped inputs derived from the test tables, as Spark frames and as SQL for DuckDB.

Two states with embeddings from ``embeddings``, replicate matrices from ``lineitem`` and ``part``, a contract from
both, and intervals with named anchors from ``events``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import row_numbers
from ..sources.scratch import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh local path for the files that the driver writes."""
    folder = shared_folder(spark, "scratch").removeprefix("file://").removeprefix("file:")
    os.makedirs(folder)
    return os.path.join(folder, name)


def write_lines(rows: DataFrame, path: str, header: list[str]) -> None:
    """A folder of text files: ``header``, then the column ``line`` in ord. Files are ranges of ord, in order of their names;
    no line passes through the driver."""
    spark = rows.sparkSession
    top = spark.createDataFrame([(i, x) for i, x in enumerate(header)], "_at long, line string")
    both = top.select(F.lit(0).alias("_body"), "_at", "line").unionByName(rows.select(F.lit(1).alias("_body"), F.col("ord").cast("long").alias("_at"), "line"))
    both.orderBy("_body", "_at").select("line").write.text(path)


def _state(e: DataFrame, own) -> DataFrame:
    k = F.floor(F.col("vec_id") / 2)
    return e.where(own).select(
        k.alias("ord"), F.concat(F.lit("chr"), (k % 5 + 1).cast("string")).alias("chrom"), (k * 1000).alias("start_pos"), (k * 1000 + 500).alias("end_pos"),
        "embedding", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")[0].cast("double")).alias("signal"),
    )


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return _state(e, F.col("vec_id") % 2 == 0), _state(e, (F.col("vec_id") % 2 == 1) & (F.col("vec_id") % 10 != 1))


STATES_SQL = """
states AS (
  SELECT vec_id, vec_id // 2 AS ord, 'chr' || ((vec_id // 2) % 5 + 1) AS chrom, (vec_id // 2) * 1000 AS start_pos, (vec_id // 2) * 1000 + 500 AS end_pos,
         embedding, CASE WHEN vec_id % 7 <> 0 THEN embedding[1]::DOUBLE END AS signal FROM embeddings
), a AS (SELECT * FROM states WHERE vec_id % 2 = 0), b AS (SELECT * FROM states WHERE vec_id % 2 = 1 AND vec_id % 10 <> 1),
aligned AS (
  SELECT a.ord, a.chrom, a.start_pos, a.end_pos,
         sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: (t[2]::DOUBLE - t[1]::DOUBLE) * (t[2]::DOUBLE - t[1]::DOUBLE)))) AS shift,
         b.signal - a.signal AS delta
  FROM a JOIN b USING (chrom, start_pos, end_pos)
)"""


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, region, raw_score, delta, driver_score, direction, label, confound."""
    items = table(spark, sf_dir, "lineitem").where("l_partkey % 11 <> 0")
    side = F.when(F.col("l_suppkey") % 6 < 3, F.lit(0)).otherwise(F.lit(1))
    sums = items.groupBy("l_partkey").agg(F.sum(F.when(side == 0, F.col("l_quantity"))).cast("double").alias("qa"), F.sum(F.when(side == 1, F.col("l_quantity"))).cast("double").alias("qb"))
    part = table(spark, sf_dir, "part").join(sums, F.col("l_partkey") == F.col("p_partkey"), "left")
    base = part.select(
        F.col("p_partkey").cast("long").alias("ord"), F.concat(F.lit("chr"), (F.col("p_partkey") % 22 + 1).cast("string")).alias("chrom"), (F.col("p_partkey") * 200).cast("long").alias("start_pos"),
        (F.col("p_partkey") * 200 + 100 + F.col("p_size")).cast("long").alias("end_pos"), F.col("p_retailprice").cast("double").alias("raw_score"), (F.col("qb") - F.col("qa")).alias("delta"),
    )
    from ..operators.score import direction, driver_score

    scored = direction(driver_score(base, "raw_score"))
    return scored.withColumn("label", (F.col("ord") % 13 == 0) | (F.col("raw_score") > 1950)).withColumn("confound", F.abs("delta"))


CONTRACT_SQL = """
base AS (
  SELECT p_partkey::BIGINT AS ord, 'chr' || (p_partkey % 22 + 1) AS chrom, (p_partkey * 200)::BIGINT AS start_pos, (p_partkey * 200 + 100 + p_size)::BIGINT AS end_pos,
         p_retailprice::DOUBLE AS raw_score, qb - qa AS delta
  FROM part LEFT JOIN (
    SELECT l_partkey, sum(CASE WHEN l_suppkey % 6 < 3 THEN l_quantity END)::DOUBLE AS qa, sum(CASE WHEN l_suppkey % 6 >= 3 THEN l_quantity END)::DOUBLE AS qb
    FROM lineitem WHERE l_partkey % 11 <> 0 GROUP BY l_partkey) ON l_partkey = p_partkey
), con AS (
  SELECT *, (row_number() OVER (ORDER BY raw_score, ord) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1) AS driver_score,
         delta / max(abs(delta)) OVER () AS direction, (ord % 13 = 0 OR raw_score > 1950) AS label, abs(delta) AS confound FROM base
)"""


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows (ord, sample, is_a, value) of a matrix that Gate 1 rejects."""
    items = table(spark, sf_dir, "lineitem")
    long = items.groupBy(F.col("l_partkey").cast("long").alias("ord"), (F.col("l_suppkey") % 6).cast("int").alias("sample")).agg(F.sum("l_quantity").cast("double").alias("value"))
    return long.select("ord", "sample", (F.col("sample") < 3).alias("is_a"), "value")


def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix with a planted contrast, which Gate 1 admits."""
    dense = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("ord"), F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("sample"))
    both = dense.join(replicates(spark, sf_dir).select("ord", "sample", "value"), ["ord", "sample"], "left")
    planted = F.when(F.col("sample") < 3, F.col("ord") % 7).otherwise((F.col("ord") * 5 + 3) % 7)
    return both.select("ord", "sample", (F.col("sample") < 3).alias("is_a"), (F.lit(1000.0) * (1 + planted) + F.coalesce("value", F.lit(0.0))).alias("value"))


CONTRAST_SQL = """
mat AS (SELECT l_partkey::BIGINT AS ord, (l_suppkey % 6)::INTEGER AS sample, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY ALL),
contrast AS (
  SELECT p_partkey::BIGINT AS ord, s.sample, s.sample < 3 AS is_a,
         1000.0::DOUBLE * (1 + CASE WHEN s.sample < 3 THEN p_partkey % 7 ELSE (p_partkey * 5 + 3) % 7 END) + coalesce(value, 0) AS value
  FROM part CROSS JOIN (SELECT unnest(range(6))::INTEGER AS sample) s LEFT JOIN mat ON mat.ord = p_partkey AND mat.sample = s.sample
), depth AS (SELECT sample, sum(value) AS d FROM contrast GROUP BY sample),
cpm AS (SELECT c.ord, c.sample, c.is_a, ln(1 + value / d * 1e6) AS v FROM contrast c JOIN depth USING (sample))"""


def intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(regions, anchors): anchors have a gene and a value."""
    e = table(spark, sf_dir, "events")
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    all_ = e.select(F.col("event_id").cast("long").alias("ord"), F.col("event_type").alias("chrom"), start.cast("long").alias("start_pos"), F.col("value").cast("double").alias("value"))
    all_ = all_.withColumn("end_pos", F.col("start_pos") + 1 + F.floor(F.col("value") * 60).cast("long"))
    named = all_.withColumn("gene", F.concat(F.lit("g"), (F.col("ord") % 40).cast("string")))
    columns = ["ord", "chrom", "start_pos", "end_pos", "value"]
    return all_.where("ord % 97 <> 0").select(columns), named.where("ord % 97 = 0").select(*columns, "gene")


INTERVALS_SQL = """
iv AS (
  SELECT event_id::BIGINT AS ord, event_type AS chrom, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS start_pos, value::DOUBLE AS value, 'g' || (event_id % 40) AS gene FROM events
), ivs AS (SELECT *, start_pos + 1 + floor(value * 60)::BIGINT AS end_pos FROM iv),
regions AS (SELECT * FROM ivs WHERE ord % 97 <> 0), anchors AS (SELECT * FROM ivs WHERE ord % 97 = 0),
pairs AS (
  SELECT r.ord, r.chrom, r.start_pos, r.end_pos, x.ord AS r_ord, x.start_pos AS r_start_pos, x.end_pos AS r_end_pos, x.value AS r_value, x.gene AS r_gene
  FROM regions r JOIN anchors x ON r.chrom = x.chrom AND r.start_pos < x.end_pos AND r.end_pos > x.start_pos
)"""


def with_row(df: DataFrame, ord_: str = "ord") -> DataFrame:
    """Adds ``row``, the 0-based place by ord."""
    return row_numbers(df, ord_, ord_, name="_r").select(*df.columns, (F.col("_r") - 1).alias("row"))
