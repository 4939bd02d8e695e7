"""Weights of all regions for a panel of transitions, from measured accessibility.

    python -m jobs.weigh_transitions --regions part.parquet --counts lineitem.parquet --out weights [--config panel.json]

A transition has two states, each a range of days in which its counts were taken. A region's weight is the rank of how
much its count changed between the states (a missing count is 0 there); its direction is the change over the largest
one, and NULL unless both states have a count. The panel's config has each transition's gates, as the gates' own run
judged them; of a transition that both admit, the top share of regions by the primary score is nominated, and of any
other none, with the reason in the log.

Counts are summed in one pass for all transitions. Output: Parquet, a folder for each transition and chromosome. A
transition's folder is replaced as a whole, so a rerun gives the same files' content, and a run that broke off is
mended by the next; transitions that the config no longer names keep their folders.

Defined results: rows of counts without a region or a day count nowhere, and counts of regions that are not given are
left out; no region at all gives no folder; a region without counts has change 0, ranked by ord; two transitions of one
id, or an id that no folder may have, raise ValueError before anything is written.
"""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, read_config, shipped_config, start_log
from locushift.functions.columns import direction_field, score_field
from locushift.operators import nominate, score

WEIGHTS = "ord long, start_pos long, end_pos long, driver_score double, direction double, rank int, nomination_score double, transition string, chrom string"
REGION = ["chrom", "start_pos", "end_pos"]


def check(config: dict) -> list[dict]:
    found = config["transitions"]
    ids = [t["id"] for t in found]
    if len(set(ids)) < len(ids) or not all(re.fullmatch(r"[A-Za-z0-9_-]+", i) for i in ids):
        raise ValueError(f"transitions need different ids of letters, digits, _ and -: {ids}")
    return found


def changes(regions: DataFrame, counts: DataFrame, transitions: list[dict]) -> DataFrame:
    """ord, region, and for each transition the counts of both states (a0, b0, a1, ...): one aggregate over the counts."""
    day = F.col("l_shipdate").cast("date")
    within = lambda span: (day >= F.lit(span[0]).cast("date")) & (day < F.lit(span[1]).cast("date"))
    sums = [F.sum(F.when(within(t[s]), F.col("l_quantity"))).cast("double").alias(f"{s}{i}") for i, t in enumerate(transitions) for s in ("a", "b")]
    per = counts.groupBy(F.col("l_partkey").alias("_k")).agg(*sums)
    key = F.col("p_partkey").cast("long")
    own = regions.select(key.alias("ord"), F.concat(F.lit("chr"), (key % 22 + 1).cast("string")).alias("chrom"), (key * 200).alias("start_pos"), (key * 200 + 100 + F.col("p_size")).cast("long").alias("end_pos"))
    return own.join(per, F.col("ord") == F.col("_k"), "left").drop("_k")


def scores(table: DataFrame, i: int) -> DataFrame:
    """Driver score and direction of one transition."""
    a, b = F.col(f"a{i}"), F.col(f"b{i}")
    base = table.select("ord", *REGION, F.abs(F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0))).alias("change"), (b - a).alias("delta"))
    return score.driver_score(score.direction(base), "change").select("ord", *REGION, "driver_score", "direction")


def weighed(scored: DataFrame, transition: dict, top: float) -> tuple[DataFrame, dict]:
    """The weights of one transition with its nominations' rank and score, and the nominations' block."""
    rows, block = nominate.nominated(scored, transition.get("gate1"), transition.get("gate2"), top)
    own = scored.select("ord", *REGION, score_field(F.col("driver_score")).alias("driver_score"), direction_field(F.col("direction")).alias("direction"))
    return own.join(rows.select(*REGION, "rank", "nomination_score"), REGION, "left"), block


def run(spark: SparkSession, regions: str, counts: str, out: str, config: dict) -> dict[str, dict]:
    """Writes every transition's weights below ``out``; the nominations' blocks by transition."""
    transitions, found = check(config), {}
    read = spark.read.parquet(counts)
    table = changes(spark.read.parquet(regions).select("p_partkey", "p_size"), read.select("l_partkey", "l_shipdate", "l_quantity"), transitions).cache()
    try:
        n = table.count()
        log.info("read %s regions from %s and %s counts from %s", n, regions, read.count(), counts)
        for i, t in enumerate(transitions if n else []):
            path, scored = f"{out}/transition={t['id']}", scores(table, i).cache()  # nominations take it several times
            try:
                weights, found[t["id"]] = weighed(scored, t, config["top"])
                weights.hint("rebalance", "chrom").write.mode("overwrite").partitionBy("chrom").parquet(path)
            finally:
                scored.unpersist()
            wrote = spark.read.parquet(path).agg(F.count(F.lit(1)), F.count("rank")).first()
            log.info("wrote %s weights, %s of them nominated, to %s%s", *wrote, path, f" ({why})" if (why := found[t["id"]]["refusal_reason"]) else "")
    finally:
        table.unpersist()
    return found


def output(spark: SparkSession, out: str) -> DataFrame:
    """The weights of all transitions."""
    return spark.read.schema(WEIGHTS).parquet(out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("regions", "counts", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    start_log()
    spark = SparkSession.builder.appName("weigh_transitions").getOrCreate()
    try:
        run(spark, a.regions, a.counts, a.out, read_config(spark, a.config) if a.config else shipped_config("weigh_transitions"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
