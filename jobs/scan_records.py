"""Which records mention which terms, kept up as records arrive.

    python -m jobs.scan_records --records documents.parquet --out mentions --checkpoint mentions-mark [--config scan.json]

Before tracks and panels are chosen, descriptions of data sets are searched for the names of states and factors. This
job keeps that search current: a file stream takes the files that it has not seen (its mark is the stream's checkpoint),
finds each term literally and without case in the whole text, and appends one row for each record and term it mentions.
It stops when it has caught up, so it is run again whenever files have come.

Output: Parquet, a folder for each term: doc_id, source, lang, n_mentions (without overlaps) and first_at (1-based place
of the first). Spark's file sink and checkpoint commit each batch once, so a run that broke off goes on where it was and
a rerun over the same files changes nothing. A record that comes again in a new file is a new record.

Defined results: a record without text mentions nothing; a null doc_id, source or lang stays null; equal records each
have their rows; no file yet, or none that is new, adds nothing; no term, an empty one or one given twice (without case) raises ValueError. A checkpoint belongs to its terms: with other terms, which would miss the files seen before, start another
output and checkpoint; a run with other terms raises ValueError.
"""

from __future__ import annotations

import argparse
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, read_config, shipped_config, start_log
from locushift.functions.columns import mentions

RECORDS = "doc_id long, source string, lang string, text string"
MENTIONS = "doc_id long, source string, lang string, n_mentions long, first_at long, term string"
KEPT_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"


def check(terms: list[str]) -> list[str]:
    own = [t.lower() for t in terms]
    if not own or not all(own) or len(set(own)) < len(own):
        raise ValueError(f"terms must be given, differ (without case) and not be empty: {terms}")
    return own


def mentioned(records: DataFrame, terms: list[str]) -> DataFrame:
    """A row for each record and term that its text mentions."""
    found = records.where("text is not null").select("*", F.lower("text").alias("_text"), F.explode(mentions(terms, "text")).alias("term"))
    word = F.col("term")
    n = (F.length("_text") - F.length(F.replace("_text", word, F.lit("")))) / F.length(word)
    return found.select("doc_id", "source", "lang", n.cast("long").alias("n_mentions"), F.instr(F.col("_text"), word).cast("long").alias("first_at"), "term")


def same_terms(spark: SparkSession, path: str, terms: list[str]) -> None:
    """Keeps the terms beside the checkpoint; raises if they are others than those of the first run."""
    wanted = json.dumps(sorted(terms))
    try:
        kept = spark.read.text(path).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = None
    if kept is None:
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif kept[0] != wanted:
        raise ValueError(f"this checkpoint is of the terms {kept[0]}, not {wanted}")


def as_pattern(path: str) -> str:
    """A pattern that this path alone matches: a file stream takes a folder or a pattern, not the path of a single file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]" if path[-1:].isalnum() else path


def run(spark: SparkSession, records: str, out: str, checkpoint: str, config: dict) -> tuple[int, int]:
    """Takes what is new; how many records it read and how many batches that took."""
    terms = check(config["terms"])
    same_terms(spark, f"{checkpoint}/terms", terms)
    stream = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", int(config.get("files_per_batch", 64))).parquet(as_pattern(records))
    sink = mentioned(stream, terms).writeStream.format("parquet").partitionBy("term").option("path", out).option("checkpointLocation", f"{checkpoint}/stream")
    before = spark.conf.get(KEPT_PROGRESS)
    spark.conf.set(KEPT_PROGRESS, "100000")  # so that the log's counts cover every batch
    try:
        running = sink.trigger(availableNow=True).start()
    finally:
        spark.conf.set(KEPT_PROGRESS, before)
    running.awaitTermination()
    read = [p["numInputRows"] for p in running.recentProgress]
    log.info("read %s new records from %s in %s batches; appended their mentions of %s terms to %s", sum(read), records, sum(n > 0 for n in read), len(terms), out)
    return sum(read), sum(n > 0 for n in read)


def output(spark: SparkSession, out: str) -> DataFrame:
    """All that the runs so far have found."""
    return spark.read.schema(MENTIONS).parquet(out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("records", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    start_log()
    spark = SparkSession.builder.appName("scan_records").getOrCreate()
    try:
        run(spark, a.records, a.out, a.checkpoint, read_config(spark, a.config) if a.config else shipped_config("scan_records"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
