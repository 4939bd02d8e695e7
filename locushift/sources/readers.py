"""Readers. Text files keep their row order in ``ord``; empty direction fields are NULL (unmeasured)."""

from __future__ import annotations

import io
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite


def lines(spark: SparkSession, path: str) -> DataFrame:
    """ord (0-based line number) and value. Lines are numbered within each block of a file, and by what comes before it."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    rows = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("_id"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n")).select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = rows.withColumn("_own", F.row_number().over(W.partitionBy("_file", "_block").orderBy("_id")) - 1)
    return own.join(F.broadcast(blocks), ["_file", "_block"]).select((F.col("_own") + F.col("_before")).cast("long").alias("ord"), "value")


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file, or of the first file by name of a folder (a plain read begins with the largest)."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    return rows.orderBy("_file", "_block", "_id").select("value").first()[0]


def _fields(df: DataFrame) -> DataFrame:
    return df.withColumn("f", F.split("value", "\t"))


def _field(i: int) -> Column:
    return F.nullif(F.trim(F.get("f", F.lit(i))), F.lit(""))


def contract(spark: SparkSession, path: str) -> DataFrame:
    """A weights file by its header's names; a missing or empty direction is NULL."""
    found = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    names = {"chrom": "chrom", "start": "start_pos", "end": "end_pos", "driver_score": "driver_score"}
    missing = set(names) - set(found.columns)
    if missing:
        raise ValueError(f"the contract lacks the columns {sorted(missing)}")
    header = found.columns
    body = _fields(lines(spark, path)).where(F.trim("value") != "").where(F.col("ord") > 0)
    at = lambda n: _field(header.index(n))
    direction = finite(at("direction").try_cast("double")) if "direction" in header else F.lit(None).cast("double")
    return body.select((F.col("ord") - 1).alias("ord"), at("chrom").alias("chrom"), at("start").cast("long").alias("start_pos"), at("end").cast("long").alias("end_pos"), at("driver_score").cast("double").alias("driver_score"), direction.alias("direction"))


def track(spark: SparkSession, path: str) -> DataFrame:
    """A weights file or value track by position: value is the fourth column, direction the fifth, if any.

    Blank lines, comments and a header line are skipped.
    """
    body = _fields(lines(spark, path)).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    header = F.lower(_field(0)).isin("chrom", "chr") & _field(1).try_cast("long").isNull()
    body = body.where(~F.coalesce(header, F.lit(False)))
    return body.select("ord", _field(0).alias("chrom"), _field(1).cast("long").alias("start_pos"), _field(2).cast("long").alias("end_pos"), finite(_field(3).try_cast("double")).alias("value"), finite(_field(4).try_cast("double")).alias("direction"))


def bed(spark: SparkSession, path: str, unnamed: str = "null") -> DataFrame:
    """Intervals; ``gene`` from the fourth column. Without one: NULL, "" (empty) or row<line number> (row)."""
    if unnamed not in ("null", "empty", "row"):
        raise ValueError(f"unnamed is null, empty or row, not {unnamed!r}")
    body = _fields(lines(spark, path)).where((F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)"))
    other = {"null": F.lit(None).cast("string"), "empty": F.lit(""), "row": F.concat(F.lit("row"), F.col("ord").cast("string"))}[unnamed]
    return body.select("ord", _field(0).alias("chrom"), _field(1).cast("long").alias("start_pos"), _field(2).cast("long").alias("end_pos"), F.coalesce(_field(3), other).alias("gene"))


def replicates(spark: SparkSession, path: str, state_a: str, state_b: str) -> DataFrame:
    """Long rows (ord, sample, is_a, value) of the columns whose header holds a state's name, a's first."""
    header = first_line(spark, path).split("\t")
    a, b = ([i for i, h in enumerate(header) if s in h] for s in (state_a, state_b))
    if not a or not b:
        raise SystemExit(f"no column holds {state_a if not a else state_b!r}")
    body = _fields(lines(spark, path)).where((F.col("ord") > 0) & (F.trim("value") != ""))
    picked = [(n, i, n < len(a)) for n, i in enumerate([*a, *b])]
    cells = F.array(*[F.struct(F.lit(n).alias("sample"), F.lit(own).alias("is_a"), _field(i).cast("double").alias("value")) for n, i, own in picked])
    return body.select((F.col("ord") - 1).alias("ord"), F.explode(cells).alias("c")).select("ord", "c.*")


def intensity(spark: SparkSession, path: str, column: str | int, header: bool = True) -> DataFrame:
    """A value track whose value column is given by name or 0-based place."""
    body = _fields(lines(spark, path)).where(F.trim("value") != "")
    if isinstance(column, str) and not column.isdigit():
        names = first_line(spark, path).split("\t")
        if not header or column not in names:
            raise SystemExit(f"no column is named {column!r}")
        column = names.index(column)
    body = body.where(F.col("ord") > 0) if header else body
    return body.select("ord", _field(0).alias("chrom"), _field(1).cast("long").alias("start_pos"), _field(2).cast("long").alias("end_pos"), finite(_field(int(column)).try_cast("double")).alias("value"))


def names(spark: SparkSession, path: str) -> list[str]:
    return [r[0] for r in lines(spark, path).where(F.trim("value") != "").orderBy("ord").select("value").collect()]


def nominations(spark: SparkSession, path: str) -> DataFrame:
    """A nominations file; header only (a refusal) gives no rows."""
    body = _fields(lines(spark, path)).where((F.col("ord") > 0) & (F.trim("value") != ""))
    return body.select(_field(0).alias("chrom"), _field(1).cast("long").alias("start_pos"), _field(2).cast("long").alias("end_pos"), _field(3).cast("int").alias("rank"), _field(4).cast("double").alias("nomination_score"), _field(5).try_cast("double").alias("direction"))


ARTIFACT = "ord long, chrom string, start_pos long, end_pos long, embedding array<float>, signal float"


def artifact(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A state's regions with embeddings and signal, and its meta. Parquet folder, or a numpy archive read by an executor.

    An archive without meta is described by what it holds: dim and has_signal.
    """
    if not path.endswith(".npz"):
        meta = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/_meta.json").collect()))
        return spark.read.parquet(f"{path}/regions").withColumn("signal", finite(F.col("signal"))), meta

    def rows(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for content in f["content"]:
                z = np.load(io.BytesIO(content), allow_pickle=False)
                signal = z["signal"].astype("f4") if "signal" in z.files else np.full(len(z["chrom"]), np.nan, "f4")
                yield pd.DataFrame({"ord": np.arange(len(z["chrom"])), "chrom": z["chrom"].astype(str), "start_pos": z["start"], "end_pos": z["end"], "embedding": list(z["embedding"].astype("f4")), "signal": signal})

    def meta_of(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            archives = [np.load(io.BytesIO(c), allow_pickle=False) for c in f["content"]]
            yield pd.DataFrame({"meta": [str(z["meta"]) if "meta" in z.files else json.dumps({"dim": int(z["embedding"].shape[1]), "has_signal": "signal" in z.files}) for z in archives]})

    binary = spark.read.format("binaryFile").load(path).select("content")
    meta = json.loads(binary.mapInPandas(meta_of, "meta string").first()[0])
    return binary.mapInPandas(rows, ARTIFACT).withColumn("signal", finite(F.col("signal")).cast("float")), meta


def transition(path: str, default: dict) -> dict:
    with open(path) as f:
        return default | json.load(f)


def _parsed(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Binary files read on executors; ``parse``: (content, path) to a pandas frame per file."""

    def rows(frames):
        for f in frames:
            for content, name in zip(f["content"], f["path"], strict=True):
                yield parse(content, name)

    return spark.read.format("binaryFile").load(path).select("content", "path").mapInPandas(rows, schema)


def chain(spark: SparkSession, path: str) -> DataFrame:
    """Lift-over chain files (plain or gzip) as blocks: ord (within its chain), chrom, start_pos, end_pos, to_chrom, to_start,
    sign, and the chain's score and id. Files are split at the chains' headers, so a plain file is read by several tasks."""

    def blocks(frames):
        import pandas as pd

        for f in frames:
            out = []
            for text in f["value"]:
                rows = [r.split() for r in text.removeprefix("chain ").splitlines() if r.strip() and not r.startswith("#")]
                if not rows:  # comments before the first chain
                    continue
                score, name, _, _, start, _, to, size, strand, to_start, *rest = rows[0]
                t, q, forward = int(start), int(to_start), strand == "+"
                for i, (n, *gaps) in enumerate(rows[1:]):
                    end = t + int(n)
                    out.append((i, name, t, end, to, q if forward else int(size) - 1 - q, 1 if forward else -1, float(score), int(rest[1]) if len(rest) > 1 else None))
                    if gaps:
                        t, q = end + int(gaps[0]), q + int(n) + int(gaps[1])
            yield pd.DataFrame(out, columns=["ord", "chrom", "start_pos", "end_pos", "to_chrom", "to_start", "sign", "score", "id"]).astype({"id": "Int64"})

    found = spark.read.option("lineSep", "\nchain ").text(path)
    return found.mapInPandas(blocks, "ord long, chrom string, start_pos long, end_pos long, to_chrom string, to_start long, sign int, score double, id long")


def vector(spark: SparkSession, path: str) -> DataFrame:
    """A one-dimensional .npy file as (row, value)."""

    def parse(content: bytes, name: str):
        import numpy as np
        import pandas as pd

        x = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
        return pd.DataFrame({"row": np.arange(len(x)), "value": x})

    return _parsed(spark, path, parse, "row long, value double")


def hits(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """Rows of a table partitioned by chrom that overlap the regions: other partitions are not read."""
    from ..operators.intervals import overlap_flag

    table = spark.read.parquet(path)
    table = table.join(regions.select("chrom").distinct(), "chrom", "left_semi").select(table.columns)
    return overlap_flag(table, regions, "_hit").where("_hit").drop("_hit")


def state_matrix(spark: SparkSession, path: str, cell: str | None = None) -> DataFrame:
    """Long state x region values (cell, ord, chrom, start_pos, end_pos, value), of one cell or all."""
    table = spark.read.parquet(path)
    return table if cell is None else table.where(F.col("cell") == cell)


def motif_matrix(spark: SparkSession, path: str, expected: list[str]) -> DataFrame:
    """A motif matrix whose names must stand in the expected order."""
    from ..operators.prepare import check_names

    table = spark.read.parquet(path)
    check_names([c for c in table.columns if c not in ("ord", "chrom", "start_pos", "end_pos")], expected)
    return table
