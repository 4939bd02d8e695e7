"""Writers. Bundle files are single, byte-exact text files, so numbers are formatted by Python; tables go to Parquet."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 4
BUNDLE_VERSION = "1"


def score_text(x: float) -> str:
    return str(round(min(1.0, max(0.0, float(x))), DIGITS))


def direction_text(x: float | None) -> str:
    """Empty if unmeasured; 0.0 if measured and flat."""
    return "" if x is None or x != x else str(round(min(1.0, max(-1.0, float(x))), DIGITS))


def _write(path: str, header: list[str], rows: Iterable[list]) -> None:
    with open(path, "w") as f:
        f.write("\t".join(header) + "\n")
        f.writelines("\t".join(map(str, r)) + "\n" for r in rows)


def contract(df: DataFrame, path: str) -> int:
    """A weights file in ord; the direction column only if any direction was measured. Streams partition by partition."""
    measured = df.agg(F.count("direction")).first()[0] > 0
    header = ["chrom", "start", "end", "driver_score", *["direction"] * measured]
    rows = df.orderBy("ord").toLocalIterator(prefetchPartitions=True)
    _write(path, header, ([r["chrom"], r["start_pos"], r["end_pos"], score_text(r["driver_score"]), *[direction_text(r["direction"])] * measured] for r in rows))
    return len(header)


def nominations(df: DataFrame, path: str) -> None:
    rows = df.orderBy("rank").toLocalIterator()
    _write(path, ["chrom", "start", "end", "rank", "nomination_score", "direction"], ([r["chrom"], r["start_pos"], r["end_pos"], r["rank"], score_text(r["nomination_score"]), direction_text(r["direction"])] for r in rows))


def bundle(folder: str, manifest: dict, weights: DataFrame, nominated: DataFrame) -> None:
    """manifest.json, weights.tsv and nominations.tsv; the version is the writer's."""
    os.makedirs(folder, exist_ok=True)
    contract(weights, os.path.join(folder, "weights.tsv"))
    nominations(nominated, os.path.join(folder, "nominations.tsv"))
    with open(os.path.join(folder, "manifest.json"), "w") as f:
        json.dump(manifest | {"bundle_version": BUNDLE_VERSION}, f, indent=2)


def artifact(df: DataFrame, path: str, *, model: str, cell_state: str, assembly: str, source: str) -> tuple[int, int]:
    """A state with its meta, as Parquet or, by the name of the path, as a numpy archive; returns (regions, dimension).

    All embeddings must have one dimension.
    """
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.count("signal").alias("signals")).first()
    if stats["n"] and stats["low"] != stats["high"]:
        raise ValueError(f"embeddings have {stats['low']} to {stats['high']} dimensions")
    kept = df.select("ord", "chrom", F.col("start_pos").cast("long"), F.col("end_pos").cast("long"), F.col("embedding").cast("array<float>"), F.col("signal").cast("float"))
    meta = {"model": model, "cell_state": cell_state, "assembly": assembly, "dim": stats["low"], "source": source, "has_signal": stats["signals"] > 0}
    if path.endswith(".npz"):
        _archive(kept, path, stats["n"], stats["low"] or 0, meta)
        return stats["n"], stats["low"] or 0
    kept.write.parquet(f"{path}/regions")
    df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/_meta.json")
    return stats["n"], stats["low"] or 0


def _archive(df: DataFrame, path: str, n: int, dim: int, meta: dict) -> None:
    """One array after the other, in ord, streamed partition by partition into the archive."""
    import zipfile

    import numpy as np

    width = df.agg(F.max(F.length("chrom"))).first()[0] or 1
    arrays = {"chrom": ("chrom", f"<U{width}", ()), "start": ("start_pos", "<i8", ()), "end": ("end_pos", "<i8", ()), "embedding": ("embedding", "<f4", (dim,))}
    if meta["has_signal"]:
        arrays["signal"] = ("signal", "<f4", ())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("meta.npy", "w") as f:
            np.save(f, np.array(json.dumps(meta)))
        for name, (column, dtype, shape) in arrays.items():
            with z.open(f"{name}.npy", "w", force_zip64=True) as f:
                np.lib.format.write_array_header_1_0(f, {"descr": dtype, "fortran_order": False, "shape": (n, *shape)})
                for row in df.select("ord", column).orderBy("ord").toLocalIterator(prefetchPartitions=True):
                    f.write(np.asarray(np.nan if row[1] is None else row[1], dtype).tobytes())


def report(row: dict, title: str) -> str:
    """A result as text, one line per field."""
    return "\n".join([title, *(f"  {k}: {v:.4f}" if isinstance(v, float) else f"  {k}: {v}" for k, v in row.items())])


def hits(df: DataFrame, path: str) -> None:
    """A table that ``readers.hits`` scans by chrom."""
    df.repartition("chrom").sortWithinPartitions("start_pos").write.partitionBy("chrom").parquet(path)


def state_matrix(df: DataFrame, path: str) -> None:
    """cell, ord, region, value; one folder per cell."""
    df.write.partitionBy("cell").parquet(path)


def motif_matrix(df: DataFrame, path: str) -> None:
    df.write.parquet(path)
