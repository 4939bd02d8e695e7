"""Streaming extension: the stateless pieces of the region model on unbounded inputs.

The batch statistics need the whole population; labels by overlap with fixed anchors and direction tallies don't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import overlaps


def labelled_stream(regions: DataFrame, anchors: DataFrame, most: int = 100_000) -> DataFrame:
    """Streamed regions with the number of overlapping anchors; anchors are static and of a checked size."""
    if anchors.limit(most + 1).count() > most:
        raise ValueError(f"over {most} anchors; partition them by chrom and run the batch join instead")
    per = anchors.groupBy("chrom").agg(F.collect_list(F.struct("start_pos", "end_pos")).alias("_anchors"))
    joined = regions.join(F.broadcast(per), "chrom", "left")
    hits = F.filter(F.coalesce("_anchors", F.array()), lambda x: overlaps(F.col("start_pos"), F.col("end_pos"), x["start_pos"], x["end_pos"]))
    return joined.select(*regions.columns, F.size(hits).alias("n_anchors"))


def windowed_tally(regions: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Opening, closing, flat and unmeasured regions per time window, with a watermark for late rows."""
    d = F.col("direction")
    return (
        regions.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("window"))
        .agg(F.count_if(d > 0).alias("opening"), F.count_if(d < 0).alias("closing"), F.count_if(d == 0).alias("flat"), F.count_if(d.isNull()).alias("unmeasured"))
    )
