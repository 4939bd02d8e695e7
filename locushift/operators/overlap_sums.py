"""Sums over a region's overlapping intervals by motif, without the pairs.

Where regions and intervals lie dense, their pairs grow with the square of the rows, and the sums by region and motif are
most of the result. So regions are dealt by stretches of a chromosome, each region to the one that it starts in, and the
intervals to all stretches whose regions may meet them; a task works out the sums of a stretch's regions and puts them
out, and no sum is shuffled. Of a stretch with many regions, parts go to several tasks.

The intervals that a region overlaps are those that start within it and those that hold its start. Both are looked up in
tables of partial sums which are only ever added, never taken from one another, so that a large value, an infinity or a
NaN changes no sum but those of the regions that overlap it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import PLACE

#: Regions that a task takes at once; stretches of this many times the regions' mean length.
ROWS, MEANS = 1 << 15, 16


def range_sums(values: np.ndarray):
    """A function of (low, high) to the sums of values[low:high], 0 where empty: of two partial sums each, which lead away
    from the middle of the smallest block of the table that holds both ends."""
    n = max(1, len(values))
    depth = max(1, (n - 1).bit_length())
    padded = np.zeros(1 << depth)
    padded[: len(values)] = values
    table = np.empty((depth, 1 << depth))
    for level in range(depth):
        blocks = padded.reshape(-1, 2, 1 << level)
        own = table[level].reshape(blocks.shape)
        np.cumsum(blocks[:, 0, ::-1], axis=1, out=own[:, 0, ::-1])
        np.cumsum(blocks[:, 1], axis=1, out=own[:, 1])
    levels = np.array([0, *(i.bit_length() - 1 for i in range(1, 1 << depth))], np.int8)

    def at(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        a, b = np.minimum(low, n - 1), np.maximum(high - 1, 0)
        level = levels[a ^ b]
        both = np.where(a == b, padded[a], table[level, a] + table[level, b])
        return np.where(high > low, both, 0.0)

    return at


def stabbed(first: np.ndarray, last: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Per place 0 to n - 1 the sum of the values of the ranges first[i]:last[i] that hold it. A range is cut into blocks of
    nested sizes, and a block's sum goes down to its halves."""
    depth = max(0, (n - 1).bit_length())
    low, high, blocks = first.copy(), last.copy(), []
    for level in range(depth + 1):
        own, open_ = np.zeros(1 << (depth - level)), low < high
        left = open_ & (low % 2 == 1)
        np.add.at(own, low[left], values[left])
        low = low + left
        right = (low < high) & (high % 2 == 1)
        np.add.at(own, high[right] - 1, values[right])
        high = high - right
        blocks.append(own)
        low, high = low // 2, high // 2
    total = blocks[-1]
    for own in blocks[-2::-1]:
        total = own + np.repeat(total, 2)
    return total[:n]


def sums_by_motif(start: np.ndarray, end: np.ndarray, hits) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray]]:
    """(motif, rows, sums, known) of each motif: the regions that overlap any of its intervals, their sums over values that
    are not NULL, and whether there is such a value. hits: an Arrow table with start_pos, end_pos, motif and value."""
    coded = hits.column("motif").combine_chunks().dictionary_encode("encode")
    motif = coded.indices.to_numpy()
    from_, to = (hits.column(c).to_numpy() for c in ("start_pos", "end_pos"))
    value = hits.column("value").combine_chunks()
    given = value.is_valid().to_numpy(zero_copy_only=False)
    value = value.fill_null(0.0).to_numpy()
    # Doubled places: an empty interval lies just before its start, so that it is within regions that start before it only.
    key = 2 * from_ - (to <= from_)
    keys, stops = np.unique(key), np.unique(np.concatenate([from_ + 1, to]))
    ends = (np.searchsorted(keys, 2 * start), np.searchsorted(keys, 2 * end - 1), np.searchsorted(stops, start, "right"))
    order = np.lexsort((key, motif))
    bounds = np.searchsorted(motif[order], np.arange(len(coded.dictionary) + 1))

    def places(own, all_, side, found, direct):
        """Where ``direct`` would stand among a motif's own sorted places, by way of its place among all motifs'."""
        if len(all_) > len(direct):
            return np.searchsorted(own, direct, side)
        return np.searchsorted(own, np.append(all_, np.iinfo(np.int64).max), "left")[found] if side == "left" else np.concatenate([[0], np.searchsorted(own, all_, "right")])[found]

    for m, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
        at = order[i:j]
        odd, at = at[to[at] < from_[at]], at[to[at] >= from_[at]]
        low = places(key[at], keys, "left", ends[0], 2 * start)
        high = np.maximum(low, places(key[at], keys, "left", ends[1], 2 * end - 1))
        wide = at[to[at] > from_[at] + 1]
        own = np.unique(np.concatenate([from_[wide] + 1, to[wide]]))
        where, size = places(own, stops, "right", ends[2], start), len(own) + 1  # 0: before the first
        first, last = np.searchsorted(own, from_[wide] + 1) + 1, np.searchsorted(own, to[wide]) + 1
        total = range_sums(value[at])(low, high) + stabbed(first, last, value[wide], size)[where]

        def counted(x, at=at, wide=wide, low=low, high=high, first=first, last=last, where=where, size=size):
            upto = np.concatenate([[0], np.cumsum(x[at])])
            steps = np.bincount(first, x[wide], size + 1) - np.bincount(last, x[wide], size + 1)
            return upto[high] - upto[low] + np.cumsum(steps).astype(np.int64)[where]

        n = counted(np.ones(len(value), np.int64))
        known = n if given[at].all() else counted(given.astype(np.int64))
        for h in odd:  # an interval that ends before its start, which counts where a region reaches over both ends
            met = (start < to[h]) & (end > from_[h])
            total, n, known = total + np.where(met, value[h], 0.0), n + met, known + (met & given[h])
        for r in np.flatnonzero(end < start):  # a region that does: intervals that reach over both its ends
            met = order[i:j][(from_[order[i:j]] < end[r]) & (to[order[i:j]] > start[r])]
            total[r], n[r], known[r] = value[met].sum(), len(met), given[met].sum()
        rows = np.flatnonzero(n)
        if len(rows):
            yield coded.dictionary[m], rows, total[rows], known[rows] > 0


def width_for(regions: float, hits: float) -> int:
    """A power of two above ``MEANS`` times the regions' mean length and above the intervals': those then make three rows
    each on average at most."""
    return 1 << max(7, math.ceil(math.log2(max(MEANS * regions, hits, 1.0))))


def by_stretches(peaks: DataFrame, hits: DataFrame, width: int, names: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """ord, motif, score of regions (ord, chrom, start_pos, end_pos) of at most ``width`` positions; with ``names`` every
    region once instead, and a column for each of these motifs, 0 where it has no sum. Positions are whole numbers."""
    at = lambda c: F.floor(c / width).cast("long")
    placed = " AND ".join(f"{c} IS NOT NULL" for c in PLACE)
    left = peaks.where(placed).select("ord", "chrom", *[F.col(c).cast("long").alias(c) for c in PLACE[1:]]).withColumn("_stretch", at(F.col("start_pos")))
    low, high = F.least("start_pos", "end_pos"), F.greatest("start_pos", "end_pos")
    right = hits.select("chrom", *[F.col(c).cast("long").alias(c) for c in PLACE[1:]], "motif", F.col("value").cast("double").alias("value")).where(placed)
    right = right.withColumn("_stretch", F.explode(F.sequence(at(low) - 1, at(high))))
    # Stretches of more than ``rows`` regions, at most a row for so many regions, and in how many parts they go.
    parts = left.groupBy("chrom", "_stretch").count().where(F.col("count") > rows).select("chrom", "_stretch", F.ceil(F.col("count") / rows).cast("int").alias("_parts"))
    left = left.join(F.broadcast(parts), ["chrom", "_stretch"], "left").withColumn("_part", F.pmod(F.xxhash64("ord"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = right.join(F.broadcast(parts), ["chrom", "_stretch"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    ord_ = peaks.schema["ord"].dataType.simpleString()
    motif = hits.schema["motif"].dataType.simpleString()

    def work(peaks_, hits_):
        import pyarrow as pa

        np.seterr(invalid="ignore", over="ignore")  # opposite infinities make NaN
        start, end = (peaks_.column(c).to_numpy() for c in PLACE[1:])
        ids = peaks_.column("ord").combine_chunks()
        found = sums_by_motif(start, end, hits_) if len(start) and len(hits_) else ()
        if names is not None:
            columns = {n: np.zeros(len(start)) for n in names}
            for name, at_, total, known in found:
                if (own := columns.get(name.as_py())) is not None:
                    own[at_] = np.where(known, total, 0.0)
            return pa.table({"ord": ids, **columns})
        made = pa.schema([("ord", ids.type), ("motif", hits_.schema.field("motif").type), ("score", pa.float64())])
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([ids.take(pa.array(at_)), pa.repeat(name, len(at_)), pa.array(total, mask=~known)], schema=made) for name, at_, total, known in found], made)

    key = ("chrom", "_stretch", "_part")  # of other names on either side: both may come from one table
    schema = f"ord {ord_}, " + ("motif " + motif + ", score double" if names is None else ", ".join(f"`{n}` double" for n in names))
    one, other = (df.select(*[F.col(c).alias(f"{side}_{c}" if c in key else c) for c in df.columns]) for side, df in (("l", left), ("r", right)))
    out = one.groupBy(*[f"l_{c}" for c in key]).cogroup(other.groupBy(*[f"r_{c}" for c in key])).applyInArrow(work, schema)
    return out if names is None else out.unionByName(peaks.where(f"NOT ({placed})").select("ord", *[F.lit(0.0).alias(n) for n in names]))
