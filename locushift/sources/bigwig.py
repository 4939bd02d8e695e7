"""bigWig tracks, read section by section through their index.

A file has a tree of its chromosomes and a tree of its data sections, each with the range it covers and its place.
``sections`` turns the trees into rows (the index alone is read, by one task a file); those rows are joined with the
regions by overlap, and only the sections left are read, unpacked and turned into rows, dealt to tasks by their places.
Means over regions are then those of any value track, with places without a value as 0.

Defined results: a chromosome that the file lacks has no values (mean 0); sections of all three kinds (ranges, starts
with a fixed span, fixed steps) and of both byte orders are read; values are 32-bit floats, as the format has them; a
value that is not finite is left out; no regions, nothing read; a file of another kind raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import overlap_pairs, weighted_mean
from .ranges import opened, put

#: Fixed values of the format: its magic numbers, and the kinds of sections.
MAGIC, CHROM_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
RANGES, STARTS, STEPS = 1, 2, 3
SECTIONS = "file string, chrom string, chrom_id long, start_pos long, end_pos long, offset long, size long, packed boolean, big boolean"
VALUES = "chrom string, start_pos long, end_pos long, value double"
ITEMS, FANOUT = 1024, 256  # items in a section, children of a node, when writing


class Trees:
    """The header and both trees of an open file."""

    def __init__(self, file):
        self.file = file
        head = file.read(64)
        self.order = next((o for o in "<>" if len(head) == 64 and struct.unpack(o + "I", head[:4])[0] == MAGIC), None)
        if not self.order:
            raise ValueError("not a bigWig file")
        self.chrom_at, _, self.index_at = struct.unpack(self.order + "3Q", head[8:32])
        self.packed = struct.unpack(self.order + "I", head[52:56])[0] > 0

    def at(self, place: int, form: str) -> tuple:
        self.file.seek(place)
        return struct.unpack(self.order + form, self.file.read(struct.calcsize(self.order + form)))

    def chroms(self) -> Iterator[tuple[int, str, int]]:
        """(id, name, length)."""
        magic, _, key, _, _, _ = self.at(self.chrom_at, "4I2Q")
        if magic != CHROM_MAGIC:
            raise ValueError("no chromosome tree")
        todo = [self.chrom_at + 32]
        while todo:
            place = todo.pop()
            leaf, _, n = self.at(place, "2BH")
            for i in range(n):
                name, *value = self.at(place + 4 + i * (key + 8), f"{key}s" + ("2I" if leaf else "Q"))
                if leaf:
                    yield value[0], name.rstrip(b"\0").decode(), value[1]
                else:
                    todo.append(value[0])

    def leaves(self) -> Iterator[tuple[int, ...]]:
        """(first chromosome, start, last chromosome, end, offset, size) of the data sections."""
        if self.at(self.index_at, "I")[0] != INDEX_MAGIC:
            raise ValueError("no section index")
        todo = [self.index_at + 48]
        while todo:
            place = todo.pop()
            leaf, _, n = self.at(place, "2BH")
            found, step = self.at(place + 4, ("4I2Q" if leaf else "4IQ") * n), 6 if leaf else 5
            for i in range(n):
                own = found[i * step : (i + 1) * step]
                if leaf:
                    yield own
                else:
                    todo.append(own[4])


def sections(spark: SparkSession, path: str) -> DataFrame:
    """The data sections of a file, or of all files with names in .bw or .bigWig below a folder."""

    def work(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                trees = Trees(opened(name))
                chroms = {i: (c, length) for i, c, length in trees.chroms()}
                rows = []
                for first, start, last, end, offset, size in trees.leaves():
                    for i in range(first, last + 1):
                        rows.append((name, chroms[i][0], i, start if i == first else 0, end if i == last else chroms[i][1], offset, size, trees.packed, trees.order == ">"))
                for i in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + 50_000]], schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SECTIONS.split(", ")])
    names = schema.names
    reader = spark.read.format("binaryFile")
    found = reader.load(path) if path.endswith((".bw", ".bigWig")) else reader.option("pathGlobFilter", "*.{bw,bigWig}").load(path)
    return found.select("path").mapInArrow(work, SECTIONS)


def items(data: bytes, order: str, chrom: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and values of a section, if it is of this chromosome."""
    own, start, _, step, span, kind, _, n = struct.unpack(order + "5I2BH", data[:24])
    if own != chrom:
        n = 0
    if kind == RANGES:
        x = np.frombuffer(data, np.dtype([("s", order + "u4"), ("e", order + "u4"), ("v", order + "f4")]), n, 24)
        return x["s"].astype(np.int64), x["e"].astype(np.int64), x["v"].astype(np.float64)
    if kind == STARTS:
        x = np.frombuffer(data, np.dtype([("s", order + "u4"), ("v", order + "f4")]), n, 24)
        at, value = x["s"].astype(np.int64), x["v"].astype(np.float64)
    elif kind == STEPS:
        at, value = start + step * np.arange(n, dtype=np.int64), np.frombuffer(data, order + "f4", n, 24).astype(np.float64)
    else:
        raise ValueError(f"no such kind of section: {kind}")
    return at, at + span, value


def values(found: DataFrame) -> DataFrame:
    """The values of the given sections: chrom, start_pos, end_pos, value."""

    def work(batches):
        name, file = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != name:
                    name, file = r["file"], opened(r["file"])
                file.seek(r["offset"])
                data = file.read(r["size"])
                start, end, value = items(zlib.decompress(data) if r["packed"] else data, "<>"[r["big"]], r["chrom_id"])
                yield pa.RecordBatch.from_arrays([pa.array([r["chrom"]] * len(start), pa.string()), pa.array(start), pa.array(end), pa.array(value)], names=["chrom", "start_pos", "end_pos", "value"])

    dealt = found.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(work, VALUES).where(~F.isnan("value") & (F.abs("value") != float("inf")))


def track(spark: SparkSession, path: str, regions: DataFrame | None = None) -> DataFrame:
    """The values of a track; with regions, those of the sections that overlap any of them."""
    found = sections(spark, path)
    if regions is not None:
        found = overlap_pairs(found, regions.select("chrom", "start_pos", "end_pos").distinct()).select(found.columns).distinct()
    return values(found)


def mean_over(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """The regions (ord, chrom, start_pos, end_pos) with ``mean0``, the mean over all their places, those without a value as 0."""
    return weighted_mean(regions, track(spark, path, regions))


# --- writing --------------------------------------------------------------------------------------------------------


def _index(leaves: list[tuple[int, ...]], at: int, end: int) -> bytes:
    """The section index, written at ``at``: nodes of FANOUT children, level by level from the root."""
    levels = [[(x[0], x[1], x[2], x[3]) for x in leaves]]
    while len(levels[-1]) > FANOUT:
        below = levels[-1]
        groups = [below[i : i + FANOUT] for i in range(0, len(below), FANOUT)]
        levels.append([(*g[0][:2], *max((x[2], x[3]) for x in g)) for g in groups])
    first, last = leaves[0], max((x[2], x[3]) for x in leaves)
    out = [struct.pack("<2IQ4IQ2I", INDEX_MAGIC, FANOUT, len(leaves), first[0], first[1], *last, end, ITEMS, 0)]
    place = at + 48
    for depth in range(len(levels) - 1, -1, -1):
        level, width = levels[depth], 32 if depth == 0 else 24
        nodes = [range(i, min(i + FANOUT, len(level))) for i in range(0, len(level), FANOUT)]
        next_at = place + sum(4 + width * len(n) for n in nodes)
        place = next_at
        # Children of this level's items are the nodes of the level below, in order.
        child = 24 if depth > 1 else 32
        below = len(levels[depth - 1]) if depth else 0
        for n in nodes:
            out.append(struct.pack("<2BH", depth == 0, 0, len(n)))
            for i in n:
                if depth == 0:
                    out.append(struct.pack("<4I2Q", *level[i], *leaves[i][4:]))
                else:
                    before = min(i * FANOUT, below)
                    out.append(struct.pack("<4IQ", *level[i], next_at + 4 * i + child * before))
    return b"".join(out)


def packed(chrom: list[str], start: np.ndarray, end: np.ndarray, value: np.ndarray) -> bytes:
    """A file from values in order of chromosome and start."""
    names = sorted(set(chrom))
    number = {c: i for i, c in enumerate(names)}
    ids = np.array([number[c] for c in chrom])
    key = max(len(c.encode()) for c in names)
    tree = struct.pack("<4I2Q2BH", CHROM_MAGIC, len(names), key, 8, len(names), 0, 1, 0, len(names))
    tree += b"".join(struct.pack(f"<{key}s2I", c.encode(), i, int(end[ids == i].max())) for c, i in number.items())
    data_at = 64 + 40 + len(tree)
    body, leaves, place = [], [], data_at + 8
    own = np.empty(len(start), np.dtype([("s", "<u4"), ("e", "<u4"), ("v", "<f4")]))
    own["s"], own["e"], own["v"] = start, end, value
    edges = np.flatnonzero(np.diff(ids)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
        for i in range(a, b, ITEMS):
            j = min(i + ITEMS, b)
            low, high = int(start[i]), int(end[i:j].max())
            data = zlib.compress(struct.pack("<5I2BH", int(ids[i]), low, high, 0, 0, RANGES, 0, j - i) + own[i:j].tobytes())
            leaves.append((int(ids[i]), low, int(ids[i]), high, place, len(data)))
            body.append(data)
            place += len(data)
    size, v = (end - start).astype(np.float64), own["v"].astype(np.float64)
    summary = struct.pack("<Q4d", int(size.sum()), v.min(), v.max(), (v * size).sum(), (v * v * size).sum())
    head = struct.pack("<I2H3Q2H2QIQ", MAGIC, 4, 0, 104, data_at, place, 0, 0, 0, 64, 24 + 12 * ITEMS, 0)
    return head + summary + tree + struct.pack("<Q", len(leaves)) + b"".join(body) + _index(leaves, place, place)


def write(df: DataFrame, path: str, files: int = 8) -> int:
    """chrom, start_pos, end_pos, value (without overlaps) to ``files`` files or fewer, dealt by ranges of chromosome and
    start; the number of values. NULL values are left out. A file is named by its range, so a task that is run again
    writes the same file; each is made up in its task's memory."""
    rows = df.where(F.col("value").isNotNull() & (F.col("end_pos") > F.col("start_pos"))).select("chrom", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), F.col("value").cast("double").alias("value"))
    dealt = rows.repartitionByRange(files, "chrom", "start_pos").sortWithinPartitions("chrom", "start_pos", "end_pos", "value").withColumn("part", F.spark_partition_id())

    def work(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            put(f"{path}/part-{t.column('part')[0].as_py():05d}.bw", packed(t.column("chrom").to_pylist(), *(t.column(c).to_numpy() for c in ("start_pos", "end_pos", "value"))))
            yield pa.RecordBatch.from_arrays([pa.array([t.num_rows])], names=["n"])

    return dealt.mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
