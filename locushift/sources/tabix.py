"""Block-gzipped tables of regions with an index beside each file (.tbi), scanned by range.

A block-gzipped file is a chain of gzip members of at most 64 KB of text; a place in it (a virtual offset) is a block's
place in the file, shifted by 16 bits, and a place in the block's text. The index has, for each chromosome, chunks
(pairs of places) by bins of six sizes, each record in the smallest bin that holds it, and for each 16 KB window the
first place that can reach into it.

Regions meet the index as a join: their bins find the chunks, windows rule out those that end before a region can
begin, and only the chunks left are read, dealt to tasks by their places. Nothing of regions, index or hits passes
through the driver, and a file is neither read nor decompressed outside those chunks.

Defined results: a record counts once, whatever number of regions it overlaps; an empty record (end = start) overlaps
what spans its place; comment and blank lines are skipped; a chromosome that the index lacks has no hits; no regions,
no hits; other columns are kept in ``fields``. Positions beyond 2**29 don't fit this kind of index and raise on writing.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.intervals import covered, overlap_pairs
from .ranges import opened, put
from .scratch import kept

#: Fixed values of the format: each level's first bin and the bits of a position that its bins hold.
LEVELS = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26), (0, 29))
MOST = 1 << 29
WINDOW_BITS = 14
TEXT = 0xFF00  # bytes of text in a block
ROWS = 500_000  # records of a file, about
PART = 1 << 19  # bytes of files for a reading task, about
BED = 0x10000  # the format flag for 0-based, half-open positions
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")  # the empty block that ends a file
INDEX = "file string, chrom string, kind string, bin int, first long, after long, c_chrom int, c_start int, c_end int, base int"


# --- blocks ---------------------------------------------------------------------------------------------------------


def block(text: bytes) -> bytes:
    """One block of at most 64 KB of text."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(text) + packer.flush()
    return struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(data) + 25) + data + struct.pack("<2I", zlib.crc32(text), len(text))


def texts(file, first: int, after: int, last: dict[int, tuple[int, bytes]] | None = None) -> Iterator[tuple[int, bytes]]:
    """The text between two places, block by block, with the place at which each part begins. last: holds the file's block
    that was read last, as neighbouring parts often share one."""
    last = {} if last is None else last
    at, skip = first >> 16, first & 0xFFFF
    while at < after >> 16 or at == after >> 16 and skip < after & 0xFFFF:
        if at not in last:
            file.seek(at)
            head = file.read(18)
            if len(head) < 18:
                return
            size = struct.unpack("<H", head[16:18])[0] + 1
            last.clear()
            last[at] = size, zlib.decompress(file.read(size - 18)[:-8], -15)
        size, text = last[at]
        yield at << 16 | skip, text[skip : after & 0xFFFF] if at == after >> 16 else text[skip:]
        at, skip = at + size, 0


# --- index ----------------------------------------------------------------------------------------------------------


def parsed_index(data: bytes) -> Iterator[tuple]:
    """(chrom, kind, bin or window, first, after, columns of chrom, start and end, 1 if positions count from 1)."""
    data = gzip.decompress(data)
    magic, n, flags, c_chrom, c_start, c_end, _, _, length = struct.unpack_from("<4s8i", data)
    if magic != b"TBI\1":
        raise ValueError("not a tabix index")
    names = data[36 : 36 + length].split(b"\0")[:n]
    at, columns = 36 + length, (c_chrom - 1, c_start - 1, (c_end or c_start) - 1, 0 if flags & BED else 1)
    for name in names:
        (bins,), at = struct.unpack_from("<i", data, at), at + 4
        for _ in range(bins):
            (number, chunks), at = struct.unpack_from("<Ii", data, at), at + 8
            for first, after in np.frombuffer(data, "<u8", 2 * chunks, at).reshape(-1, 2).tolist():
                if number < 37450:  # the one beyond holds counts
                    yield name.decode(), "bin", number, first, after, *columns
            at += 16 * chunks
        (windows,), at = struct.unpack_from("<i", data, at), at + 4
        for i, first in enumerate(np.frombuffer(data, "<u8", windows, at).tolist()):
            yield name.decode(), "window", i, first, None, *columns
        at += 8 * windows


def index(spark: SparkSession, path: str) -> DataFrame:
    """The indexes below a path, or beside a file, as rows: chunks by bin, and first places by window."""

    def work(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(name.removesuffix(".tbi"), *r) for r in parsed_index(content)]
                for i in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 50_000], strict=True), kinds, strict=True)], names=names)

    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in INDEX.split(", ")]
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tbi").load(f"{path}.tbi" if path.endswith(".gz") else path)
    return found.select("path", "content").mapInArrow(work, INDEX)


def bins_of(start: Column, end: Column) -> Column:
    """All bins that may hold a record that overlaps [start, end)."""
    low, last = F.greatest(start, F.lit(0)), F.greatest(F.least(end, F.lit(MOST)) - 1, start, F.lit(0))
    return F.flatten(F.array(*[F.sequence(first + F.shiftright(low, bits), first + F.shiftright(last, bits)) for first, bits in LEVELS]))


def chunks(found: DataFrame, regions: DataFrame) -> DataFrame:
    """The parts of the files that can hold overlapping records, without overlaps of their own: file, first, after and the columns' places."""
    own = regions.where(F.col("start_pos") < MOST).select("chrom", F.shiftright(F.greatest("start_pos", F.lit(0)), WINDOW_BITS).cast("int").alias("window"), F.explode(bins_of(F.col("start_pos"), F.col("end_pos")).cast("array<int>")).alias("bin"))
    wanted = own.groupBy("chrom", "bin").agg(F.min("window").alias("window"))
    windows = found.where("kind = 'window'").select("file", "chrom", F.col("bin").alias("window"), F.col("first").alias("least"))
    hit = found.where("kind = 'bin'").join(wanted, ["chrom", "bin"]).join(windows, ["file", "chrom", "window"], "left")
    hit = hit.where(F.col("after") > F.coalesce("least", F.lit(0))).withColumn("first", F.greatest("first", F.coalesce("least", F.lit(0))))
    # An indexer may merge neighbouring chunks of a bin over records of another bin.
    before = W.partitionBy("file", "chrom").orderBy("first", "after").rowsBetween(W.unboundedPreceding, -1)
    cut = hit.withColumn("first", F.greatest("first", F.coalesce(F.max("after").over(before), F.lit(0))))
    return cut.where("first < after").select("file", "first", "after", "c_chrom", "c_start", "c_end", "base")


def records(parts: DataFrame) -> DataFrame:
    """The records of the given parts: file, at (a record's place), chrom, start_pos, end_pos, fields. Tasks take neighbouring parts."""
    names = ["file", "at", "line", "c_chrom", "c_start", "c_end", "base"]

    def work(batches):
        name, file, last = None, None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, file, last = row["file"], opened(row["file"]), {}
                rest, at = b"", row["first"]
                for place, text in texts(file, row["first"], row["after"], last):
                    lines = (rest + text).split(b"\n")
                    # A line's place: the block it ends in, and how far into the part; equal for every reader of the part.
                    rest = lines.pop()
                    if lines:
                        n = len(lines)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n) + place), pa.array(lines, pa.binary()).cast(pa.string()), *[pa.array([row[c]] * n, pa.int32()) for c in names[3:]]], names=names)
                    at = place
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at + len(rest) + TEXT]), pa.array([rest], pa.binary()).cast(pa.string()), *[pa.array([row[c]], pa.int32()) for c in names[3:]]], names=names)

    # The parts' rows are few bytes, of which Spark would make one task; what they stand for decides.
    size = parts.agg(F.sum(F.shiftright("after", 16) - F.shiftright("first", 16))).first()[0] or 0
    dealt = parts.repartitionByRange(size // PART + 1, "file", "first").sortWithinPartitions("file", "first")
    lines = dealt.mapInArrow(work, "file string, at long, line string, c_chrom int, c_start int, c_end int, base int")
    fields = lines.where((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("fields", F.split("line", "\t"))
    number = lambda c: F.get("fields", F.col(c)).cast("long")
    return fields.select("file", "at", F.get("fields", F.col("c_chrom")).alias("chrom"), (number("c_start") - F.col("base")).alias("start_pos"), number("c_end").alias("end_pos"), "fields")


def scan(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """file, at, chrom, start_pos, end_pos, fields: the records that overlap any of the regions (chrom, start_pos, end_pos), each once."""
    own = kept(covered(regions), "covered")
    found = records(kept(chunks(index(spark, path), own), "chunks"))
    first = F.col("r_reach").isNull() | (F.col("r_reach") <= F.col("start_pos"))  # one of the stretches that a record overlaps
    return overlap_pairs(found, own).where(first).select(found.columns)


# --- writing --------------------------------------------------------------------------------------------------------


def smallest_bin(start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The number of the smallest bin that holds each record."""
    out = np.zeros(len(start), np.int64)
    for first, bits in reversed(LEVELS):
        out = np.where(start >> bits == last >> bits, first + (start >> bits), out)
    return out


def packed(chrom: list[str], start: np.ndarray, end: np.ndarray, lines: list[bytes]) -> tuple[bytes, bytes]:
    """A file and its index, from records in order of chromosome and start."""
    if len(end) and int(end.max()) > MOST:
        raise ValueError(f"positions beyond {MOST} don't fit a tabix index")
    size = np.array([len(x) + 1 for x in lines], np.int64)
    ends = np.cumsum(size)
    text = b"".join(x + b"\n" for x in lines)
    body, places = [], []
    for at in range(0, len(text), TEXT):
        places.append(sum(map(len, body[-1:])) + (places[-1] if places else 0))
        body.append(block(text[at : at + TEXT]))
    places.append(sum(map(len, body[-1:])) + (places[-1] if places else 0))
    virtual = lambda x: np.array(places, np.int64)[x // TEXT] << 16 | x % TEXT
    first, after = virtual(ends - size), virtual(ends)
    names = list(dict.fromkeys(chrom))
    index_ = [struct.pack("<4s8i", b"TBI\1", len(names), BED, 1, 2, 3, ord("#"), 0, sum(len(n.encode()) + 1 for n in names)), b"".join(n.encode() + b"\0" for n in names)]
    chrom_at = np.array([names.index(c) for c in chrom]) if len(names) < 64 else np.array(list(map({n: i for i, n in enumerate(names)}.get, chrom)))
    last = np.maximum(end - 1, start)
    bins = smallest_bin(start, last)
    for i in range(len(names)):
        own = np.flatnonzero(chrom_at == i)
        new = np.flatnonzero(np.append(True, bins[own][1:] != bins[own][:-1]))  # runs of records of one bin are its chunks
        by: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(new.tolist(), [*(new[1:] - 1).tolist(), len(own) - 1], strict=True):
            by.setdefault(int(bins[own[a]]), []).append((int(first[own[a]]), int(after[own[b]])))
        index_.append(struct.pack("<i", len(by)))
        for number, found in by.items():
            index_.append(struct.pack("<Ii", number, len(found)) + np.array(found, "<u8").tobytes())
        windows = np.full(int(last[own].max() >> WINDOW_BITS) + 1, -1, np.int64)
        low, high = start[own] >> WINDOW_BITS, last[own] >> WINDOW_BITS
        for w in range(int((high - low).max()) + 1):
            reach = low + w <= high
            at = (low + w)[reach]
            windows[at[::-1]] = np.where(windows[at[::-1]] < 0, first[own][reach][::-1], np.minimum(windows[at[::-1]], first[own][reach][::-1]))
        known = 0
        for w in range(len(windows)):  # a window that nothing reaches has the place of the one before
            known = windows[w] = windows[w] if windows[w] >= 0 else known
        index_.append(struct.pack("<i", len(windows)) + windows.astype("<u8").tobytes())
    raw = b"".join(index_)
    return b"".join(body) + END, b"".join(block(raw[i : i + TEXT]) for i in range(0, len(raw), TEXT)) + END


def write(df: DataFrame, path: str, files: int | None = None) -> int:
    """chrom, start_pos, end_pos and all other columns (as text) to ``files`` files or fewer (by default 8, or more, so that
    each has about ROWS rows) with an index each, dealt by ranges of chromosome and start; the number of rows. A file is
    named by its range, so a task that is run again writes the same file; each is made up in its task's memory."""
    rest = [c for c in df.columns if c not in ("chrom", "start_pos", "end_pos")]
    line = F.concat_ws("\t", "chrom", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest])
    rows = df.select("chrom", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), line.alias("line"))
    files = files or max(8, -(-df.count() // ROWS))
    dealt = rows.repartitionByRange(files, "chrom", "start_pos").sortWithinPartitions("chrom", "start_pos", "end_pos", "line").withColumn("part", F.spark_partition_id())

    def work(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            data, found = packed(t.column("chrom").to_pylist(), t.column("start_pos").to_numpy(), t.column("end_pos").to_numpy(), [x.encode() for x in t.column("line").to_pylist()])
            name = f"{path}/part-{t.column('part')[0].as_py():05d}.bed.gz"
            put(name, data)
            put(f"{name}.tbi", found)
            yield pa.RecordBatch.from_arrays([pa.array([t.num_rows])], names=["n"])

    return dealt.mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
