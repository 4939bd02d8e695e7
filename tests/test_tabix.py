"""Range scans over block-gzipped tables."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from locushift.sources import tabix
from locushift.sources.ranges import opened

ROWS = "ord long, chrom string, start_pos long, end_pos long, name string"


def table(n=3000, seed=1, most=2_000_000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(most)
        out.append((i, f"chr{rng.randint(1, 3)}", s, s + rng.choice((0, 1, 50, 500, 20_000, 400_000)), f"n{i % 7}" if i % 5 else None))
    return out


def region_frame(spark, rows):
    return spark.createDataFrame([(c, s, e) for c, s, e in rows], "chrom string, start_pos long, end_pos long")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tabix"))
    frame = spark.createDataFrame(table(), ROWS)
    assert tabix.write(frame, folder, files=3) == 3000
    return folder


def scanned(spark, path, regions):
    return sorted((int(r.fields[3]), r.chrom, r.start_pos, r.end_pos, r.fields[4] or None) for r in tabix.scan(spark, path, region_frame(spark, regions)).collect())


def wanted(regions, rows=None):
    return sorted(r for r in rows or table() if any(r[1] == c and r[2] < e and r[3] > s for c, s, e in regions))


@pytest.mark.parametrize("regions", [
    [("chr1", 1000, 1500)], [("chr2", 0, 1), ("chr2", 16_384, 16_385), ("chr2", 131_071, 131_073)], [("chr3", 0, 1 << 29)], [("chr1", 500_000, 900_000), ("chr1", 600_000, 700_000), ("chr2", 1_999_000, 3_000_000)],
    [("chr9", 0, 10_000)], [("chr1", 2_900_000, 3_000_000)], [], [("chr1", -5, 30_000)], [("chr1", 5, 5)],
])
def test_against_brute_force(spark, written, regions):
    assert scanned(spark, written, regions) == wanted(regions)


def test_files_are_plain_gzip_for_others(spark, written):
    import glob

    lines = [x for f in sorted(glob.glob(f"{written}/*.gz")) for x in gzip.open(f, "rt").read().splitlines()]
    assert sorted(lines) == sorted("\t".join([c, str(s), str(e), str(o), n or ""]) for o, c, s, e, n in table())


def test_one_file_with_comments_and_columns_elsewhere(spark, tmp_path):
    """Header lines before the records; name, chrom, start (from 1), end, as an indexer of another format has them."""
    rows = sorted(table(400), key=lambda r: (r[1], r[2]))
    rows = [r for r in rows if r[3] > r[2]]
    lines = [f"{o}\t{c}\t{s + 1}\t{e}\t{n or ''}".encode() for o, c, s, e, n in rows]
    import numpy as np

    data, found = tabix.packed([r[1] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), lines)
    raw = bytearray(gzip.decompress(found))
    raw[8:24] = b"".join(x.to_bytes(4, "little") for x in (0, 2, 3, 4))
    (tmp_path / "x.gz").write_bytes(data)
    (tmp_path / "x.gz.tbi").write_bytes(gzip.compress(bytes(raw)))
    got = sorted((int(r.fields[0]), r.chrom, r.start_pos, r.end_pos) for r in tabix.scan(spark, f"{tmp_path}/x.gz", region_frame(spark, [("chr2", 100_000, 160_000)])).collect())
    assert got == sorted(r[:4] for r in rows if r[1] == "chr2" and r[2] < 160_000 and r[3] > 100_000) and got


def test_only_the_blocks_needed_are_read(spark, tmp_path):
    rows = [(i, "chr1", i * 100, i * 100 + 50, "x" * 40) for i in range(40_000)]
    tabix.write(spark.createDataFrame(rows, ROWS), str(tmp_path), files=1)
    parts = tabix.chunks(tabix.index(spark, str(tmp_path)), region_frame(spark, [("chr1", 2_000_000, 2_000_100)])).collect()
    blocks = len({place >> 16 for p in parts for place, _ in tabix.texts(opened(p.file), p.first, p.after)})
    every = sum(1 for _ in tabix.texts(opened(parts[0].file), 0, 1 << 62))
    assert 0 < blocks <= 3 and every > 30
    assert scanned(spark, str(tmp_path), [("chr1", 2_000_000, 2_000_100)]) == [(20_000, "chr1", 2_000_000, 2_000_050, "x" * 40)]


def test_overlapping_chunks_are_read_once(spark):
    found = spark.createDataFrame(
        [("f", "c", "bin", 4681, 0, 100, 0, 1, 2, 0), ("f", "c", "bin", 585, 50, 150, 0, 1, 2, 0), ("f", "c", "bin", 0, 60, 90, 0, 1, 2, 0), ("f", "c", "bin", 4682, 150, 160, 0, 1, 2, 0), ("f", "c", "window", 0, 20, None, 0, 1, 2, 0)], tabix.INDEX
    )
    parts = tabix.chunks(found, region_frame(spark, [("c", 0, 100)])).collect()
    assert sorted((p.first, p.after) for p in parts) == [(20, 100), (100, 150)]


def test_bins(spark):
    rows = table(500, 3)
    own = region_frame(spark, [r[1:4] for r in rows]).select("start_pos", "end_pos", tabix.bins_of(F.col("start_pos"), F.col("end_pos")).alias("bins")).collect()
    import numpy as np

    for r in own:
        last = max(r.end_pos - 1, r.start_pos)
        number = tabix.smallest_bin(np.array([r.start_pos]), np.array([last]))[0]
        assert number in r.bins and len(set(r.bins)) == len(r.bins)


def test_positions_beyond_the_format(spark, tmp_path):
    with pytest.raises(Exception, match="don't fit"):
        tabix.write(spark.createDataFrame([(1, "c", 1 << 30, (1 << 30) + 5, "x")], ROWS), str(tmp_path))
    assert tabix.write(spark.createDataFrame([], ROWS), f"{tmp_path}/none") == 0


def test_pairs_do_not_grow_with_regions_that_cover_each_other(spark, tmp_path, monkeypatch):
    rows = [(i, "chr1", i * 10, i * 10 + (i % 3) * 10, None) for i in range(300)]  # some empty, some over a seam
    regions = [("chr1", s, 2000 + s) for s in range(200)] + [("chr1", 2300, 2310), ("chr1", 2310, 2320), ("chr1", 2340, 2340), ("chr1", 2345, 2345)]
    pairs, join = [], tabix.overlap_pairs
    monkeypatch.setattr(tabix, "overlap_pairs", lambda *a: pairs.append(join(*a)) or pairs[0])
    tabix.write(spark.createDataFrame(rows, ROWS), str(tmp_path))
    got = scanned(spark, str(tmp_path), regions)
    assert got == wanted(regions, rows) and got
    assert pairs[0].count() <= 2 * len(got)


def test_reading_tasks_follow_the_bytes_to_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tabix, "PART", 1 << 12, raising=False)
    tabix.write(spark.range(20_000).selectExpr("id ord", "'chr1' chrom", "id * 100 start_pos", "id * 100 + 50 end_pos", "md5(string(id)) name"), str(tmp_path), files=1)
    found = tabix.records(tabix.chunks(tabix.index(spark, str(tmp_path)), region_frame(spark, [("chr1", 0, 1 << 29)])))
    assert found.rdd.getNumPartitions() > 8 and found.count() == 20_000
