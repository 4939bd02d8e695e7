"""bigWig tracks read through their index."""

import random
import struct
import zlib

import numpy as np
import pytest

from locushift.operators.intervals import weighted_mean
from locushift.sources import bigwig
from locushift.sources.ranges import opened

TRACK = "chrom string, start_pos long, end_pos long, value double"
REGIONS = "ord long, chrom string, start_pos long, end_pos long"


def track(n=6000, seed=2):
    rng, at, out = random.Random(seed), {}, []
    for _ in range(n):
        c = f"chr{rng.choice((1, 1, 1, 2, 10))}"
        s = at.get(c, 0) + rng.choice((0, 0, 3, 200))
        at[c] = s + rng.randint(1, 50)
        out.append((c, s, at[c], float(rng.randint(-40, 400)) / 4))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bigwig"))
    assert bigwig.write(spark.createDataFrame([*track(), ("chr1", 5, 9, None), ("chr1", 7, 7, 1.0)], TRACK), path, files=3) == 6000
    return path


def test_all_values_come_back(spark, folder):
    assert sorted(map(tuple, bigwig.track(spark, folder).collect())) == sorted(track())


def test_mean_over_regions(spark, folder):
    rng = random.Random(5)
    rows = [(i, rng.choice(("chr1", "chr2", "chr10", "chr99")), s, s + rng.choice((1, 40, 3000, 200_000))) for i in range(60) for s in [rng.randrange(250_000)]]
    regions = spark.createDataFrame(rows, REGIONS)
    got = {r.ord: r.mean0 for r in bigwig.mean_over(spark, folder, regions).collect()}
    want = {r.ord: r.mean0 for r in weighted_mean(regions, spark.createDataFrame(track(), TRACK)).collect()}
    assert got == pytest.approx(want) and got[0] is not None
    for i, c, s, e in rows[:10]:
        assert got[i] == pytest.approx(sum(v * max(0, min(e, b) - max(s, a)) for k, a, b, v in track() if k == c) / (e - s))


def test_only_sections_that_overlap_are_read(spark, folder):
    every = bigwig.sections(spark, folder)
    one = spark.createDataFrame([(0, "chr2", 10, 20)], REGIONS)
    n = bigwig.track(spark, folder, one).count()
    assert 0 < n <= bigwig.ITEMS and every.count() >= 6
    assert bigwig.track(spark, folder, one.where("false")).count() == 0


def test_index_of_several_levels(tmp_path):
    n = bigwig.FANOUT * bigwig.FANOUT + 700  # sections
    leaves = [(i // 1000, i * 10, i // 1000, i * 10 + 10, i, 7) for i in range(n)]
    data = struct.pack("<I2H3Q2H2QIQ", bigwig.MAGIC, 4, 0, 0, 0, 64, 0, 0, 0, 0, 1, 0) + bigwig._index(leaves, 64, 64)
    (tmp_path / "x.bw").write_bytes(data)
    assert sorted(bigwig.Trees(opened(str(tmp_path / "x.bw"))).leaves()) == sorted(leaves)


def test_kinds_of_sections_and_byte_order(spark, tmp_path):
    """One file made by hand in the other byte order, with a section of each kind, one not packed away from its chromosome."""
    def section(chrom, start, end, step, span, kind, n, body):
        return struct.pack(">5I2BH", chrom, start, end, step, span, kind, 0, n) + body

    bodies = [
        section(0, 100, 130, 0, 10, bigwig.STARTS, 2, struct.pack(">IfIf", 100, 1.5, 120, 2.5)), section(0, 200, 240, 20, 5, bigwig.STEPS, 3, struct.pack(">3f", 1, float("nan"), 3)),
        section(1, 5, 9, 0, 0, bigwig.RANGES, 1, struct.pack(">2If", 5, 9, -4)),
    ]
    data = [zlib.compress(b) for b in bodies]
    tree = struct.pack(">4I2Q2BH", bigwig.CHROM_MAGIC, 2, 4, 8, 2, 0, 1, 0, 2) + struct.pack(">4s2I4s2I", b"chrA", 0, 1000, b"b", 1, 50)
    places = np.cumsum([64 + len(tree), *map(len, data)]).tolist()
    leaves = [(0, 100, 0, 130), (0, 200, 0, 240), (1, 5, 1, 9)]
    index = struct.pack(">2IQ4IQ2I", bigwig.INDEX_MAGIC, 3, 3, 0, 100, 1, 9, places[3], 3, 0) + struct.pack(">2BH", 1, 0, 3) + b"".join(struct.pack(">4I2Q", *x, p, len(d)) for x, p, d in zip(leaves, places, data))
    head = struct.pack(">I2H3Q2H2QIQ", bigwig.MAGIC, 4, 0, 64, 0, places[3], 0, 0, 0, 0, 1000, 0)
    (tmp_path / "own.bigWig").write_bytes(head + tree + b"".join(data) + index)
    got = sorted(map(tuple, bigwig.track(spark, str(tmp_path / "own.bigWig")).collect()))
    assert got == [("b", 5, 9, -4.0), ("chrA", 100, 110, 1.5), ("chrA", 120, 130, 2.5), ("chrA", 200, 205, 1.0), ("chrA", 240, 245, 3.0)]


def test_other_files(tmp_path):
    (tmp_path / "x.bw").write_bytes(b"no" * 50)
    with pytest.raises(ValueError):
        bigwig.Trees(opened(str(tmp_path / "x.bw")))
