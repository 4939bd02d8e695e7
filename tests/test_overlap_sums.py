import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locushift.operators import overlap_sums, prepare

PEAKS, HITS = "ord long, chrom string, start_pos long, end_pos long", "chrom string, start_pos long, end_pos long, motif string, value double"


def brute(peaks, hits):
    """(peak, motif) to the values of the overlapping hits."""
    want = {}
    for i, c, s, e in peaks:
        for d, a, b, m, v in hits:
            if c == d and s is not None and s < b and e > a:
                want.setdefault((i, m), []).extend([] if v is None else [v])
    return want


def close(got, values):
    if not values:
        return got is None
    odd = {v for v in values if not math.isfinite(v)}
    if odd:
        want = odd.pop() if len(odd) == 1 else math.nan
        return math.isnan(got) if math.isnan(want) else got == want
    return got == pytest.approx(math.fsum(values), rel=1e-12, abs=1e-12 * max(abs(v) for v in values))


@pytest.mark.filterwarnings("ignore:invalid value")
@pytest.mark.parametrize("values", [[1.0, 2.5, -1.0, None], [1e300, 0.01, 3.0], [math.inf, -math.inf, math.nan, 0.5, None]])
def test_sums_against_brute_force(values):
    """Empty and reversed intervals, NULL motifs and values, and large values beside small ones."""
    rng = random.Random(7)
    place = lambda: (s := rng.randint(-20, 60), s + rng.choice([0, 1, 2, 5, 20, 60, -3]))
    for n_peaks, n_hits in ((1, 1), (3, 40), (40, 3), (50, 50)):
        for _ in range(10):
            peaks = [(i, "a", *place()) for i in range(n_peaks)]
            hits = [("a", *place(), rng.choice(["x", "y", None]), rng.choice(values)) for _ in range(n_hits)]
            table = pa.table({k: pa.array([h[i] for h in hits], t) for i, (k, t) in enumerate((("start_pos", pa.int64()), ("end_pos", pa.int64()), ("motif", pa.string()), ("value", pa.float64())), 1)})
            start, end = (np.array([p[i] for p in peaks]) for i in (2, 3))
            found = {(int(r), m.as_py()): float(x) if k else None for m, *columns in overlap_sums.sums_by_motif(start, end, table) for r, x, k in zip(*columns, strict=True)}
            want = brute(peaks, hits)
            assert found.keys() == want.keys() and all(close(found[k], v) for k, v in want.items())


def test_many_hits_make_no_pairs(spark, monkeypatch):
    """Sums by stretches, also where a stretch goes in parts: no pairs, and no shuffle of the sums."""
    rng = random.Random(3)
    peaks = [(i, rng.choice("ab"), s, s + rng.randint(0, 60)) for i in range(300) for s in [rng.randint(0, 3000)]] + [(300, None, 5, 9), (301, "a", None, 9)]
    hits = [(rng.choice("ab"), s, s + rng.randint(0, 200), rng.choice(["x", "y", "z"]), float(i % 9)) for i in range(200) for s in [rng.randint(-100, 3000)]]
    want = brute(peaks, hits)
    left, right = spark.createDataFrame(peaks, PEAKS), spark.createDataFrame(hits, HITS)

    def pairs(*_, **__):
        raise AssertionError("pairs of many hits")

    monkeypatch.setattr(prepare, "overlap_pairs", pairs)
    sums = prepare.motif_sums(left, right, few=-1)
    parts = overlap_sums.by_stretches(left, right, 128, rows=7)
    for found in (sums, parts):
        rows = found.collect()
        assert len(rows) == len(want) and all(close(r.score, want[r.ord, r.motif]) for r in rows)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapCoGroupsInArrow")]


def test_few_hits_and_far_longer_peaks(spark):
    """The ways to the sums agree: by pairs, by stretches, and by pairs for the peaks that no stretch holds."""
    rng = random.Random(5)
    peaks = [(i, "a", s, s + rng.randint(1, 9)) for i in range(400) for s in [rng.randint(0, 9000)]] + [(400, "a", 0, 9000), (401, "a", 100, 7000)]
    hits = [("a", s, s + 30, f"m{i % 3}", 1.0 + i) for i in range(60) for s in [rng.randint(0, 9000)]]
    left, right = spark.createDataFrame(peaks, PEAKS), spark.createDataFrame(hits, HITS)
    assert prepare._width(left, right, -1)[1]
    of = lambda few: (sorted(map(tuple, prepare.motif_sums(left, right, few).collect())), sorted(map(tuple, prepare.motif_table(left, right, ["m1"], few).collect())))
    assert of(-1) == of(1000) and len(of(-1)[1]) == 402
    assert {r.ord for r in prepare.motif_sums(left, right, -1).where(F.col("ord") >= 400).collect()} == {400, 401}


def test_a_table_of_many_hits_is_not_shuffled(spark, monkeypatch):
    """Every peak has a row, also without hits or without a place, and is its own row of the table from the start."""
    rng = random.Random(8)
    peaks = [(i, rng.choice("ab"), s, s + rng.randint(0, 60)) for i in range(200) for s in [rng.randint(0, 3000)]] + [(200, None, 5, 9), (201, "a", None, 9), (202, "c", 1, 2)]
    hits = [(rng.choice("ab"), s, s + rng.randint(0, 200), rng.choice(["x", "y", "z"]), None if i % 7 == 0 else float(i % 9)) for i in range(100) for s in [rng.randint(-100, 3000)]]
    want = brute(peaks, hits)
    monkeypatch.setattr(prepare, "overlap_pairs", None)
    table = prepare.motif_table(spark.createDataFrame(peaks, PEAKS), spark.createDataFrame(hits, HITS), ["y", "none"], few=-1)
    assert sorted(map(tuple, table.collect())) == [(p[0], math.fsum(want.get((p[0], "y"), [])), 0.0) for p in peaks]
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapCoGroupsInArrow")]
