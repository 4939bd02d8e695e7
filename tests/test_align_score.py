import numpy as np
import pytest
from pyspark.sql import functions as F

from locushift.functions import columns as C
from locushift.operators import align, score
from locushift.operators.order import average_ranks, row_numbers, top_k

STATE = "ord long, chrom string, start_pos long, end_pos long, embedding array<float>, signal double"


def state(spark, rows):
    return spark.createDataFrame([(i, "chr1", s, s + 50, e, x) for i, (s, e, x) in enumerate(rows)], STATE)


@pytest.fixture(scope="module")
def pair(spark):
    a = state(spark, [(100, [0.0, 0.0], 0.1), (200, [1.0, 0.0], 0.5), (300, [0.0, 2.0], 0.9), (400, [5.0, 5.0], 0.0)])
    b = state(spark, [(300, [3.0, 6.0], 0.3), (500, [0.0, 0.0], 0.0), (100, [3.0, 4.0], 0.6), (200, [1.0, 0.0], 0.5)])
    return a, b


def test_alignment_keeps_the_first_order(pair):
    rows = align.aligned(*pair).orderBy("ord").collect()
    assert [(r.ord, r.start_pos) for r in rows] == [(0, 100), (1, 200), (2, 300)]
    assert [r["shift"] for r in rows] == pytest.approx([5, 0, 5]) and [r.delta for r in rows] == pytest.approx([0.5, 0, -0.6])
    shuffled = align.aligned(*(x.repartition(3).orderBy(F.rand(1)) for x in pair)).orderBy("ord").collect()
    assert shuffled == rows


def test_last_duplicate_counts_and_left_duplicates_match(spark, pair):
    a, b = pair
    twice = b.unionByName(state(spark, [(100, [0.0, 1.0], 0.2)]).withColumn("ord", F.lit(9).cast("long")))
    assert align.aligned(a, twice).where("start_pos = 100").first()["shift"] == 1
    assert align.aligned(a.unionByName(a), b).count() == 6


def test_missing_signal_is_null_not_flat(spark, pair):
    a, b = pair
    assert {r.delta for r in align.aligned(a, b, signal=False).collect()} == {None}
    gone = a.withColumn("signal", C.finite(F.when(F.col("ord") == 0, F.lit(float("nan"))).otherwise(F.col("signal"))))
    rows = {r.ord: r.delta for r in align.aligned(gone, b).collect()}
    assert rows[0] is None and rows[1] == 0


def test_guards(spark, pair):
    a, b = pair
    with pytest.raises(ValueError):
        align.check_states({"assembly": "hg38"}, {"assembly": "mm10"})
    with pytest.raises(ValueError):
        align.check_states({"assembly": "hg38", "dim": 2}, {"assembly": "hg38", "dim": 3})
    with pytest.raises(ValueError):
        align.require_shared(align.aligned(a, b.where("start_pos = 500")))
    with pytest.raises(KeyError):
        align.joined_exactly(a, b.drop("embedding", "signal", "ord"), ["chrom", "start_pos"])


def deltas(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ord long, delta double")


@pytest.mark.parametrize(
    "method, values, want",
    [
        ("maxabs", [0.5, 0.0, -0.6], [0.5 / 0.6, 0, -1]),
        ("raw", [0.3, -2.0, 1.5, -0.4], [0.3, -1, 1, -0.4]),
        ("signed-rank", [-0.2, 0.4, -0.9, 0.1], [-1 / 3, 2 / 3, -1, 0]),
        ("maxabs", [0.3, None, -0.6], [0.5, None, -1]),
        ("maxabs", [0.0, 0.0], [0, 0]),
        ("maxabs", [None, None], [None, None]),
        ("signed-rank", [None, 0.5], [None, 0]),
    ],
)
def test_direction(spark, method, values, want):
    got = [r.direction for r in score.direction(deltas(spark, values), method=method).orderBy("ord").collect()]
    assert len(got) == len(want) and all((g is None and w is None) or g == pytest.approx(w) for g, w in zip(got, want))


def test_driver_scores(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 3.0), (3, 2.0)], "ord long, shift double")
    assert [r.driver_score for r in score.driver_score(df).orderBy("ord").collect()] == pytest.approx([2 / 3, 0, 1, 1 / 3])
    assert [r.driver_score for r in score.driver_score(df, method="minmax").orderBy("ord").collect()] == [1, 0, 1, 0.5]
    flat = df.withColumn("shift", F.lit(2.0))
    assert {r.driver_score for r in score.driver_score(flat, method="minmax").collect()} == {0}
    assert score.driver_score(df.limit(1)).first().driver_score == 0
    for f in (score.driver_score, score.direction):
        with pytest.raises(ValueError):
            f(df.withColumn("delta", F.lit(0.0)), method="other")


def test_fields(spark):
    df = spark.createDataFrame([(1.7, -3.0), (0.12345, None), (-1.0, 0.0), (0.5, float("nan"))], "s double, d double")
    rows = df.select(C.score_field(F.col("s")), C.direction_field(C.finite(F.col("d")))).collect()
    assert [tuple(r) for r in rows] == [(1, -1), (0.1235, None), (0, 0), (0.5, None)]
    key = spark.createDataFrame([("chr1:5-9",), ("bad",)], "k string").select(C.region_parts(F.col("k")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in key] == [("chr1", 5, 9), (None, None, None)]


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_ranks_match_numpy(spark, buckets):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=300), 1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "ord long, x double")
    rn = {r.ord: r.rn for r in row_numbers(df, "x", buckets=buckets).collect()}
    order = sorted(range(300), key=lambda i: (x[i], i))
    assert all(rn[i] == k + 1 for k, i in enumerate(order))
    avg = {r.ord: r.avg_rank for r in average_ranks(df, "x", buckets=buckets).collect()}
    assert all(avg[i] == (x < x[i]).sum() + ((x == x[i]).sum() + 1) / 2 for i in range(300))
    down = {r.ord: r.rn for r in row_numbers(df, "x", descending=True, buckets=buckets).collect()}
    assert [r.ord for r in top_k(df, "x", 5).collect()] == sorted(down, key=down.get)[:5]


def test_tally_and_primary(spark):
    df = spark.createDataFrame([(0, 0.5, 0.9), (1, -0.2, 0.8), (2, 0.0, 0.7), (3, None, 0.6)], "ord long, direction double, driver_score double")
    assert tuple(score.tally(df).first()) == (1, 1, 1, 1)
    signed = {r.ord: r.primary_score for r in score.primary(df, "signed").collect()}
    assert signed == {0: 1.0, 1: 0.5, 2: 0.0}
    assert score.primary(df, "driver").count() == 4


def test_ranks_of_ranks_run_their_rows_once(spark):
    """Each rank or direction took its input twice, so that a chain of n ran it 2**n times."""
    df = spark.createDataFrame([(i, float(i * 7 % 20), float(i % 3 - 1)) for i in range(20)], "ord long, x double, delta double").repartition(2)
    out = score.driver_score(score.direction(score.driver_score(df, "x", name="a")), "a", name="b")
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") == 1, text
    assert all(r.a == r.b and r.direction == r.delta for r in out.collect())
