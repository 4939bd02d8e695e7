"""The weights job: by SQL on the given tables, and by hand on small ones."""

import json
from datetime import datetime

import pytest

from jobs import weigh_transitions as job

PANEL = {
    "top": 0.4,
    "transitions": [
        {"id": "one", "a": ["2000-01-01", "2000-02-01"], "b": ["2000-02-01", "2000-03-01"], "gate1": {"admit": True}, "gate2": {"primary": "driver_score"}},
        {"id": "two", "a": ["2000-02-01", "2000-03-01"], "b": ["2000-01-01", "2000-02-01"], "gate1": None, "gate2": None},
    ],
}


def tables(spark, folder, counts, parts=5):
    spark.createDataFrame([(i, i + 1, "x") for i in range(parts)], "p_partkey long, p_size int, transition string").write.mode("overwrite").parquet(f"{folder}/part")
    spark.createDataFrame([(k, d, q, "x") for k, d, q in counts], "l_partkey long, l_shipdate timestamp, l_quantity double, chrom string").write.mode("overwrite").parquet(f"{folder}/counts")
    return f"{folder}/part", f"{folder}/counts"


def rows(spark, out):
    return sorted((r.transition, r.ord, r.chrom, r.driver_score, r.direction, r["rank"]) for r in job.output(spark, out).collect())


JAN, FEB = datetime(2000, 1, 5), datetime(2000, 2, 5)
COUNTS = [(0, JAN, 5.0), (0, FEB, 1.0), (1, JAN, 2.0), (2, FEB, 2.0), (2, JAN, 1.0), (2, JAN, 1.0), (3, datetime(1999, 1, 1), 9.0), (9, JAN, 7.0), (None, JAN, 1.0), (1, None, 50.0), (1, JAN, None)]


def test_weights_and_nominations(spark, tmp_path):
    regions, counts = tables(spark, tmp_path, COUNTS)
    found = job.run(spark, regions, counts, f"{tmp_path}/out", PANEL)
    assert [found[k]["refused"] for k in ("one", "two")] == [False, True]
    one = [(0, "chr1", 1.0, -1.0, 1), (1, "chr2", 0.75, None, 2), (2, "chr3", 0.0, 0.0, None), (3, "chr4", 0.25, None, None), (4, "chr5", 0.5, None, None)]
    two = [(o, c, s, -d if d else d, None) for o, c, s, d, _ in one]
    assert rows(spark, f"{tmp_path}/out") == [("one", *x) for x in one] + [("two", *x) for x in two]


def test_a_rerun_changes_nothing_and_new_counts_replace_all(spark, tmp_path):
    regions, counts = tables(spark, tmp_path, COUNTS)
    job.run(spark, regions, counts, f"{tmp_path}/out", PANEL)
    before = rows(spark, f"{tmp_path}/out")
    job.run(spark, regions, counts, f"{tmp_path}/out", PANEL)
    assert rows(spark, f"{tmp_path}/out") == before
    tables(spark, tmp_path, [*COUNTS, (4, FEB, 100.0)], parts=4)  # a region goes, and its chromosome's folder with it
    job.run(spark, regions, counts, f"{tmp_path}/out", PANEL)
    assert [r[1] for r in rows(spark, f"{tmp_path}/out")] == [0, 1, 2, 3] * 2


def test_no_rows(spark, tmp_path):
    regions, counts = tables(spark, tmp_path, [], parts=3)
    job.run(spark, regions, counts, f"{tmp_path}/out", PANEL)
    assert [r[3:5] for r in rows(spark, f"{tmp_path}/out")] == [(0.0, None), (0.5, None), (1.0, None)] * 2
    regions, counts = tables(spark, tmp_path, COUNTS, parts=0)
    assert job.run(spark, regions, counts, f"{tmp_path}/other", PANEL) == {}


@pytest.mark.parametrize("ids", [["x", "x"], ["../x"], [""]])
def test_ids(ids):
    with pytest.raises(ValueError):
        job.check({"transitions": [{"id": i} for i in ids]})


def test_config_is_read_by_spark(spark, tmp_path):
    from jobs.common import read_config, shipped_config

    (tmp_path / "panel.json").write_text(json.dumps(PANEL, indent=1))
    assert read_config(spark, f"{tmp_path}/panel.json") == PANEL
    assert job.check(shipped_config("weigh_transitions"))
