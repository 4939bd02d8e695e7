"""The scan job over growing input."""

import pytest

from jobs import scan_records as job

CONFIG = {"terms": ["Foo", "a b"], "files_per_batch": 1}


def add(spark, folder, rows):
    spark.createDataFrame([(i, t, s, "en", 1, "x") for i, t, s in rows], "doc_id long, text string, source string, lang string, n_mentions int, term string").coalesce(1).write.mode("append").parquet(folder)


def found(spark, out):
    return sorted(((r.term, r.doc_id, r.source, r.n_mentions, r.first_at) for r in job.output(spark, out).collect()), key=str)


def test_two_runs_over_growing_input(spark, tmp_path):
    records, out, mark = (f"{tmp_path}/{x}" for x in ("records", "out", "mark"))
    add(spark, records, [(1, "xfoo FOOfoo", "s"), (2, None, "s"), (3, "", None), (4, "A B a b", None)])
    assert job.run(spark, records, out, mark, CONFIG) == (4, 1)
    first = [("a b", 4, None, 2, 1), ("foo", 1, "s", 3, 2)]
    assert found(spark, out) == first
    add(spark, records, [(5, "é foo", "t"), (None, "foo", "t"), (1, "xfoo FOOfoo", "s")])
    add(spark, records, [(6, "nothing", "t")])
    assert job.run(spark, records, out, mark, CONFIG) == (4, 2)  # only what is new
    both = sorted([*first, ("foo", 5, "t", 1, 3), ("foo", None, "t", 1, 1), ("foo", 1, "s", 3, 2)], key=str)
    assert found(spark, out) == both
    assert job.run(spark, records, out, mark, CONFIG) == (0, 0)  # nothing new
    assert found(spark, out) == both


def test_growing_copy_of_the_given_table(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    records, out, mark = (f"{tmp_path}/{x}" for x in ("records", "out", "mark"))
    docs.where("doc_id < 90").write.mode("append").parquet(records)
    n, _ = job.run(spark, records, out, mark, CONFIG | {"terms": ["tel", "est"]})
    docs.where("doc_id >= 90").write.mode("append").parquet(records)
    m, _ = job.run(spark, records, out, mark, CONFIG | {"terms": ["est", "tel"]})
    assert n + m == docs.count() and n == docs.where("doc_id < 90").count()
    whole = sorted((r.term, r.doc_id, r.n_mentions) for r in job.mentioned(docs.select("doc_id", "source", "lang", "text"), ["tel", "est"]).collect())
    assert sorted((r.term, r.doc_id, r.n_mentions) for r in job.output(spark, out).collect()) == whole and whole


def test_empty_folder_and_settings(spark, tmp_path):
    (tmp_path / "records").mkdir()
    before = spark.conf.get(job.KEPT_PROGRESS)
    assert job.run(spark, f"{tmp_path}/records", f"{tmp_path}/out", f"{tmp_path}/mark", CONFIG) == (0, 0)
    assert spark.conf.get(job.KEPT_PROGRESS) == before


def test_terms(spark, tmp_path):
    for terms in ([], [""], ["a", "A"]):
        with pytest.raises(ValueError):
            job.check(terms)
    job.same_terms(spark, f"{tmp_path}/terms", ["b", "a"])
    job.same_terms(spark, f"{tmp_path}/terms", ["a", "b"])
    with pytest.raises(ValueError):
        job.same_terms(spark, f"{tmp_path}/terms", ["a"])
