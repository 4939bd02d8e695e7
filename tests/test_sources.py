import json

import numpy as np
import pytest

from locushift.plans import fixtures, navigate
from locushift.sources import readers, writers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_unmeasured_and_flat_survive(spark, tmp_path):
    path = put(tmp_path, "w.tsv", "chrom\tstart\tend\tdriver_score\tdirection\nchr1\t1\t2\t0.5\t0.0\nchr1\t3\t4\t0.25\t\nchr2\t5\t6\t1.0\t-0.5\n")
    df = readers.contract(spark, path)
    assert [(r.ord, r.direction) for r in df.orderBy("ord").collect()] == [(0, 0.0), (1, None), (2, -0.5)]
    assert writers.contract(df, str(tmp_path / "out.tsv")) == 5 and (tmp_path / "out.tsv").read_text() == (tmp_path / "w.tsv").read_text()
    assert writers.contract(df.withColumn("direction", df.direction * None), str(tmp_path / "four.tsv")) == 4
    four = readers.contract(spark, str(tmp_path / "four.tsv"))
    assert {r.direction for r in four.collect()} == {None}
    with pytest.raises(ValueError):
        readers.contract(spark, put(tmp_path, "bad.tsv", "chrom\tstart\n"))


def test_number_texts():
    assert [writers.score_text(x) for x in (0.0001, 2, -1, 0.12345)] == ["0.0001", "1.0", "0.0", "0.1235" if round(0.12345, 4) == 0.1235 else "0.1234"]
    assert [writers.direction_text(x) for x in (None, float("nan"), 0.0, -3)] == ["", "", "0.0", "-1.0"]


def test_positional_track_and_beds(spark, tmp_path):
    path = put(tmp_path, "t.tsv", "#c\n\nchrom\tstart\tend\tvalue\nchr1\t1\t2\t0.5\nchr1\t3\t4\tnan\t0.1\n")
    assert [(r.start_pos, r.value, r.direction) for r in readers.track(spark, path).orderBy("ord").collect()] == [(1, 0.5, None), (3, None, 0.1)]
    path = put(tmp_path, "b.bed", "track x\n#c\nchr1\t1\t2\tg1\nchr1\t3\t4\nbrowser y\n")
    for unnamed, want in (("null", None), ("empty", ""), ("row", "row3")):
        assert [r.gene for r in readers.bed(spark, path, unnamed).orderBy("ord").collect()] == ["g1", want]
    assert readers.names(spark, put(tmp_path, "n.txt", "b\n\na\n")) == ["b", "a"]


def test_matrix_and_intensity(spark, tmp_path):
    path = put(tmp_path, "m.tsv", "region\tB_1\tA_1\tA_2\tnote\nr1\t3\t1\t2\tx\nr2\t6\t4\t5\ty\n")
    rows = sorted(map(tuple, readers.replicates(spark, path, "A_", "B_").collect()))
    assert rows == [(0, 0, True, 1), (0, 1, True, 2), (0, 2, False, 3), (1, 0, True, 4), (1, 1, True, 5), (1, 2, False, 6)]
    with pytest.raises(SystemExit):
        readers.replicates(spark, path, "A_", "C_")
    path = put(tmp_path, "i.tsv", "chrom\tstart\tend\tatpm_kidney\nchr1\t1\t2\t0.7\n")
    for column in ("atpm_kidney", 3, "3"):
        assert readers.intensity(spark, path, column).first().value == 0.7
    with pytest.raises(SystemExit):
        readers.intensity(spark, path, "liver")


def archive(path, shift, signal=True):
    n = 40
    more = {"signal": (np.arange(n) / n * shift).astype("f4")} if signal else {}
    np.savez(path, chrom=np.array(["chr1"] * n), start=np.arange(n) * 100, end=np.arange(n) * 100 + 50, embedding=(np.arange(n)[:, None] * shift * np.ones((n, 3))).astype("f4"), meta=json.dumps({"model": "m", "assembly": "hg38", "dim": 3, "cell_state": "x", "has_signal": signal}), **more)
    return str(path)


def test_states_to_bundle(spark, tmp_path):
    a, b = archive(tmp_path / "a.npz", 0.0), archive(tmp_path / "b.npz", 1.0)
    out = navigate.main(["--emb-a", a, "--emb-b", b, "--out", str(tmp_path / "w.tsv"), "--bundle", str(tmp_path / "bundle"), "--direction", "on"])
    assert out["nomination"]["refused"] and out["gate1"] is None and out["transition"]["species"] == "human"
    assert (tmp_path / "w.tsv").read_text() == (tmp_path / "bundle/weights.tsv").read_text()
    assert (tmp_path / "w.tsv").read_text().splitlines()[1:3] == ["chr1\t0\t50\t0.0\t0.0", "chr1\t100\t150\t0.0256\t0.0256"]
    assert readers.nominations(spark, str(tmp_path / "bundle/nominations.tsv")).count() == 0
    assert json.loads((tmp_path / "bundle/manifest.json").read_text())["bundle_version"] == writers.BUNDLE_VERSION
    df, meta = readers.artifact(spark, a)
    assert writers.artifact(df, str(tmp_path / "art"), model="m", cell_state="x", assembly="hg38", source="s") == (40, 3)
    again, meta = readers.artifact(spark, str(tmp_path / "art"))
    assert meta["dim"] == 3 and meta["has_signal"] and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(SystemExit):
        navigate.main(["--emb-a", archive(tmp_path / "c.npz", 1.0, False), "--emb-b", b, "--out", "x", "--direction", "on"])


def test_contract_with_gates_to_nominations(spark, tmp_path):
    n = 600
    rng = np.random.default_rng(0)
    d = rng.uniform(-1, 1, n)
    w = "chrom\tstart\tend\tdriver_score\tdirection\n" + "".join(f"chr1\t{i * 100}\t{i * 100 + 50}\t{i / n:.4f}\t{d[i]:.4f}\n" for i in range(n))
    m = "id\tA1\tA2\tB1\tB2\n" + "".join(f"r{i}\t{a}\t{a + 1}\t{b}\t{b + 1}\n" for i in range(n) for a, b in [(1000 * (1 + i % 7), 1000 * (1 + (i * 5 + 3) % 7))])
    pos = "".join(f"chr1\t{i * 100 + 10}\t{i * 100 + 20}\tg{i}\n" for i in range(n) if d[i] > 0 and rng.random() < 0.1 + 0.3 * i / n)
    sig = "".join(f"chr1\t{i * 100}\t{i * 100 + 50}\t{d[i]:.4f}\n" for i in range(n))
    files = {k: put(tmp_path, k, v) for k, v in (("w.tsv", w), ("m.tsv", m), ("p.bed", pos), ("s.tsv", sig))}
    out = navigate.main(["--contract", files["w.tsv"], "--assembly", "mm10", "--model", "get", "--bundle", str(tmp_path / "b"), "--matrix", files["m.tsv"], "--state-a", "A", "--state-b", "B", "--positives", files["p.bed"], "--signed", files["s.tsv"]])
    stored = json.loads((tmp_path / "b/manifest.json").read_text())
    assert stored == out | {"bundle_version": "1"}
    assert out["run_id"] == "b" and out["transition"] == {"id": "b", "species": "mouse", "assembly": "mm10", "state_a": "A", "state_b": "B"}
    assert out["region_universe"] == {"n_regions": n, "source": "contract w.tsv"} and out["models_run"] == ["get"]
    assert set(out["gate1"]) == {"admit", "pc1_frac", "coherence_margin", "n_a", "n_b", "universe_n", "universe_truncated", "reasons"} and out["gate1"]["admit"] and out["gate1"]["universe_n"] == n
    assert set(out["gate2"]) == {"primary", "anchor_set", "n_anchors", "delta_auroc", "delta_auroc_ci", "lr_p", "lr_coef", "fold_enrichment_top5pct", "reason"}
    assert out["gate2"]["anchor_set"] == "p.bed" and out["gate2"]["n_anchors"] == len(pos.splitlines()) and len(out["gate2"]["delta_auroc_ci"]) == 2
    assert out["nomination"] == {"score_source": out["gate2"]["primary"], "score_norm": "rank", "top_frac": 0.01, "n_nominated": 6, "refused": False, "refusal_reason": None}
    assert out["direction"] == {"provenance": "input-measured", "source": "signal of get, B less A", "norm": None}
    everywhere = navigate.main(["--contract", files["w.tsv"], "--assembly", "xx1", "--model", "get", "--bundle", str(tmp_path / "b2"), "--anchors", files["p.bed"], "--signed", files["s.tsv"], "--all-regions"])
    assert everywhere["transition"]["species"] == "unknown" and everywhere["gate1"] is None and everywhere["gate2"]["delta_auroc"] != out["gate2"]["delta_auroc"]
    assert everywhere["nomination"]["refused"] and everywhere["nomination"]["top_frac"] is None
    rows = readers.nominations(spark, str(tmp_path / "b/nominations.tsv"))
    assert [r["rank"] for r in rows.orderBy("rank").collect()] == list(range(1, 7))
    assert (tmp_path / "b/weights.tsv").read_text().splitlines()[1].startswith("chr1\t0\t50\t0.0\t")


@pytest.mark.parametrize("args", [[], ["--out", "x"], ["--out", "x", "--emb-a", "a"], ["--out", "x", "--contract", "c"], ["--out", "x", "--contract", "c", "--emb-a", "a"], ["--out", "x", "--contract", "c", "--assembly", "a", "--model", "m", "--matrix", "m"], ["--out", "x", "--contract", "c", "--assembly", "a", "--model", "m", "--positives", "m"]])
def test_arguments(args):
    with pytest.raises(SystemExit):
        navigate.check(navigate.parser().parse_args(args))


def test_blocks_written_elsewhere_nominate(spark):
    """Gate blocks by the contract's names, as other writers of bundles fill them."""
    from locushift.operators import nominate

    gate1 = {"admit": True, "pc1_frac": 0.9187, "coherence_margin": 0.5694, "n_a": 3, "n_b": 3, "universe_n": 50000, "universe_truncated": False, "reasons": []}
    gate2 = {"primary": "GET", "anchor_set": "promoter", "n_anchors": 85, "delta_auroc": 0.17, "delta_auroc_ci": [0.081, 0.264], "lr_p": 0.001, "lr_coef": 0.67, "fold_enrichment_top5pct": 2.46}
    weights = spark.createDataFrame([(i, "chr1", i, i + 1, i / 300, None) for i in range(300)], "ord long, chrom string, start_pos long, end_pos long, driver_score double, direction double")
    rows, block = nominate.nominated(weights, gate1, gate2)
    assert rows.count() == 3 and block["score_source"] == "GET" and not block["refused"]


def test_archives(spark, tmp_path):
    """A state as a numpy archive reads back the same, here and in numpy; one without meta is described by itself."""
    rows = [(i, f"chr{i % 3}" + "x" * (i % 2), i * 10, i * 10 + 5, [float(i), 0.5], None if i == 4 else i / 8) for i in range(20)]
    df = spark.createDataFrame(rows, "ord long, chrom string, start_pos long, end_pos long, embedding array<float>, signal float").repartition(3)
    path = str(tmp_path / "s.npz")
    assert writers.artifact(df, path, model="m", cell_state="c", assembly="hg38", source="s") == (20, 2)
    z = np.load(path, allow_pickle=False)
    assert z["embedding"].dtype == np.float32 and z["start"].tolist() == [r[2] for r in rows] and np.isnan(z["signal"][4]) and z["chrom"].tolist() == [r[1] for r in rows]
    again, meta = readers.artifact(spark, path)
    assert meta == {"model": "m", "cell_state": "c", "assembly": "hg38", "dim": 2, "source": "s", "has_signal": True} and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    np.savez(tmp_path / "bare.npz", **{k: z[k] for k in ("chrom", "start", "end", "embedding")})
    bare, meta = readers.artifact(spark, str(tmp_path / "bare.npz"))
    assert meta == {"dim": 2, "has_signal": False} and bare.where("signal is null").count() == 20


def test_lines_keep_their_order(spark, tmp_path):
    """Blocks of a file are numbered one after the other."""
    path = put(tmp_path, "lines.txt", "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        found = readers.lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value.split()[1] for r in sorted(found)] == [str(i) for i in range(20_000)] and sorted(r.ord for r in found) == list(range(20_000))


def test_containers(spark, tmp_path):
    import gzip

    text = "chain 1 a 1000 + 100 260 x 900 + 10 175 1\n50 10 15\n100\n\nchain 1 a 1000 + 500 520 y 300 - 20 40 2\n20\n"
    (tmp_path / "c.chain.gz").write_bytes(gzip.compress(text.encode()))
    want = [(0, "a", 100, 150, "x", 10, 1, 1.0, 1), (0, "a", 500, 520, "y", 279, -1, 1.0, 2), (1, "a", 160, 260, "x", 75, 1, 1.0, 1)]
    assert sorted(map(tuple, readers.chain(spark, str(tmp_path / "c.chain.gz")).collect())) == want
    (tmp_path / "plain.chain").write_text("# chain files may start with comments\n" + text)
    assert sorted(map(tuple, readers.chain(spark, str(tmp_path / "plain.chain")).collect())) == want
    np.save(tmp_path / "v.npy", np.array([1.5, 2.0]))
    assert sorted(map(tuple, readers.vector(spark, str(tmp_path / "v.npy")).collect())) == [(0, 1.5), (1, 2.0)]
    rows = spark.createDataFrame([(i, f"chr{i % 3}", i * 10, i * 10 + 5, float(i)) for i in range(30)], "ord long, chrom string, start_pos long, end_pos long, value double")
    writers.hits(rows, str(tmp_path / "hits"))
    some = rows.where("ord in (4, 7)")
    assert sorted(r.ord for r in readers.hits(spark, str(tmp_path / "hits"), some).collect()) == [4, 7]
    from pyspark.sql import functions as F

    writers.state_matrix(rows.withColumn("cell", F.when(F.col("ord") < 10, "A").otherwise("B")), str(tmp_path / "cells"))
    assert readers.state_matrix(spark, str(tmp_path / "cells"), "A").count() == 10 and readers.state_matrix(spark, str(tmp_path / "cells")).count() == 30
    writers.motif_matrix(rows.select("ord", F.lit(1.0).alias("m1"), F.lit(2.0).alias("m2")), str(tmp_path / "motif"))
    assert readers.motif_matrix(spark, str(tmp_path / "motif"), ["m1", "m2"]).count() == 30
    with pytest.raises(ValueError):
        readers.motif_matrix(spark, str(tmp_path / "motif"), ["m2", "m1"])


def test_report_text():
    assert writers.report({"auroc": 0.5, "n": 3}, "claim") == "claim\n  auroc: 0.5000\n  n: 3"


def test_hits_of_many_contigs(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(10_050).select(F.col("id").alias("ord"), F.concat(F.lit("c"), "id").alias("chrom"), F.lit(0).cast("long").alias("start_pos"), F.lit(5).cast("long").alias("end_pos"))
    rows.write.parquet(str(tmp_path / "hits"))
    found = readers.hits(spark, str(tmp_path / "hits"), rows)
    assert found.columns == rows.columns and found.count() == 10_050


def test_lines_are_written_by_tasks_and_keep_their_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    path, n = str(tmp_path / "lines"), 400
    rows = spark.range(n).repartition(7).selectExpr("id AS ord", "concat('r', id, '\t', id % 3, '\t', repeat('9', int(id % 50))) AS line")
    with_settings = {"spark.sql.adaptive.enabled": "false"}  # as many files as partitions
    for k, v in with_settings.items():
        spark.conf.set(k, v)
    try:
        fixtures.write_lines(rows, path, ["id\ta0\tb0", ""])
    finally:
        for k in with_settings:
            spark.conf.unset(k)
    assert len(list((tmp_path / "lines").glob("part-*"))) > 1
    got = [(r.ord, r.value.split("\t")[0]) for r in readers.lines(spark, path).orderBy("ord").collect()]
    assert got == [(0, "id"), (1, ""), *[(i + 2, f"r{i}") for i in range(n)]]
    assert readers.first_line(spark, path) == "id\ta0\tb0" and readers.replicates(spark, path, "a", "b").count() == 2 * n
