"""The jobs as queries: each runs its job twice into one new folder and returns the whole output; and their SQL."""

from __future__ import annotations

from jobs import scan_records, weigh_transitions
from jobs.common import shipped_config
from locushift.sources.scratch import shared_folder


def job1_weigh_transitions(spark, sf_dir):
    out = f"{shared_folder(spark, 'weights')}/out"
    for _ in range(2):
        weigh_transitions.run(spark, f"{sf_dir}/part.parquet", f"{sf_dir}/lineitem.parquet", out, shipped_config("weigh_transitions"))
    return weigh_transitions.output(spark, out)


def job2_scan_records(spark, sf_dir):
    folder = shared_folder(spark, "mentions")
    for _ in range(2):
        scan_records.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint", shipped_config("scan_records"))
    return scan_records.output(spark, f"{folder}/out")


def _weights_sql() -> str:
    config, own = shipped_config("weigh_transitions"), []
    for t in config["transitions"]:
        a, b = (f"CASE WHEN l_shipdate >= DATE '{t[s][0]}' AND l_shipdate < DATE '{t[s][1]}' THEN l_quantity END" for s in ("a", "b"))
        nominates = bool(t["gate1"] and t["gate1"]["admit"] and t["gate2"])
        signed = nominates and t["gate2"]["primary"] == "signed-Delta"
        own.append(
            f"""SELECT '{t["id"]}' AS transition, ord, chrom, start_pos, end_pos, round(driver, 4) AS driver_score, round(direction, 4) AS direction,
            CASE WHEN {nominates} AND rn <= k THEN rn END::INTEGER AS rank, CASE WHEN {nominates} AND rn <= k THEN round(s, 4) END AS nomination_score
            FROM (SELECT *, CASE WHEN s IS NOT NULL THEN row_number() OVER (ORDER BY s DESC NULLS LAST, ord) END AS rn, greatest(1, ceil(count(s) OVER () * {config["top"]}::DOUBLE)) AS k
              FROM (SELECT *, {"CASE WHEN direction IS NOT NULL THEN (row_number() OVER (ORDER BY CASE WHEN direction IS NULL THEN 1 ELSE 0 END, abs(direction), ord) - 1)::DOUBLE / greatest(count(direction) OVER () - 1, 1) END" if signed else "driver"} AS s
                FROM (SELECT *, (row_number() OVER (ORDER BY change, ord) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1) AS driver,
                      CASE WHEN delta IS NULL THEN NULL WHEN max(abs(delta)) OVER () > 0 THEN delta / max(abs(delta)) OVER () ELSE 0 END AS direction
                  FROM (SELECT p_partkey::BIGINT AS ord, 'chr' || (p_partkey % 22 + 1) AS chrom, (p_partkey * 200)::BIGINT AS start_pos, (p_partkey * 200 + 100 + p_size)::BIGINT AS end_pos,
                        abs(coalesce(b, 0) - coalesce(a, 0)) AS change, b - a AS delta
                    FROM part LEFT JOIN (SELECT l_partkey, sum({a})::DOUBLE AS a, sum({b})::DOUBLE AS b FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey))))"""
        )
    return " UNION ALL ".join(own)


def _mentions_sql() -> str:
    terms = ", ".join(f"('{t.lower()}')" for t in shipped_config("scan_records")["terms"])
    return f"""SELECT doc_id, source, lang, ((length(t) - length(replace(t, term, ''))) // length(term))::BIGINT AS n_mentions, strpos(t, term)::BIGINT AS first_at, term
    FROM (SELECT *, lower(text) AS t FROM documents WHERE text IS NOT NULL), (VALUES {terms}) AS v(term) WHERE contains(t, term)"""


QUERIES = {f.__name__: f for f in (job1_weigh_transitions, job2_scan_records)}
ORACLES = {"job1_weigh_transitions": _weights_sql(), "job2_scan_records": _mentions_sql()}
