"""SQL (DuckDB) for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from . import dual_tree_kmeans, mix_sources, quality_rules
from .url_filter import RULES

WORDS = r"list_filter(regexp_split_to_array(coalesce({t}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _js(p: str, q: str) -> str:
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: ({part.format(x='z[1]')} + {part.format(x='z[2]')}) / 2)), 0))"


QUALITY = (
    r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '+' || lang END AS key, coalesce(text, '') AS t, text IS NOT NULL AS has, WORDSQL AS w FROM documents
), m AS (
  SELECT *, regexp_replace(t, '\p{Ll}+', '', 'g') AS rest, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         list_transform(w, lambda x: lower(x)) AS sh FROM base
), c AS (
  SELECT *, length(t) AS n, length(t) - length(rest) AS lo, length(rest) - length(regexp_replace(rest, '\p{Lu}+', '', 'g')) AS up,
         length(rest) - length(regexp_replace(rest, '\p{Nd}+', '', 'g')) AS di, length(rest) - length(regexp_replace(rest, '[\x20\x09-\x0D]+', '', 'g')) AS sp,
         length(rest) - length(regexp_replace(rest, 'OTHERLETTERS', '', 'g')) AS ot FROM m
), win AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM m)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS k FROM win) WHERE k > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid
), rc AS (
  SELECT key, list_transform([sum(lo), sum(up), sum(di), sum(sp), sum(n) - sum(lo) - sum(up) - sum(di) - sum(sp)], lambda x: x::DOUBLE / greatest(sum(n), 1)) AS classes, sum(n) AS chars FROM c WHERE has GROUP BY key
), pool AS (
  SELECT list_transform([sum(lo) + sum(up) + sum(ot), sum(di), sum(n) - sum(lo) - sum(up) - sum(ot) - sum(di) - sum(sp)], lambda x: x::DOUBLE / greatest(sum(n) - sum(sp), 1)) AS pool FROM c WHERE has
), sw AS (
  SELECT key, lower(x) AS word, count(*) AS k FROM (SELECT key, unnest(w) AS x FROM base) GROUP BY ALL
), rk AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY k DESC, word) AS rn, sum(k) OVER (PARTITION BY key) AS total FROM sw
), ref AS (
  SELECT key, list(word ORDER BY rn) FILTER (rn <= 31) AS common,
         list_append(list(k::DOUBLE / total ORDER BY rn) FILTER (rn <= 31), (max(total) - sum(k) FILTER (rn <= 31))::DOUBLE / max(total)) AS shares, max(total) AS total FROM rk GROUP BY key
), h AS (
  SELECT c.*, rc.classes, ref.shares, pool, coalesce(total >= MINWORDS AND LEASTPARTS * len(w) <= total AND LEASTPARTS * n <= chars, false) AS enough,
         list_transform(common, lambda v: len(list_filter(sh, lambda x: x = v))) AS hits FROM c LEFT JOIN rc USING (key) LEFT JOIN ref USING (key), pool
), v AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, (n - sp)::BIGINT AS word_chars, length(regexp_replace(rest, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         CASE WHEN n >= 200 THEN CASE WHEN enough THEN JSCLASS ELSE JSPOOL END END AS class_js, CASE WHEN enough AND len(sh) >= 25 THEN JSWORD END AS word_js
  FROM h LEFT JOIN rep USING (rid)
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_js, 0) <= 0.3 AND coalesce(word_js, 0) <= 0.45 AS kept, round(class_js, 6) AS class_js, round(word_js, 6) AS word_js FROM f
""".replace("WORDSQL", WORDS.format(t="text"))
    .replace("JSCLASS", _js("list_transform([lo, up, di, sp, n - lo - up - di - sp], lambda x: x::DOUBLE / greatest(n, 1))", "classes"))
    .replace("JSPOOL", _js("list_transform([lo + up + ot, di, n - lo - up - ot - di - sp], lambda x: x::DOUBLE / greatest(n - sp, 1))", "pool"))
    .replace("OTHERLETTERS", quality_rules.OTHER_LETTERS).replace("LEASTPARTS", str(quality_rules.LEAST_PARTS)).replace("MINWORDS", str(quality_rules.MIN_REFERENCE))
    .replace("JSWORD", _js("list_transform(list_append(hits, len(sh) - list_sum(hits)), lambda x: x::DOUBLE / greatest(len(sh), 1))", "shares"))
)

SUBSTRING = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, WORDSQL AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
often AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT rid, list_distinct(flatten(list(range(i, i + 35)))) AS p FROM win SEMI JOIN often USING (s) GROUP BY rid),
kept AS (SELECT doc_id, w, list_filter(w, lambda x, i: p IS NULL OR NOT list_contains(p, i)) AS k FROM d LEFT JOIN gone USING (rid))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
""".replace("WORDSQL", WORDS.format(t="text"))


def _rule(field: str) -> str:
    out = "NULL"
    for verdict, rule in sorted(RULES, key=lambda x: (len(x[1]), x[1])):
        host, slash, path = rule.partition("/")
        value = verdict if field == "verdict" else rule
        out = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{value}' ELSE {out} END"
    return out


URLS = f"""
WITH RECURSIVE p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), j AS (
  SELECT *, {_rule("rule")} AS rule, {_rule("verdict")} AS found,
         list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '<n>' WHEN regexp_matches(s, '[0-9]') THEN regexp_replace(s, '[0-9]+', '0', 'g') ELSE s END) AS seg0 FROM p
), u AS (SELECT *, seg0 AS seg FROM j),
shapes AS (SELECT host, seg, count(*) AS n, count(found) AS labelled, count(*) FILTER (found = 'block') AS blocked FROM u GROUP BY ALL),
tree AS (
  SELECT 0 AS d, host, '' AS node, seg, n, labelled, blocked FROM shapes
  UNION ALL
  SELECT d + 1, host, node || '/' || CASE WHEN variable THEN '*' WHEN lab = 0 OR len(members) = 1 THEN child ELSE '{{' || array_to_string(members, '|') || '}}' END, seg, n, labelled, blocked
  FROM (
    SELECT *, list_sort(list_distinct(list(child) OVER (PARTITION BY host, node, variable, lab > 0, branch))) AS members FROM (
      SELECT *, sum(apart) OVER (PARTITION BY host, node, variable, lab > 0 ORDER BY rate, child, seg ROWS UNBOUNDED PRECEDING) AS branch FROM (
        SELECT *, CASE WHEN rate - lag(rate) OVER w > 2 * sqrt(rate * (1 - rate) / (lab + 2) + lag(rate * (1 - rate) / (lab + 2)) OVER w) THEN 1 ELSE 0 END AS apart FROM (
          SELECT *, child = '<n>' OR (kids > 16 AND child_n * 16 <= node_n) AS variable, (blk + 1.0::DOUBLE) / (lab + 2) AS rate FROM (
            SELECT *, seg[d + 1] AS child, sum(n) OVER c AS child_n, sum(labelled) OVER c AS lab, sum(blocked) OVER c AS blk, sum(n) OVER p AS node_n, count(DISTINCT seg[d + 1]) OVER p AS kids
            FROM tree WHERE len(seg) > d WINDOW p AS (PARTITION BY host, node), c AS (PARTITION BY host, node, seg[d + 1])
          )
        ) WINDOW w AS (PARTITION BY host, node, variable, lab > 0 ORDER BY rate, child, seg)
      )
    )
  )
), t AS (SELECT host, seg, labelled, blocked, CASE WHEN node = '' THEN '/' ELSE node END AS template FROM tree WHERE len(seg) = d),
counted AS (SELECT host, template, sum(labelled) AS labelled, sum(blocked) AS blocked FROM t GROUP BY ALL),
rated AS (
  SELECT host, template, round((blocked + 2 * (sum(blocked) OVER h + 1.0::DOUBLE) / (sum(labelled) OVER h + 2)) / (labelled + 2), 9) AS purity FROM counted WINDOW h AS (PARTITION BY host)
)
SELECT page_id, u.host, path, rule, coalesce(found, CASE WHEN purity > 0.6 THEN 'block' ELSE 'allow' END) AS verdict, t.template, purity
FROM u JOIN t ON t.host = u.host AND t.seg = u.seg JOIN rated ON rated.host = t.host AND rated.template = t.template
"""

ORACLES = {"op4_quality_rules": QUALITY, "op5_url_filters": URLS, "op6_mix_sources": mix_sources.REPORT_SQL, "op8_substring_dedup": SUBSTRING, "op11_dual_tree_clusters": dual_tree_kmeans.report_sql()}
