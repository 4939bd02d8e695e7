"""URL filters by rules and a path-template tree (native).

Rules come first: the longest rule (host suffix and path prefix) that fits an url decides. Urls that no rule
decides are judged by their host's path templates. Per host, the path's segments form a tree that is generalised from
the root down, one level a pass: a child becomes a wildcard if it is a number, or if its node has more than ``fan``
children and it carries no more than 1/fan of the node's urls (ids, dates, slugs); of the other children, those whose
blocked shares lie within their sampling errors of each other, one next to the other, are merged to one branch. What
becomes one branch is one node on the next level, so its children are pooled. A template is rejected when the
smoothed share of blocked urls among its labelled ones exceeds the limit; the labels are the verdicts of the rules,
and a template without labels takes its host's smoothed share, which alone decides then.

Defined results: a null url, or one without ``://``, has an empty host and path; such urls form one template; a
segment ``*`` is a wildcard; runs of digits within a segment count as one ``0``; equal rows give equal verdicts; an
empty table gives an empty result; extra columns are ignored; paths are judged whole, however deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Verdict, rule (host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

FAN, ALPHA, Z, LIMIT = 16, 2.0, 2.0, 0.6
COUNTS = ("n", "labelled", "blocked")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does. Ties: the first by text."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        own_host, slash, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """A segment's form: runs of digits as 0; long mixed words as one class."""
    return F.when(segment.rlike(r"^[0-9]+$"), F.lit("<n>")).when(segment.rlike("[0-9]"), F.regexp_replace(segment, "[0-9]+", "0")).otherwise(segment)


NODE = ["host", "node"]


def named(rows: DataFrame, level: int, fan: int, alpha: float, z: float) -> DataFrame:
    """host, node, child, name: the children of each node at ``level`` that get a name other than their own."""
    per = rows.groupBy(*NODE, F.get("segments", F.lit(level)).alias("child")).agg(*[F.sum(c).alias(c) for c in COUNTS])
    per = materialize(per, "url-children")
    nodes = per.groupBy(*NODE).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"))
    own = per.join(nodes, NODE)
    variable = (F.col("child") == "<n>") | ((F.col("children") > fan) & (F.col("n") * fan <= F.col("all_n")))
    wild = own.where(variable).select(*NODE, "child", F.lit("*").alias("name"))
    # A node has at most ``fan`` other children, so the windows over them are small.
    fixed = own.where(~variable & (F.col("labelled") > 0))
    rate = (F.col("blocked") + alpha / 2) / (F.col("labelled") + alpha)
    fixed = fixed.withColumn("rate", rate).withColumn("error", F.col("rate") * (1 - F.col("rate")) / (F.col("labelled") + alpha))
    order = W.partitionBy(*NODE).orderBy("rate", "child")
    apart = F.col("rate") - F.lag("rate").over(order) > z * F.sqrt(F.col("error") + F.lag("error").over(order))
    fixed = fixed.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("branch", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    branches = fixed.groupBy(*NODE, "branch").agg(F.sort_array(F.collect_list("child")).alias("members")).where(F.size("members") > 1)
    merged = branches.select(*NODE, F.explode("members").alias("child"), F.concat(F.lit("{"), F.array_join("members", "|"), F.lit("}")).alias("name"))
    return wild.unionByName(merged)


def templates(shapes: DataFrame, fan: int = FAN, alpha: float = ALPHA, z: float = Z) -> DataFrame:
    """host, segments, their counts and node, the template, from distinct shapes with their counts.

    Each pass names one level of all hosts' trees. A node with one shape is named to its end at once, as its children
    have no siblings, so there are as many passes as two different paths of a host share names, and one.
    """
    rows, done, level = shapes.withColumn("node", F.lit("")), [], 0
    while True:
        rows = materialize(rows, "url-nodes")
        many = rows.where(F.size("segments") > level).groupBy(*NODE).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*NODE, F.lit(True).alias("open"))
        rows = rows.join(many, NODE, "left").withColumn("open", F.coalesce("open", F.lit(False)) & (F.size("segments") > level))
        rest = F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0)))
        ending = F.array_join(F.transform(rest, lambda s: F.concat(F.lit("/"), F.when(s == "<n>", "*").otherwise(s))), "")
        done.append(rows.where(~F.col("open")).withColumn("node", F.concat("node", ending)).drop("open"))
        rows = rows.where("open").drop("open")
        if rows.isEmpty():
            break
        child = F.get("segments", F.lit(level))
        rows = rows.withColumn("child", child).join(named(rows, level, fan, alpha, z), [*NODE, "child"], "left")
        rows = rows.withColumn("node", F.concat("node", F.lit("/"), F.coalesce("name", "child"))).select(*shapes.columns, "node")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def judged(pages: DataFrame, rules=RULES, fan: int = FAN, alpha: float = ALPHA, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, template and its smoothed purity.

    fan: see ``named``. alpha: weight of the prior, in urls. z: standard errors of their difference by which the
    shares of neighbouring siblings may differ and still merge. limit: blocked share above which a template is rejected.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    urls = urls.withColumn("segments", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), shape))
    # Distinct shapes per host carry the counts from here on; urls come back only for the verdict.
    shapes = urls.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("found").isNotNull()).alias("labelled"),
        F.count_if(F.col("found.verdict") == "block").alias("blocked"),
    )
    named_ = materialize(templates(shapes, fan, alpha, z).withColumn("template", F.when(F.col("node") == "", "/").otherwise(F.col("node"))), "url-templates")
    counted = named_.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    hosts = counted.groupBy("host").agg(((F.sum("blocked") + alpha / 2) / (F.sum("labelled") + alpha)).alias("host_rate"))
    purity = (F.col("blocked") + F.col("host_rate") * alpha) / (F.col("labelled") + alpha)
    rated = counted.join(hosts, "host").select("host", "template", F.round(purity, 9).alias("purity"))
    out = urls.join(named_.select("host", "segments", "template").join(rated, ["host", "template"]), ["host", "segments"], "left")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("purity") > limit, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
