"""URL filtering by path-template trees, all in DataFrame operations.

Each host's paths form a tree of segments. Level by level a node's children that are not a fair share of its visits are generalised
into a wildcard, so a node has few branches. Sibling branches, in order of their labelled block rates, are compared one with the next,
and merged where a two-proportion test doesn't tell them apart; a branch without labels is merged into its node. A template is rejected
when its branch's block rate, smoothed by its node's and at the root by all hosts' rates, is REJECT or more. Where an explicit rule
fits, it decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.common import stash, table

#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Levels of the tree; what lies deeper is one wildcard. A literal child has FEWEST visits and SHARE of its node's.
LEVELS, FEWEST, SHARE = 3, 8, 0.02
#: Pseudo-counts of the node's rate; z-value at which branches differ; least variance in that test; block rate at which a template is rejected.
SMOOTH, Z, FLAT, REJECT = 4.0, 1.96, 0.01, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path); both empty for a null url or one without ://."""
    p = table(pages, {"page_id": "bigint", "url": "string"})
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    p = p.withColumn("rest", F.coalesce(rest, F.lit(""))).withColumn("h", F.regexp_extract("rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substr(rest, length(h) + 1)"), "^[^?#]*", 0)
    return p.select("page_id", F.translate("h", _UPPER, _LOWER).alias("host"), path.alias("path"))


def fits(host: str, prefix: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(prefix)


def by_rule(rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    whens = [(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ranked]
    return reduce(lambda c, w: c.when(*w), whens[1:], F.when(*whens[0])) if whens else F.lit(None).cast("struct<rule:string,verdict:string>")


def templates(urls: DataFrame) -> DataFrame:
    """urls (host, path, n, seen, blocked) with template, the path generalised within its host: nodes array<string>, root first."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    tree = stash(urls.withColumn("segments", segments).withColumn("nodes", F.array(F.lit("/"))))
    for level in range(LEVELS):
        t = tree.withColumn("node", F.element_at("nodes", -1)).withColumn("child", F.when(F.size("segments") > level, F.element_at("segments", level + 1)))
        child = t.where("child is not null").groupBy("host", "node", "child").agg(F.sum("n").alias("visits"))
        node = child.groupBy("host", "node").agg(F.sum("visits").alias("all"))
        keep = child.join(node, ["host", "node"]).where((F.col("visits") >= FEWEST) & (F.col("visits") >= SHARE * F.col("all"))).select("host", "node", "child", F.lit(True).alias("literal"))
        step = F.concat("node", F.when(F.col("literal"), F.col("child")).otherwise("*"), F.lit("/"))
        t = t.join(keep, ["host", "node", "child"], "left")
        tree = stash(t.withColumn("nodes", F.when(F.col("child").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array(step)))).drop("node", "child", "literal"))
    deeper = F.size("segments") > LEVELS
    return tree.withColumn("nodes", F.when(deeper, F.concat("nodes", F.array(F.concat(F.element_at("nodes", -1), F.lit("**"))))).otherwise(F.col("nodes"))).drop("segments")


def rates(tree: DataFrame) -> DataFrame:
    """(host, node, rate): each template's smoothed block rate, that of the siblings it is merged with."""
    flat = tree.select("host", F.posexplode("nodes").alias("depth", "node"), "nodes", "seen", "blocked")
    flat = flat.withColumn("parent", F.when(F.col("depth") > 0, F.get("nodes", F.col("depth") - 1)))
    stats = stash(flat.groupBy("host", "depth", "node", "parent").agg(F.sum("seen").alias("seen"), F.sum("blocked").alias("blocked")))
    total = stats.where("depth = 0").agg(F.sum("blocked"), F.sum("seen")).first()
    everywhere = (total[0] or 0) / total[1] if total[1] else 0.0
    levels = [stats.where("depth = 0").select("host", "node", ((F.col("blocked") + SMOOTH * F.lit(everywhere)) / (F.col("seen") + SMOOTH)).alias("rate"))]
    siblings = Window.partitionBy("host", "parent", F.col("seen") > 0)  # a node has at most 1 / SHARE branches and a wildcard
    row = siblings.orderBy(F.col("blocked") / F.greatest("seen", F.lit(1)), "node")
    own, one = F.greatest("seen", F.lit(1)), F.lit(1)
    b0, s0 = F.lag("blocked").over(row), F.greatest(F.lag("seen").over(row), one)
    both = (F.col("blocked") + b0) / (own + s0)
    apart = F.col("blocked") / own - b0 / s0
    differs = apart * apart >= Z * Z * F.greatest(both * (1 - both), F.lit(FLAT)) * (1 / own + 1 / s0)
    for depth in range(1, LEVELS + 2):
        above = levels[-1].select("host", F.col("node").alias("parent"), F.col("rate").alias("prior"))
        now = stats.where(F.col("depth") == depth).withColumn("new", F.when((F.col("seen") > 0) & differs, 1).otherwise(0))
        now = now.withColumn("merged", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
        alike = Window.partitionBy("host", "parent", F.col("seen") > 0, "merged")
        now = now.withColumn("all_blocked", F.sum("blocked").over(alike)).withColumn("all_seen", F.sum("seen").over(alike)).join(above, ["host", "parent"])
        levels.append(now.select("host", "node", ((F.col("all_blocked") + SMOOTH * F.col("prior")) / (F.col("all_seen") + SMOOTH)).alias("rate")))
    return reduce(DataFrame.unionByName, levels)


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row. The rules' own verdicts are the labels that the trees learn from.

    No label anywhere: the rate is 0 and the method allows. Repeated urls weigh as often as they occur and have a row each. A null url, or
    one without ://, has an empty host and path; a long one is judged by its first LEVELS segments. Empty pages: no rows.
    """
    p = parsed(pages).withColumn("r", by_rule(rules))
    urls = p.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("r.verdict").alias("seen"), F.count_if(F.col("r.verdict") == "block").alias("blocked"))
    tree = stash(templates(urls))
    rate = rates(tree)
    of_url = tree.select("host", "path", F.element_at("nodes", -1).alias("node")).join(rate, ["host", "node"]).select("host", "path", F.when(F.col("rate") >= REJECT, "block").otherwise("allow").alias("own"), F.col("node").alias("template"))
    return p.join(of_url, ["host", "path"]).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "own").alias("verdict"), "template")
