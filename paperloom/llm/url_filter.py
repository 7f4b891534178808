"""URL filters: rules by host and path, and link-graph propagation for the hosts that no rule decides.

Trust starts from hosts with allowed pages and follows links; distrust starts from hosts with blocked pages and follows
links backwards, to those that point there. Both are personalised PageRank over host edges (links between pages of two
hosts, weighted by their number), a join and an aggregation a round, written to the shared folder between rounds, until
no rank can be off by more than ``TOLERANCE``. A seed's mass is the share of its pages that a rule decides, so a rank of 1 is that of a host decided whole, before what links add.
A host is blocked if its distrust is above its trust and reaches ``threshold``.

Pages whose links all stay on their host give no edges; their host's verdict is then that of the seeds, its own pages' share.

Defined cases: a null url or one without "://" has an empty host and path, fits no rule and is allowed; a null page is
one without links; hosts without links keep their seeds' mass only; repeated rows and links count as often as they occur;
of two rules the longer wins, of equally long ones the first listed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path) of the query's rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hosts that are broadcast at most; more are joined by shuffle, hot ones salted.
BROADCAST_HOSTS = 50_000
#: No rank is off by more: rounds end when all later ones together bring less.
TOLERANCE = 1e-3


def lower_ascii(x: Column) -> Column:
    return F.translate(x, UPPER, UPPER.lower())


def url_parts(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last that fits wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


#: What holds no links of a page, and links of ``a`` elements to another host.
NO_LINKS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/"'?#>\s]+)"""


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links of ``a`` elements between different hosts. ``pages`` has host and html."""
    links = F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), NO_LINKS, ""), F.lit(LINK), F.lit(1))
    each = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("_dst")).select("src", lower_ascii(F.col("_dst")).alias("dst"))
    return each.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def link_shares(links: DataFrame) -> DataFrame:
    """kind, src, dst, share: for trust a link's share of those that leave its page's host, for distrust of those that arrive."""
    total, found = links.count(), []
    for kind, src, dst in (("trust", "src", "dst"), ("distrust", "dst", "src")):
        turned = links.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "weight")
        sums = turned.groupBy("src").agg(F.sum("weight").alias("_all"), F.count("*").alias("_n"))
        hot = common.hot_keys(sums, "src", "_n", total)
        found.append(common.join_one(turned, sums.drop("_n"), "src", hot, "dst", "inner").select(F.lit(kind).alias("kind"), "src", "dst", (F.col("weight") / F.col("_all")).alias("share")))
    return found[0].unionByName(found[1])


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank over seeds (kind, host, mass) and edges (kind, src, dst, share of src's links).

    A rank is the sum of what arrives in round after round, so a round passes on only what arrived in the last one. The
    rounds end when all later ones together can't bring more than ``tolerance``, whatever host they meet at: each passes on at
    most damping times what all hosts got in the one before. So no rank is off by more, however long the chains are; a bound
    on single hosts' changes would stop while a hub's mass is spread thin. Ranks are in units of the restart, so a seed that
    nothing points to keeps its mass. Mass that hosts without links would pass on is dropped. A hub's edges are salted.
    """
    if edges.isEmpty():
        return seeds
    spark = seeds.sparkSession
    node = lambda host: F.concat(F.col("kind"), F.lit(":"), F.col(host))
    from_node = edges.select("kind", node("src").alias("node"), "dst", "share")
    hot = common.hot_keys(from_node.groupBy("node").agg(F.count("*").alias("n")), "node", "n", edges.count())
    folder, arrived, k = common.fresh_path(spark, "ranks"), seeds, 0
    while True:
        passed = common.join_one(from_node, arrived.select(node("host").alias("node"), "mass"), "node", hot, "dst", "inner")
        passed = passed.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.lit(damping) * F.col("mass") * F.col("share")).alias("mass"))
        passed.write.option("compression", "zstd").parquet(f"{folder}/round={k}")
        arrived = spark.read.schema(passed.schema).parquet(f"{folder}/round={k}")
        total, k = arrived.agg(F.sum("mass")).first()[0], k + 1
        if (total or 0.0) * damping / (1 - damping) <= tolerance:
            break
    rounds = spark.read.schema(passed.schema).parquet(*[f"{folder}/round={i}" for i in range(k)])
    return seeds.unionByName(rounds).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def host_verdicts(pages: DataFrame, damping: float, tolerance: float, threshold: float) -> DataFrame:
    """host, trust, distrust, host_verdict. ``pages`` has host, html and ruled (a rule's verdict or null)."""
    found = common.written(pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")), "hosts")
    mass = [found.where(f"{c} > 0").select(F.lit(k).alias("kind"), "host", (F.col(c) / F.col("pages")).alias("mass")) for k, c in (("trust", "allowed"), ("distrust", "blocked"))]
    links = common.written(host_edges(pages), "host-edges")
    edges = common.written(link_shares(links), "host-shares")
    ranks = propagate(common.written(mass[0].unionByName(mass[1]), "seeds"), edges, damping, tolerance)
    by_host = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"))
    verdict = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold), "block").otherwise("allow")
    return found.join(by_host, "host", "left").select("host", "pages", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")).withColumn("host_verdict", verdict)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], damping: float = 0.85, tolerance: float = TOLERANCE, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page (columns page_id, url, html)."""
    host, path = url_parts(F.col("url"))
    rule, ruled = match_rules(F.col("host"), F.col("path"), rules)
    split = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumns({"rule": rule, "ruled": ruled})
    hosts = common.written(host_verdicts(split, damping, tolerance, threshold), "host-verdicts")
    named = hosts.select("host", "trust", "distrust", "host_verdict")
    if hosts.count() <= BROADCAST_HOSTS:
        joined = split.drop("html").join(F.broadcast(named), "host", "left")
    else:
        hot = common.hot_keys(hosts, "host", "pages", pages.count())
        joined = common.join_one(split.drop("html"), named, "host", hot, "page_id")
    verdict = F.coalesce("ruled", "host_verdict", F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")
