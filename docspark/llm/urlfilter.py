"""URL filters: host rules, and trust propagated over the host graph.

Rules are allow or block entries of a host and a path; a rule fits its host and
all subdomains when the url's path starts with the rule's, and the longest wins.
Pages that no rule fits are judged by their host: personalised PageRank carries
trust from hosts with allowed pages along links, and distrust from hosts with
blocked pages against them (who links to a blocked host is suspect). A host is
blocked if its share of distrust is over the threshold.

Host edges are links between pages' hosts, and, with a weight of their own, the
ties between a host and its parent domain in both directions, so that a site's
subdomains share what is known of it. Every step is an aggregation or a join by
host; the edge table has one row for a pair of hosts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import store, workers_ready

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(name: Column) -> Column:
    """A host and all domains above it, the longest first: a.b.c, b.c, c."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): each host's fitting rules, the longest first (ties: the smaller text, then block).

    The array holds the rules written for the host or a domain above it."""
    names = hosts.select("host", F.explode(domains(F.col("host"))).alias("domain"))
    fit = names.join(rules.select(F.translate("host", _UPPER, _LOWER).alias("domain"), F.col("path").alias("p"), "action"), "domain")
    rule = F.concat("domain", "p")
    found = fit.groupBy("host").agg(F.sort_array(F.collect_set(F.struct(
        (-F.length(rule)).alias("order"), rule.alias("rule"), F.when(F.col("action") == "block", 0).otherwise(1).alias("kind"),
        "p", "action"))).alias("rules"))
    return found


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, one row for a pair."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(_HREF), F.lit(1))).alias("u"))
    target = F.when(F.col("u").startswith("//"), F.concat(F.lit("http:"), "u")).otherwise(F.col("u"))
    return (found.select("src", host(target).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n")))


def family(hosts: DataFrame, weight: float) -> DataFrame:
    """(src, dst, n): a host with its parent domain of two labels or more, both ways."""
    chain = hosts.select(F.filter(domains(F.col("host")), lambda d: d.contains(".")).alias("d"))
    up = chain.select(F.explode(F.arrays_zip(
        F.slice("d", 1, F.greatest(F.size("d") - 1, F.lit(0))).alias("a"),
        F.slice("d", 2, F.greatest(F.size("d") - 1, F.lit(0))).alias("b"))).alias("e")).select("e.a", "e.b").distinct()
    return up.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                                       F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select(
        "e.src", "e.dst", F.lit(float(weight)).alias("n"))


def _by_host(rank: DataFrame) -> DataFrame:
    trust, distrust = (F.sum(F.when(F.col("kind") == k, F.col("r")).otherwise(0.0)) for k in (0, 1))
    return rank.groupBy("host").agg(trust.alias("trust"), distrust.alias("distrust"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, cut: int = 4) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank.

    ``edges``: src, dst, n. ``seeds``: host, good, bad (weights, each summing to
    one or zero). Trust follows edges, distrust goes against them; what reaches a
    host without a way on is lost to the seeds' share. Rounds go on until, over ``cut`` of
    them, no host is reached for the first time and no host's share of distrust changes by more than
    ``tolerance``, however long the way from a seed is. The ranks are written every
    ``cut`` rounds; one number of them reaches the driver."""
    both = edges.select(F.lit(0).alias("kind"), "src", "dst", "n").union(
        edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    ways = store(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "ways")
    start = seeds.select(F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), "host", F.col("good").alias("s")),
        F.struct(F.lit(1).alias("kind"), "host", F.col("bad").alias("s")))).alias("x")).select("x.*").where("s > 0")
    start = store(start, "seeds")
    rank = start.select("kind", "host", F.col("s").alias("r"))
    before = None
    while True:
        for _ in range(cut):
            sent = rank.withColumnRenamed("host", "src").join(ways, ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), (F.col("r") * F.col("share") * damping).alias("r"))
            rank = (sent.union(start.select("kind", "host", (F.col("s") * (1 - damping)).alias("r")))
                    .groupBy("kind", "host").agg(F.sum("r").alias("r")))
        rank = store(rank, "ranks")
        now = _by_host(rank).where("trust + distrust > 0").select("host", (F.col("distrust") / (F.col("trust") + F.col("distrust"))).alias("share"))
        if before is not None:
            moved = now.join(before.withColumnRenamed("share", "was"), "host", "left").agg(
                F.max(F.coalesce(F.abs(F.col("share") - F.col("was")), F.lit(1.0)))).first()[0]
            if (moved or 0.0) <= tolerance:
                return _by_host(rank)
        before = now


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html", threshold: float = 0.5, family_weight: float = 1.0,
               damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """One row a page: ``id_col``, host, path, rule, verdict, trust, distrust.

    ``rules``: (action, host, path) with action allow or block, as tuples or a
    DataFrame of these columns. ``rule`` is the longest fitting rule's host and
    path, null if none fits; then the verdict is the host's: block if
    distrust / (trust + distrust) is over ``threshold``, else allow, which is
    also the verdict where nothing is known. A host seeds trust by its share of
    all allowed pages, distrust by its share of all blocked ones. A null url or
    one without ``://`` has an empty host and path and no edges; null html has
    no links. Repeated rows count each time. Other columns are not read.
    """
    spark = pages.sparkSession
    workers_ready(spark)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "action string, host string, path string")
    rows = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"),
                        F.col(html_col).alias("html"))
    named = rows.select("id", "host", "path")
    hosts = store(rows.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    fitting = store(host_rules(hosts, rules), "host-rules")
    first = F.filter("rules", lambda r: F.startswith(F.col("path"), r["p"]))
    ruled = named.join(fitting, "host", "left").withColumn("first", F.get(first, F.lit(0)))
    counted = ruled.where("first is not null").groupBy("host").agg(
        F.sum(F.when(F.col("first.action") == "allow", 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("first.action") == "block", 1).otherwise(0)).alias("bad"))
    counted = store(counted, "ruled-hosts")
    total = counted.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    seeds = counted.select("host", (F.col("good") / F.lit(float(total["good"] or 1))).alias("good"),
                           (F.col("bad") / F.lit(float(total["bad"] or 1))).alias("bad"))
    edges = links(rows).union(family(hosts, family_weight)).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    ranks = propagate(edges, seeds, damping, tolerance)
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    bad = (F.col("trust") + F.col("distrust") > 0) & (share > threshold)
    known = hosts.join(ranks, "host", "left").join(fitting, "host", "left").select(
        "host", "rules", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    known = known.withColumn("judged", F.when(bad, "block").otherwise("allow"))
    out = named.join(known, "host", "left").withColumn("first", F.get(first, F.lit(0)))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("first.rule").alias("rule"),
                      F.coalesce(F.col("first.action"), "judged", F.lit("allow")).alias("verdict"),
                      F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
