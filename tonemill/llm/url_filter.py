"""URL filters: rules, and link-graph propagation for what they leave open.

A rule (action, host, path) fits a url whose host is the rule's or below it
and whose path starts with the rule's; the longest fitting rule wins. Urls
without a rule get the verdict of their host: personalised PageRank spreads
trust along links from hosts whose pages rules allow, and reversed PageRank
spreads distrust against links from hosts whose pages rules block (who links
to a blocked host is suspect). A host is blocked if its distrust exceeds its
trust by more than a threshold. Seeds are the share of a host's pages that
rules allow or block, so a host's level doesn't depend on the size of the web:
ranks are the PageRank distribution times the sum of all seeds. What reaches a
host without links goes back to the seeds.

Edges are counted per pair of hosts before anything else is shuffled, so a
host with a third of all pages is one row per neighbour. What flows is written
to the shared folder in each round; the rounds end when no host can be further
than a tolerance from its limit.

Defined cases: a null url, or one without ://, has empty host and path, fits
no rule and is allowed, there being no evidence; null html has no links; links
within a host and relative ones say nothing about other hosts and are left
out; a host that no seed reaches has rank 0; equal trust and distrust allow;
repeated rows are judged alike, and each stays; an empty table gives an empty
result; very long urls and pages are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialize, small

Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.0
#: Rounds after which something must be wrong: each brings ranks nearer by DAMPING.
ENDLESS = 1000
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = "(?is)<a\\s[^>]*?href\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _first_rule(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """value(rule) of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        _, name, prefix = rule
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def with_rules(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's action, null without a rule."""
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    return named.select("*", _first_rule(host, path, rules, lambda r: r[1] + r[2]).alias("rule"), _first_rule(host, path, rules, lambda r: r[0]).alias("action"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1)).alias("to"))
    ends = links.select("src", ascii_lower(F.col("to")).alias("dst")).filter("src <> '' and src <> dst")
    return ends.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank) of rank = (1 - damping) * seed + damping * inflow along
    ``edges`` (src, dst, n), to within the tolerance; ``seeds`` is (host, seed).
    Inflow includes, for seeds, their share of what hosts without links hold, so
    ranks sum to the seeds. Hosts of rank 0 may be left out."""
    degree = materialize(edges.groupBy("src").agg(F.sum("n").alias("total")), "host-degrees")
    shares = materialize(edges.join(small(degree), "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "host-shares")
    start = materialize(seeds.filter("seed > 0").select("host", "seed"), "host-seeds")
    mass = start.agg(F.sum("seed")).first()[0]
    rank = start.select("host", F.col("seed").alias("rank"))
    if mass is None:
        return rank
    held: list[DataFrame] = []
    for _ in range(ENDLESS):
        by_link = shares.join(rank.withColumnRenamed("host", "src"), "src")
        flow = materialize(by_link.groupBy(F.col("dst").alias("host")).agg(F.round(F.sum(F.col("rank") * F.col("share")), 12).alias("flow")), "host-flows")
        back = (mass - (flow.agg(F.sum("flow")).first()[0] or 0.0)) / mass
        # A host that held anything without a seed now keeps what flows to it, 0 or more.
        terms = start.select("host", (F.col("seed") * (1 - damping + damping * back)).alias("rank"), F.lit(0.0).alias("was"))
        terms = terms.unionByName(flow.select("host", (F.col("flow") * damping).alias("rank"), F.lit(0.0).alias("was")))
        terms = terms.unionByName(rank.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("was")))
        fresh = materialize(terms.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")), "host-ranks")
        moved = fresh.agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0]
        discard(flow, *held)
        rank, held = fresh.select("host", "rank"), [fresh]
        if (moved or 0.0) * damping <= tolerance * (1 - damping):
            discard(degree, shares, start)
            return rank
    raise RuntimeError(f"ranks still move by {moved} after {ENDLESS} rounds")


def host_verdicts(pages: DataFrame, judged: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust, host_verdict) of every host with either rank."""
    share = lambda action: F.avg(F.when(F.col("action") == action, 1.0).otherwise(0.0))
    hosts = materialize(judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")), "hosts")
    edges = materialize(host_edges(pages), "host-edges")
    trust = propagate(edges, hosts.select("host", F.col("good").alias("seed")), tolerance=tolerance)
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(reverse, hosts.select("host", F.col("bad").alias("seed")), tolerance=tolerance)
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full").fillna(0.0)
    return both.withColumn("host_verdict", F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each page."""
    judged = with_rules(pages, rules)
    hosts = small(materialize(host_verdicts(pages, judged, threshold, tolerance), "host-verdicts"))
    verdict = F.coalesce("action", "host_verdict", F.lit("allow"))
    return judged.join(hosts, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
