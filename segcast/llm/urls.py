"""URL filter: rules by host and path, and link-graph propagation where no rule fits.

A rule names an action, a host and a path.  It fits pages of its host and all its
subdomains whose path starts with the rule's; of several, the longest wins.

Hosts that rules decide for more than half of their pages are seeds.  Trust flows from
allowed seeds along links, distrust from blocked seeds against the links, to whoever links to
them, both as personalised PageRank: a host hands ``damping`` times its rank on, divided among
its links.  A seed starts with as much rank as it has links to divide it among.

A rank by itself depends on the size of the graph, so each host is judged by a share: what it
received from the seeds' ranks over what it would have received were every host a seed (its
relative mass).  The share is between 0 and 1 and free of the seed's in-degree: a link to
a blocked host weighs the same whether 1 or 2,000 others link there too, and 0.05 is about one
link in 20.  Seeds themselves have share 1.  A host is blocked when its distrust is at least
``threshold`` and more than its trust.

Rank of hosts without links to hand it on along is not returned to the seeds: that would only
multiply all ranks of one seed set by a constant, which the share must not contain.  All ranks
run together on one edge table, a join and a partly pre-aggregated sum a step, each step
written to the shared folder, until no host's rank moves by more than ``tolerance`` of itself.
After t steps what is still to come is under damping^t times all links, so the number of steps
is bounded by the tolerance and the links; if ranks still moved beyond it, that is an error.

Defined cases: a null url or one without :// has an empty host and path, fits no rule and
is allowed; null html has no links; links to a page's own host are left out; without seeds or
links nobody is blocked but by rule; repeated rows give repeated results; columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segcast.llm.common import materialise
from segcast.llm.dedup import ascii_lower

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.05
_LINK = r"(?i)href\s*+=\s*+[\"']?\s*+(?:https?:)?//([^/\"'?#\s>]++)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty if there is no ://."""
    rest = F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Longest fitting rule, as host and path in one string, and its action; nulls if none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, n) of links between different hosts, from (host, links)."""
    links = pages.select(F.col("host").alias("source"), F.explode("links").alias("link"))
    links = links.select("source", ascii_lower(F.col("link")).alias("target"))
    links = links.filter((F.col("source") != F.col("target")) & (F.col("source") != ""))
    return links.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, seed_rank, rank, share): trust from ``seeds`` (kind, host) along ``edges``, distrust against them.

    ``seed_rank`` is the personalised PageRank a host received from the seeds, ``rank`` what it received with
    every host a seed; ``share`` is their quotient.  Hosts that receive nothing have no row.
    """
    both = edges.select(F.lit("trust").alias("kind"), "source", "target", "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n"))
    out = both.groupBy("kind", "source").agg(F.sum("n").alias("all_n"))
    marks = seeds.select("kind", F.col("host").alias("source"), F.lit(1.0).alias("seed"))
    flows = both.join(out.join(marks, ["kind", "source"], "left"), ["kind", "source"])
    flows = flows.select("kind", "source", "target", "n", F.coalesce(F.col("n") * F.col("seed"), F.lit(0.0)).alias("seed_n"),
                         (F.col("n") / F.col("all_n")).alias("part"))
    flows = materialise(flows, "url-flows")
    all_links = flows.agg(F.sum("n")).first()[0] or 0
    ranks = None
    for _ in range(2 + math.ceil(math.log(tolerance / max(all_links, 1)) / math.log(damping))):
        if ranks is None:
            carried = flows.withColumn("seed_rank", F.lit(0.0)).withColumn("rank", F.lit(0.0))
        else:
            old = ranks.select("kind", F.col("host").alias("source"), "seed_rank", "rank")
            carried = flows.join(old, ["kind", "source"], "left").na.fill(0.0, ["seed_rank", "rank"])
        got = lambda start, rank: damping * F.sum(F.col(start) + F.col("part") * F.col(rank))
        new = carried.groupBy("kind", F.col("target").alias("host")).agg(
            got("seed_n", "seed_rank").alias("seed_rank"), got("n", "rank").alias("rank"))
        new = materialise(new, "url-ranks")
        if ranks is not None:  # every step reaches the same hosts
            move = F.max((F.col("rank") - F.col("old")) / F.col("rank"))
            change = new.join(ranks.select("kind", "host", F.col("rank").alias("old")), ["kind", "host"]).agg(move).first()[0]
            if (change or 0.0) <= tolerance:
                return new.withColumn("share", F.col("seed_rank") / F.col("rank"))
        ranks = new
    raise RuntimeError("link ranks did not settle")


def host_verdicts(edges: DataFrame, seeds: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, blocked) of every seed and every host that trust or distrust reaches, both between 0 and 1."""
    shares = propagate(edges, seeds).select("kind", "host", F.round("share", 6).alias("share"))
    shares = shares.unionByName(seeds.select("kind", "host", F.lit(1.0).alias("share")))
    by_kind = [F.max(F.when(F.col("kind") == k, F.col("share")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")]
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return shares.groupBy("host").agg(*by_kind).withColumn("blocked", blocked)


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, host_trust, host_distrust."""
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"),
                        F.coalesce(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), F.array().cast("array<string>")).alias("links"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    read = materialise(read.withColumn("rule", rule).withColumn("action", action), "url-pages")

    count = lambda a: F.count_if(F.col("action") == a)
    hosts = read.filter("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), count("allow").alias("allow"), count("block").alias("block"))
    kind = F.when(F.col("allow") * 2 > F.col("n"), "trust").when(F.col("block") * 2 > F.col("n"), "distrust")
    seeds = hosts.select(kind.alias("kind"), "host").filter("kind is not null")
    hosts = host_verdicts(host_edges(read), seeds, threshold)
    judged = read.join(hosts, "host", "left")
    verdict = F.coalesce("action", F.when(F.col("blocked"), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"),
                         F.coalesce("trust", F.lit(0.0)).alias("host_trust"), F.coalesce("distrust", F.lit(0.0)).alias("host_distrust"))
