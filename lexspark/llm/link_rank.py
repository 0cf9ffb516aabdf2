"""URL verdicts: rules first, then trust and distrust propagated over the links between hosts."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from lexspark.session import cut_lineage

DAMPING = 0.85
ROUNDS = 20
# every this many rounds the ranks are written, so a lost executor repeats at most that many
ROUNDS_PER_STEP = 5
# fixed values of the contract
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for a url without ://."""
    whole = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(whole, "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(whole, "://([^/?#]*)([^?#]*)", 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule whose host is this one or a parent of it and whose path starts this one; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts, counted before they are shuffled."""
    links = pages.where(F.col(html).contains("//")).select(
        host_and_path(F.col(url))[0].alias("src"), F.explode(F.regexp_extract_all(html, F.lit(_HREF), F.lit(1))).alias("link"))
    target = host_and_path(F.when(F.col("link").startswith("//"), F.concat(F.lit(":"), "link")).otherwise(F.col("link")))[0]
    return links.select("src", target.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank): personalised PageRank of every kind in seeds (kind, host, mass; masses of a kind sum to 1) over the edges
    (kind, src, dst, share; shares of a source sum to 1). One join and one aggregate a round for all kinds together."""
    own = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("rank"))
    rank = seeds.select("kind", "host", F.col("mass").alias("rank"))
    edges = edges.withColumnRenamed("src", "host")
    for i in range(rounds):
        moved = rank.join(edges, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        rank = own.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if (i + 1) % ROUNDS_PER_STEP == 0:
            rank = cut_lineage(rank)
    return rank


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", html: str = "html",
               rounds: int = ROUNDS, ratio: float = 1.0) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust), one row per row of pages.

    Trust starts at hosts in proportion to their pages that a rule allows and
    follows links; distrust starts at those of blocked pages and follows links
    backwards. A page without a rule is blocked if its host's distrust is
    greater than ratio times its trust. Null and odd urls have an empty host,
    which neither links nor is a seed; they and hosts without any rank are
    allowed. Null html has no links.
    """
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    ruled = cut_lineage(judged.where("_r is not null and host <> ''").groupBy(F.col("_r.verdict").alias("kind"), "host").agg(F.count("*").alias("n")))
    totals = ruled.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = ruled.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("mass"))
    links = cut_lineage(host_edges(pages, url, html))
    both = links.select(F.lit("allow").alias("kind"), "src", "dst", "weight").unionByName(
        links.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    edges = cut_lineage(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    ranks = propagate(edges, seeds, rounds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    hosts = cut_lineage(ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust")))
    joined = judged.join(hosts, "host", "left")
    worse = F.coalesce(F.col("distrust") > F.lit(ratio) * F.col("trust"), F.lit(False))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(worse, "block").otherwise("allow"))
    return joined.select(key, "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"),
                         F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
