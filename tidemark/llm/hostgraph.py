"""URL filter by rules and by trust and distrust spread over the host graph.

Rules decide what they fit.  For the rest, personalised PageRank from the hosts
that rules allow runs along the links between hosts, and the same from the hosts
that rules block runs against them: who links to bad hosts is bad.  A host whose
distrust outweighs its trust is blocked.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class SpreadRule:
    """Damping, rounds, and the share of distrust from which a host is blocked."""

    damping: float = 0.85
    rounds: int = 12
    threshold: float = 0.5
    floor: float = 1e-12


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls.

    A rule fits its host and all subdomains of it, under paths that start with its own.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """``(a, b, n)``: links from pages of host ``a`` to another host ``b``, from absolute ``href`` values."""
    pattern = r"""(?is)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
    found = pages.where("html is not null").select(host_of(F.col("url")).alias("a"), F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("b"))
    found = found.select("a", F.translate("b", UPPER, LOWER).alias("b"))
    return found.where("a != '' and b != '' and a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def personalised_rank(links: DataFrame, seeds: DataFrame, rule: SpreadRule = SpreadRule()) -> DataFrame:
    """``(host, rank)`` of hosts reached from ``seeds (host, weight)`` along ``links (a, b, n)``.

    Ranks sum to one but for what hosts without links let go; no seeds, no ranks.
    Links are weighted by their number.  Each round joins the ranks to the links.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 1
    start = cut_lineage(seeds.select("host", (F.col("weight") / F.lit(total)).alias("seed")))
    out = links.groupBy("a").agg(F.sum("n").alias("_out"))
    steps = cut_lineage(links.join(out, "a").select("a", "b", (F.col("n") / F.col("_out")).alias("share")))
    ranks = start.select("host", F.col("seed").alias("rank"))
    if steps.isEmpty():
        return ranks
    for number in range(rule.rounds):
        moved = ranks.join(steps, ranks["host"] == steps["a"]).select(F.col("b").alias("host"), (F.col("rank") * F.col("share") * rule.damping).alias("part"))
        back = start.select("host", (F.col("seed") * (1 - rule.damping)).alias("part"))
        ranks = moved.unionByName(back).groupBy("host").agg(F.sum("part").alias("rank"))
        if number % 3 == 2:
            ranks = cut_lineage(ranks)
    return ranks


def judge_pages(pages: DataFrame, rules: Sequence[UrlRule], rule: SpreadRule = SpreadRule(), default: str = "allow") -> DataFrame:
    """``(page_id, url, host, path, rule, verdict, trust, distrust)`` of every row of ``pages``.

    The longest fitting rule decides; ``rule`` is null where none fits and the host's
    ranks do: blocked when its share of distrust exceeds ``threshold``.  Hosts that
    neither seed reaches get ``default``.  A null url and one without ``://`` have an
    empty host and path; such pages seed nothing.  Null pages of html have no links,
    repeated rows count each, other columns are ignored.
    """
    name, verdict = match_rules(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("rule", name).withColumn("_verdict", verdict)
    seeds = cut_lineage(parsed.where("rule is not null and host != ''").groupBy("host", "_verdict").agg(F.count(F.lit(1)).alias("weight")))
    links = cut_lineage(host_links(pages))
    pick = lambda v: seeds.where(F.col("_verdict") == v).select("host", "weight")
    trust = personalised_rank(links, pick("allow"), rule).withColumnRenamed("rank", "trust")
    against = links.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    distrust = personalised_rank(against, pick("block"), rule).withColumnRenamed("rank", "distrust")
    hosts = trust.join(distrust, "host", "full").fillna(0.0, ["trust", "distrust"]).where(F.col("trust") + F.col("distrust") > rule.floor)
    spread = F.when(F.col("distrust") > rule.threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    hosts = hosts.select("host", "trust", "distrust", spread.alias("_spread"))
    judged = parsed.join(hosts, "host", "left")
    return judged.select(
        "page_id", "url", "host", "path", "rule", F.coalesce("_verdict", "_spread", F.lit(default)).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
