"""URL filter by rules and by trust that spreads over the link graph.

A rule names a host and a path prefix; it fits the host and its subdomains. The longest
rule that fits decides. A url that no rule fits is judged by its host: personalised
PageRank spreads trust from hosts with allowed urls along links (a trusted host vouches
for what it links to), and distrust from hosts with blocked urls against the links (who
links to a blocked host is suspect). A host is blocked where its distrust exceeds
``margin`` times its trust.

Edges are links between different hosts, distinct, found in the pages' href attributes;
relative links stay on their host and make none. A step is one join and one sum with partial
aggregation; scores are written to the shared folder every few steps, until between two of
these no host is new and none changes by more than ``tolerance`` times its score, so that
hosts however far from a seed get theirs.

Defined results: null url or one without ``://`` has empty host and path; the empty host
takes no part in the graph and its verdict is ``allow``; null or empty html has no links;
repeated pages count each as a seed but their links once; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorlake.llm.common import saved, without

DAMPING = 0.85
TOLERANCE = 1e-6
MARGIN = 1.0
SAVE_EVERY = 4
HREF = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, rule.name).otherwise(out)
    return out


def judge_rules(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """Input columns plus host, path, rule and ruled (the rule's verdict or null)."""
    pages = without(pages, "host", "path", "rule", "ruled")
    found = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    found = found.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for rule in rules:
        ruled = F.when(F.col("rule") == rule.name, rule.verdict).otherwise(ruled)
    return found.withColumn("ruled", ruled)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (src, dst) pairs of different hosts."""
    url = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(HREF), F.lit(1))))
    links = pages.select(host_of(F.col(url_col)).alias("src"), url.alias("to"))
    full = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    return links.select("src", host_of(full).alias("dst")).where("src <> dst AND src <> '' AND dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, *, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score): personalised PageRank of each kind from ``seeds`` (kind, host, weight) along ``edges`` (kind, src, dst).

    Seed weights are scaled to sum 1 in each kind. A host without outgoing edges passes nothing on.
    """
    sums = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))  # one row a kind
    base = saved(seeds.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("score")), "seeds")
    degree = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    edges = saved(edges.join(degree, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.lit(damping) / F.col("degree")).alias("share")), "edges")
    if edges.isEmpty():
        return base
    start = base.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    scores, unsettled = start, True
    while unsettled:
        before = scores
        for _ in range(SAVE_EVERY):
            moved = scores.join(edges, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"))
            scores = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        scores = saved(scores, "rank")
        old = before.select("kind", "host", F.col("score").alias("old"))
        change = F.col("score") - F.coalesce("old", F.lit(0.0))  # scores only rise
        unsettled = not scores.join(old, ["kind", "host"], "left").where(change > tolerance * F.col("score")).isEmpty()
    return scores


def judge(pages: DataFrame, rules: list[Rule], *, margin: float = MARGIN, tolerance: float = TOLERANCE, keep: list[str] | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``keep`` columns (all by default) plus host, path, rule, verdict, trust and distrust of the host."""
    ours = ("host", "path", "rule", "verdict", "trust", "distrust")
    pages = without(pages, *ours)
    keep = [c for c in (pages.columns if keep is None else keep) if c in pages.columns]
    ruled = judge_rules(pages.select(*dict.fromkeys([*keep, url_col])), rules, url_col)
    seeds = (
        ruled.where("ruled IS NOT NULL AND host <> ''").groupBy("host", "ruled").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .select(F.when(F.col("ruled") == "block", "distrust").otherwise("trust").alias("kind"), "host", "weight")
    )
    links = saved(host_edges(pages, url_col, html_col), "links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    scores = propagate(both, seeds, tolerance=tolerance)
    by_host = scores.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    found = ruled.join(by_host, "host", "left").fillna(0.0, ["trust", "distrust"])
    verdict = F.coalesce("ruled", F.when(F.col("distrust") > margin * F.col("trust"), "block").otherwise("allow"))
    return found.withColumn("verdict", verdict).select(*keep, "host", "path", "rule", "verdict", "trust", "distrust")
