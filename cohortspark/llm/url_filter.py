"""URL filter: host and path rules, and link-graph propagation for the rest
(DataFrame operations only).

Rules. A rule fits its host and all subdomains where the url's path starts with
the rule's path; of those that fit, the longest (host and path together, then
the first in order) decides.

Propagation. Pages that no rule decides are judged by their host. Hosts are
joined by the links of their pages (absolute or protocol-relative hrefs, as many
as there are; links within a host and relative links say nothing). Personalised
PageRank spreads trust along the links from the hosts with pages that a rule
allows, and distrust against the links from the hosts with pages that a rule
blocks: who links to a blocked host is suspect. A seed's weight is its number of
such pages; rank that reaches a host without further links goes back to the
seeds. A host is blocked if, of its trust and the distrust that came to it over
links, more than the share ``threshold`` is distrust. Both are parts of a whole of
1, so they shrink as the table grows and as a seed gets more linkers; their ratio
does not. (Its own seed weight does not count against it: a rule on one path does
not condemn the rest of the host.)

Scale. Host edges are aggregated before anything else, with a partial aggregate,
so a host with a third of all pages is a few rows. Rules meet the distinct
hosts by an equi-join on host suffixes of as many labels as rules have; pages
join their host's row (one side has a row per host, which AQE can split). Every
step of propagation is written to the shared folder; at most 86 bring what moves
to the tolerance.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is allowed; null html has no links; repeated rows and null
page_ids are judged each; without seeds or links trust and distrust stay where
they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import read

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DAMPING, TOLERANCE = 0.85, 1e-6
#: Share of distrust in trust and distrust above which a host is blocked; ties within rounding are allowed.
THRESHOLD, ROUNDING = 0.5, 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The authority of an absolute or protocol-relative link.
_HREF = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], "rule_verdict string, rule_host string, rule_path string, turn int")


def judged_by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (page_id, host, path) -> with rule and rule_verdict (null: none fits)."""
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("n")).first()["n"] or 0
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.lit(max(labels, 1)), F.size(parts))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    hosts = pages.select("host").distinct()
    fits = hosts.select("host", F.explode(tails).alias("rule_host")).join(rules, "rule_host")
    size = -(F.length("rule_host") + F.length("rule_path"))
    of = fits.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(size.alias("size"), "turn", "rule_host", "rule_path", "rule_verdict"))).alias("rules"))
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    joined = pages.join(of, "host", "left").withColumn("first", first)
    return joined.select("page_id", "host", "path", F.concat("first.rule_host", "first.rule_path").alias("rule"), F.col("first.rule_verdict").alias("rule_verdict"))


def host_links(pages: DataFrame) -> DataFrame:
    """``pages`` (host, html) -> (src, dst, n): links between different hosts."""
    each = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("dst"))
    each = each.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src <> '' and src <> dst")
    return each.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: ``links`` (src, dst, n), ``seeds`` (host, weight > 0) ->
    (host, rank, received): received is what came over links.

    The steps of the walk from the seeds are written one by one; what returns to the
    seeds is the same in every host but for a factor, so it weighs the steps at the
    end. Without ``rounds`` it goes on until a step moves at most ``tolerance``: step t
    moves at most damping**t, which bounds them."""
    total = seeds.agg(F.sum("weight").alias("w")).first()["w"]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("rank"), F.lit(0.0).alias("received")).limit(0)
    out = links.groupBy("src").agg(F.sum("n").alias("out"))
    shares = materialize(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")), "rank-shares")
    steps, moved = [materialize(seeds.select("host", (F.col("weight") / total).alias("x")), "rank-seeds")], [1.0]
    last = math.ceil(math.log(tolerance) / math.log(damping)) if rounds is None else rounds
    while len(steps) <= last:
        step = steps[-1].join(shares, steps[-1]["host"] == shares["src"]).groupBy("dst").agg((damping * F.sum(F.col("x") * F.col("share"))).alias("x"))
        step = materialize(step.select(F.col("dst").alias("host"), "x"), "rank-step")
        mass = step.agg(F.sum("x").alias("m")).first()["m"] or 0.0
        if mass == 0:
            break
        steps.append(step)
        moved.append(mass)
        if rounds is None and mass <= tolerance:
            break
    if rounds is None:
        weights = [1 / sum(moved)] * len(steps)
    else:  # of the round's own seed rank, which returns what did not go over links
        own = [1.0]
        for t in range(rounds):
            own.append(1 - sum(own[t - k] * m for k, m in enumerate(moved[1:]) if k <= t))
        weights = own[::-1]
    parts = [x.select("host", (F.col("x") * w).alias("rank"), (F.col("x") * (w if k else 0.0)).alias("received")) for k, (x, w) in enumerate(zip(steps, weights))]
    return materialize(reduce(DataFrame.unionByName, parts).groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("received").alias("received")), "rank")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust): one row per page."""
    host, path = host_and_path(F.col("url").cast("string"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    judged = materialize(judged_by_rules(split.drop("html"), rule_frame(pages.sparkSession, rules)), "url-rules")
    links = materialize(host_links(split.select("host", "html")), "url-links")
    count = lambda verdict: judged.where((F.col("rule_verdict") == verdict) & (F.col("host") != "")).groupBy("host").agg(F.count("*").cast("double").alias("weight"))
    trust = propagate(links, count("allow")).select("host", F.col("rank").alias("trust"))
    turned = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(turned, count("block")).select("host", F.col("received").alias("distrust"))
    scores = trust.join(distrust, "host", "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    known = judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", "rule_verdict", zero("trust"), zero("distrust"))
    own = F.when(F.col("distrust") > (F.col("trust") + F.col("distrust")) * (threshold + ROUNDING), "block").otherwise("allow")
    return known.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "trust", "distrust")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), RULES)
