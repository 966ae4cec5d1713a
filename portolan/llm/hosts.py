"""Operator 5: URL filters by rules and by trust along the links between hosts.

The longest rule that fits a url decides. For the others the host decides: trust starts at hosts
with allowed pages and follows links; distrust starts at hosts with blocked pages and follows links
backwards, to hosts that point there. Both are personalised PageRank over the table of host edges,
one join and one aggregation per round. A host with more distrust than trust is blocked.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.shared import filled, stored

DAMPING = 0.6
#: Largest part of its value by which any host may still change when rounds end, and the least change that counts: below it doubles end.
TOLERANCE, LEAST_CHANGE = 1e-6, sys.float_info.min
RATIO = 1.0
#: The host of each absolute link; links within a host lead nowhere else.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def lower_ascii(value: Column) -> Column:
    return F.translate(value, ascii_uppercase, ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits, else null.

    A rule fits its host and all its subdomains if the path starts with the rule's. Rules are configuration,
    written into the expression; of equally long ones the first in order of text counts.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) pages of src that link to another host dst, from rows (host, html)."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lower_ascii))
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(found).alias("dst")).filter("dst <> src and dst <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from ``hosts`` (host, trust, distrust seeds).

    A host shares its trust over the hosts it links to, by pages, and its distrust over the hosts that link to it.
    Seeds are divided by their sum. Values only rise, and rounds end when none rises by more than ``tolerance`` of itself:
    a host reached for the first time rises by all of it, so every host that links reach from a seed is reached, however
    little of the mass flows there. What is then missing at a host is at most ``tolerance`` times its value times the mean
    number of links that its mass came by.
    """
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("total"))
    into = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("total"))
    forth = edges.join(out, edges["src"] == out["host"]).select(F.col("src").alias("from"), F.col("dst").alias("host"), (F.col("n") / F.col("total")).alias("by_trust"), F.lit(0.0).alias("by_distrust"))
    back = edges.join(into, edges["dst"] == into["host"]).select(F.col("dst").alias("from"), F.col("src").alias("host"), F.lit(0.0).alias("by_trust"), (F.col("n") / F.col("total")).alias("by_distrust"))
    flows = stored(forth.unionByName(back), "flows")
    linked = flows.select("host").distinct().withColumns({"trust": F.lit(0.0), "distrust": F.lit(0.0)})
    seeds = hosts.unionByName(linked).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    seeds = stored(seeds, "seeds")
    sums = seeds.agg(F.sum("trust"), F.sum("distrust")).first()
    share = lambda c, total: F.col(c) / F.lit(float(total or 0) or 1.0)
    start = seeds.select("host", share("trust", sums[0]).alias("seed_trust"), share("distrust", sums[1]).alias("seed_distrust"))
    ranks = stored(start.withColumns({"trust": F.col("seed_trust") * (1 - damping), "distrust": F.col("seed_distrust") * (1 - damping)}), "ranks")
    while True:
        given = flows.join(ranks.select(F.col("host").alias("from"), "trust", "distrust"), "from")
        given = given.groupBy("host").agg(F.sum(F.col("trust") * F.col("by_trust")).alias("more_trust"), F.sum(F.col("distrust") * F.col("by_distrust")).alias("more_distrust"))
        after = ranks.withColumnsRenamed({"trust": "was_trust", "distrust": "was_distrust"}).join(given, "host", "left")
        for c in ("trust", "distrust"):
            after = after.withColumn(c, F.col(f"seed_{c}") * (1 - damping) + F.coalesce(f"more_{c}", F.lit(0.0)) * damping)
        after = stored(after.select("host", "seed_trust", "seed_distrust", "trust", "distrust", "was_trust", "was_distrust"), "ranks")
        rises = lambda c: F.abs(F.col(c) - F.col(f"was_{c}")) > F.col(c) * tolerance + LEAST_CHANGE
        settled = after.filter(rises("trust") | rises("distrust")).isEmpty()
        ranks = after.drop("was_trust", "was_distrust")
        if settled:
            return ranks.select("host", "trust", "distrust")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], ratio: float = RATIO, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    ``rules``: (host, path, "allow" or "block"). Without a fitting rule the verdict is block where the host's distrust
    exceeds ``ratio`` times its trust, else allow; so hosts that nothing is known of, empty hosts and null urls are
    allowed. Null pages have no links. Rows that repeat an id are judged each and count as pages; other columns are
    ignored; an empty table gives an empty table.
    """
    host, path = host_and_path(filled(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), filled(html_col).alias("html"))
    ruled = rows.withColumn("by_rule", longest_rule(F.col("host"), F.col("path"), rules))
    decided = F.col("by_rule.verdict")
    seeds = ruled.filter("host <> ''").groupBy("host").agg(F.count(F.when(decided == "allow", 1)).cast("double").alias("trust"), F.count(F.when(decided == "block", 1)).cast("double").alias("distrust"))
    ranks = spread(seeds, stored(host_edges(rows), "edges"))
    out = ruled.drop("html").join(ranks, "host", "left")
    by_host = F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce(decided, by_host).alias("verdict"), "trust", "distrust")
