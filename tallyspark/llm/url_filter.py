"""Operator 10: URL filter by rules and link-graph propagation, in DataFrame functions only.

Rules judge the pages they fit. The verdicts then spread over the host graph: trust by personalised PageRank
from hosts with allowed pages along links, a host's trust dealt among those it links to; distrust from hosts with
blocked pages against the links, as the discounted mean over the hosts that one links to (who links to bad hosts
alone is bad, however many others do). A seed weighs as the share of its pages that rules allow or block. Rounds go
on until the ranks stand still. Pages without a rule follow their host: blocked where distrust exceeds the threshold
and trust.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, fold, join_uneven

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def url_parts(url: str) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null or without ://."""
    text = F.coalesce(F.col(url), F.lit(""))
    return fold(F.regexp_extract(text, r"://([^/?#]*)", 1)), F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)


def matching_rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule of columns host and path as (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct links between different hosts, from the href attributes of each page; `pages` has host and html."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""), F.lit(1))).alias("dst"))
    return links.select("src", fold(F.col("dst")).alias("dst")).where("src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, share_of: str = "src", tolerance: float = 1e-4, most_rounds: int = 100) -> DataFrame:
    """(host, rank): seeds (host, weight) and what reaches each host along `edges` (src, dst), damped at each link.

    A link passes the rank over the number of links of its `share_of` end: of src, a host deals its rank among its
    targets (personalised PageRank); of dst, a host gets the mean over its sources. What hosts without links hold ends
    there. Rounds end when all ranks together move by less than the tolerance, as a share of their sum.
    """
    degree = edges.groupBy(share_of).agg(F.count(F.lit(1)).alias("degree"))
    links = cut(edges.join(degree, share_of))
    first = seeds.select("host", F.col("weight").alias("rank"))
    if links.isEmpty():
        return first
    ranks = first
    for i in range(1, most_rounds + 1):
        given = links.join(ranks, links.src == ranks.host).select(F.col("dst").alias("host"), (damping * F.col("rank") / F.col("degree")).alias("rank"))
        after = first.unionByName(given).groupBy("host").agg(F.sum("rank").alias("rank"))
        if i % 4:
            ranks = after
            continue
        after = cut(after)
        moved = after.join(ranks.withColumnRenamed("rank", "was"), "host", "left")
        total, change = moved.agg(F.sum("rank"), F.sum(F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0))))).first()
        ranks = after
        if not total or change <= tolerance * total:
            break
    return ranks


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, damping: float = 0.85) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule gives the verdict, else the host's ranks: block where distrust exceeds `threshold` and
    trust. Hosts that nothing reaches are allowed, and so are pages without a host. Null html has no
    links; null ids and repeated rows are judged each. Other columns are ignored.
    """
    host, path = url_parts("url")
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("m", matching_rule(rules))
    share = [F.avg((F.col("m.verdict") == v).cast("double")).alias(v) for v in ("allow", "block")]
    filled = parsed.select("host", F.struct(F.coalesce("m.rule", F.lit("")).alias("rule"), F.coalesce("m.verdict", F.lit("")).alias("verdict")).alias("m"))
    hosts = cut(filled.groupBy("host").agg(*share, F.count(F.lit(1)).alias("n_pages")))
    edges = cut(host_edges(parsed.select("host", "html")))
    seeds = lambda v: hosts.where((F.col("host") != "") & (F.col(v) > 0)).select("host", F.col(v).alias("weight"))
    trust = propagate(edges, seeds("allow"), damping)
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds("block"), damping, "dst")
    ranks = hosts.select("host", "n_pages").join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
    joined = join_uneven(parsed.select("page_id", "host", "path", "m"), cut(ranks), ["host"], "n_pages", F.struct("page_id", "path")).na.fill(0.0, ["trust", "distrust"])
    by_host = F.when((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", by_host).alias("verdict"), "trust", "distrust")
