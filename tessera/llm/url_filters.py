"""URL filters: rules first, then trust and distrust that spread over the links between hosts.

A rule is a host and the start of a path; it fits the host and all its subdomains, and the longest that fits wins. What
no rule fits is judged by its host. Hosts are the nodes of a graph whose edges are the links between pages of different
hosts (each pair of hosts once), and, both ways, a host and its parent domain where both have pages. Trust is personalised
PageRank from the hosts whose pages the rules allow, in proportion to these pages; distrust is the same from the hosts
whose pages they block, over the edges reversed, since whoever links to a bad host is suspect. A host is blocked
where its distrust is above THRESHOLD percent of its trust.

Both ranks are whole numbers, shares of MASS, divided without remainder in every step: results don't hang on the order
in which Spark adds. A round is one join of ranks and edges and one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved


@dataclass(frozen=True)
class Rule:
    """host without a leading dot; path with its leading slash; verdict: allow or block."""

    host: str
    path: str
    verdict: str


MASS = 10**15
#: Percent of a host's rank that goes on over its links.
DAMPING = 85
ROUNDS = 20
#: Percent of a host's trust above which distrust blocks it.
THRESHOLD = 100
#: Rounds after which ranks are written, so that plans stay short.
KEEP_EVERY = 5
#: Most rows of a table of hosts that is broadcast (some 100 bytes each).
BROADCAST = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The host of a link to another site: the scheme may be left out.
LINK = r"""(?i)href[\x20\t\r\n\f]*=[\x20\t\r\n\f]*["']?(?:https?:)?//([^/?#"'\x20\t\r\n\f>]+)"""


def host_of(url) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _by_host(rows: DataFrame, hosts: DataFrame, size: int) -> DataFrame:
    """Rows with what the table of hosts says of theirs: broadcast if that is small, else joined, where Spark splits hot hosts."""
    return rows.join(F.broadcast(hosts) if size <= BROADCAST else hosts, "host", "left")


def _rules_of(hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """host, rules: those that fit a host by name, for hosts that have any."""
    spark = hosts.sparkSession
    if not rules:
        return hosts.select("host", F.lit(None).cast("array<struct<size:int,rule:string,path:string,verdict:string>>").alias("rules")).limit(0)
    table = spark.createDataFrame([(r.host, len(r.host) + len(r.path), r.host + r.path, r.path, r.verdict) for r in rules], "suffix string, size int, rule string, path string, verdict string")
    most = max(r.host.count(".") for r in rules) + 1
    labels = F.split("host", r"\.")
    least = F.greatest(F.lit(1), F.size(labels) - most + 1)
    suffix = F.explode(F.transform(F.sequence(least, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return hosts.select("host", suffix.alias("suffix")).join(table, "suffix").groupBy("host").agg(F.collect_list(F.struct("size", "rule", "path", "verdict")).alias("rules"))


def apply_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages: page_id, host, path. Adds rule and ruled: the longest rule that fits and its verdict, or nulls."""
    own = saved(_rules_of(pages.select("host").where("host != ''").distinct(), rules))
    size = own.agg(F.sum(F.size("rules"))).first()[0] or 0
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return _by_host(pages, own, size).withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst: each pair of different hosts that a page links, or that are parent domain and child, once."""
    linked = pages.select(host_of("url").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    linked = linked.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src != '' AND dst != '' AND src != dst").distinct()
    hosts = pages.select(host_of("url").alias("host")).where("host != ''").distinct()
    kin = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst")).join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").where("src != dst")
    return linked.unionByName(kin).unionByName(kin.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """edges: src, dst. seeds: host, trust, distrust (counts). Returns host, trust, distrust as shares of MASS.

    A walk that reaches a host without links ends there. Hosts that no walk reaches have no row. Without seeds there are none.
    """
    total = seeds.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    flows = edges.select(F.lit(False).alias("bad"), "src", "dst").unionByName(edges.select(F.lit(True).alias("bad"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    flows = saved(flows.join(flows.groupBy("bad", "src").agg(F.count(F.lit(1)).alias("degree")), ["bad", "src"]))
    share = lambda name: F.expr(f"(CAST({name} AS DECIMAL(38,0)) * {MASS}) div {total[name] or 1}").cast("long")
    start = seeds.select(F.lit(False).alias("bad"), "host", share("trust").alias("rank")).unionByName(seeds.select(F.lit(True).alias("bad"), "host", share("distrust").alias("rank")))
    start = saved(start.where("rank > 0"))
    again = start.select("bad", "host", F.expr(f"rank * {100 - DAMPING} div 100").alias("rank"))
    ranks = start
    for k in range(rounds):
        passed = ranks.withColumnRenamed("host", "src").join(flows, ["bad", "src"]).select("bad", F.col("dst").alias("host"), F.expr(f"rank * {DAMPING} div 100 div degree").alias("rank"))
        ranks = again.unionByName(passed).groupBy("bad", "host").agg(F.sum("rank").alias("rank"))
        if (k + 1) % KEEP_EVERY == 0:
            ranks = saved(ranks)
    part = lambda bad: F.sum(F.when(F.col("bad") == bad, F.col("rank")).otherwise(0))
    return ranks.groupBy("host").agg(part(False).alias("trust"), part(True).alias("distrust"))


def judge(pages: DataFrame, rules: list[Rule], rounds: int = ROUNDS) -> DataFrame:
    """pages: page_id, url, html. One row a page: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ://, has neither host nor path; no rule fits it, it is no node, and it is allowed. So is
    a page whose host no walk reaches. Null or empty html has no links. Rows that repeat are judged each; their links
    count once. Of rules of one length the later by name wins. Very long urls and pages are read whole. Empty table: no rows.
    """
    judged = saved(apply_rules(pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path")), rules))
    count = lambda v: F.sum(F.when(F.col("ruled") == v, 1).otherwise(0))
    seeds = judged.where("ruled IS NOT NULL").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    ranks = saved(spread(host_edges(pages), seeds, rounds))
    rows = _by_host(judged, ranks, ranks.count()).na.fill(0, ["trust", "distrust"])
    bad = F.col("distrust").cast("decimal(38,0)") * 100 > F.col("trust").cast("decimal(38,0)") * THRESHOLD
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
