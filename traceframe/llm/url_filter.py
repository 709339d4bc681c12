"""URL filter: rules first, then trust and distrust propagated over host links.

Rules name a host and a path; they fit the host and its subdomains where the
path starts with the rule's, and the longest fitting rule decides. Hosts whose
ruled pages are mostly allowed are trusted seeds, those mostly blocked distrust
seeds. Personalised PageRank carries trust along links between hosts and
distrust against them (a site that links to blocked sites is suspect). Links
are the absolute links of the pages; a host and its parent domains also
vouch for each other, while distrust stays with links. Pages without a rule are blocked if distrust makes up
``threshold`` of their host's trust and distrust.

Link tables are aggregated to one row for a pair of hosts before they are
shuffled; ranks are joined by host, and written to the shared folder every few
rounds. The number of rounds is fixed (``damping ** rounds`` is what is left).

Defined cases: a null url or one without ``://`` has an empty host and path, no
rule and is allowed; null html has no links; a host that no seed reaches is
allowed; without seeds everything without a rule is allowed; rules of equal
length: blocking wins; repeated rows and null ids are kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
DAMPING = 0.85
ROUNDS = 20
ROUNDS_A_TABLE = 5
THRESHOLD = 0.5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return (F.coalesce(_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit("")),
            F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last condition wrapped around is the first tried.
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, tie, weight): pages (host, html) of src that link to dst, and
    ties of each host with its parent domains, which carry trust only."""
    found = (pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), _lower))).alias("dst"))
        .where("src != '' and dst != '' and src != dst").groupBy("src", "dst")
        .agg(F.lit(False).alias("tie"), F.count("*").cast("double").alias("weight")))
    hosts = pages.select("host").where("host != ''").distinct().unionByName(found.select(F.col("dst").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    # a.b.c.d has the parents b.c.d and c.d
    parents = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(2), F.size(labels) - 1),
                                                    lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    ties = hosts.select("host", F.explode(parents).alias("parent"))
    both = (ties.select(F.col("host").alias("src"), F.col("parent").alias("dst"))
            .unionByName(ties.select(F.col("parent").alias("src"), F.col("host").alias("dst"))))
    return found.unionByName(both.select("src", "dst", F.lit(True).alias("tie"), F.lit(1.0).alias("weight")))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, kind, rank) for seeds (host, kind, seed), kind trust or distrust;
    the seeds of a kind sum to 1. Trust goes along links, distrust against them;
    a host without links in that direction passes nothing on."""
    ways = (links.select("src", "dst", F.lit("trust").alias("kind"), "weight")
            .unionByName(links.where("not tie").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("distrust").alias("kind"), "weight")))
    ways = ways.groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"))
    out = written(ways.groupBy("src", "kind").agg(F.sum("weight").alias("out")))
    shares = written(ways.join(out, ["src", "kind"]).select("src", "dst", "kind", (F.col("weight") / F.col("out")).alias("share")))
    start = seeds.select("host", "kind", (F.col("seed") * (1 - damping)).alias("rank"))
    ranks = seeds.select("host", "kind", F.col("seed").alias("rank"))
    for i in range(1, rounds + 1):
        moved = (shares.join(ranks.withColumnRenamed("host", "src"), ["src", "kind"])
                 .select(F.col("dst").alias("host"), "kind", (F.col("rank") * F.col("share") * damping).alias("rank")))
        ranks = moved.unionByName(start).groupBy("host", "kind").agg(F.sum("rank").alias("rank"))
        if i % ROUNDS_A_TABLE == 0:
            ranks = written(ranks)
    return ranks


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, spam_mass) of every page."""
    host, path = host_path(F.col(url_col))
    named = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    light = named.drop("html").withColumn("rule", rule).withColumn("by_rule", verdict)
    tally = light.where("host != ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked"))
    kind = F.when(F.col("allowed") * 2 > F.col("pages"), F.lit("trust")).when(F.col("blocked") * 2 > F.col("pages"), F.lit("distrust"))
    chosen = written(tally.select("host", kind.alias("kind")).where("kind is not null"))
    number = chosen.groupBy("kind").agg((1 / F.count("*")).alias("seed"))
    seeds = written(chosen.join(number, "kind").select("host", "kind", "seed"))
    ranks = propagate(written(host_links(named.select("host", "html"))), seeds, damping, rounds)
    trust = F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0))
    distrust = F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0))
    mass = written(ranks.groupBy("host").agg((distrust / (trust + distrust)).alias("spam_mass")))
    out = light.join(mass, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce(
        "by_rule", F.when(F.col("spam_mass") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("spam_mass", F.lit(0.0)).alias("spam_mass"))
