"""URL filters: given rules, and trust and distrust that spread over a graph of hosts.

Rules decide first: the longest that fits the host and the path. Pages that no rule
fits are judged by their host. Hosts of pages that rules allow are trusted seeds, hosts of
pages that rules block are blocked seeds, each by the number of such pages. Trust spreads
along links as personalised PageRank from the trusted seeds; distrust spreads against
the links from the blocked ones. A host is blocked if distrust has more than
`threshold` of what it got of both. A host that neither reaches is allowed.

Links to other hosts are edges. A link within the site says which navigation it has;
sites that share such a target are joined through it, there and back (the target is
a node of its own, so no pairs of hosts are made).

Null urls and urls without ``://`` have an empty host and path; no rule fits them, and the
empty host has no edges, so they are allowed. Null html has no links. Rows that repeat
stay, and count as seeds each. Other columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import dropped, written

DAMPING = 0.85
#: Iterations at most, after which 0.85^48, less than a thousandth of the rank, is unsettled.
ITERATIONS = 48
#: What may change in all ranks of a kind, which sum to one at most, between two cuts of the lineage for them to count as settled.
TOLERANCE = 0.01
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Iterations after which the lineage is cut.
CUT = 4

Rule = tuple[str, str]  # verdict; host and path, as in net/ or example.org/es/


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty for null and without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Of rules of one length the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def links_of(html: Column) -> Column:
    """The targets of all links of a page."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"'<>\s]+)["']"""), F.lit(1))


def edges(pages: DataFrame) -> DataFrame:
    """(a, b, w): links from node to node (hosts, and targets within sites as ``/target``), with their number, of pages (host, links)."""
    links = pages.where("host != ''").select("host", F.explode("links").alias("link"))
    links = links.groupBy("host", "link").agg(F.count(F.lit(1)).alias("w"))
    far, _ = parsed(F.col("link"))
    links = links.withColumn("far", F.when(F.col("link").startswith("//"), F.translate(F.regexp_extract("link", r"^//([^/?#]*)", 1), UPPER, LOWER)).otherwise(far))
    other = links.where("far != '' and far != host").select(F.col("host").alias("a"), F.col("far").alias("b"), "w")
    near = links.where("far = '' and link like '/%'")
    there, back = near.select(F.col("host").alias("a"), F.col("link").alias("b"), "w"), near.select(F.col("link").alias("a"), F.col("host").alias("b"), "w")
    return other.unionByName(there).unionByName(back).groupBy("a", "b").agg(F.sum("w").alias("w"))


def spread(links: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, node, x): personalised PageRank along the links for kind ``trust``, against them for ``distrust``.

    It ends after ``iterations``, or earlier where no kind changes by more than ``tolerance`` in CUT of them.

    seeds (kind, node, x) sums to one for each kind.
    """
    both = links.select(F.lit("trust").alias("kind"), F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("b").alias("u"), F.col("a").alias("v"), "w"))
    out = both.groupBy("kind", "u").agg(F.sum("w").alias("all"))
    steps = written(both.join(out, ["kind", "u"]).select("kind", "u", "v", (F.lit(damping) * F.col("w") / F.col("all")).alias("p")), "steps")
    rest = seeds.select("kind", "node", (F.col("x") * (1 - damping)).alias("x"))
    now, old = seeds, None
    for k in range(1, iterations + 1):
        moved = now.select("kind", F.col("node").alias("u"), "x").join(steps, ["kind", "u"]).select("kind", F.col("v").alias("node"), (F.col("x") * F.col("p")).alias("x"))
        now = moved.unionByName(rest).groupBy("kind", "node").agg(F.sum("x").alias("x"))
        if k % CUT == 0:
            now = written(now, "ranks")
            if old is not None:
                change = now.join(old.withColumnRenamed("x", "was"), ["kind", "node"], "full").groupBy("kind").agg(F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("change"))
                settled = change.where(F.col("change") > tolerance).isEmpty()
                dropped(old)
                if settled:
                    return now
            old = now
    return now


def judged(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, iterations: int = ITERATIONS) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, for every row of ``pages`` (page_id, url, html)."""
    host, path = parsed(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), links_of(F.col("html").cast("string")).alias("links"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # pages are parsed once
    rows = written(rows.withColumn("rule", rule).withColumn("said", verdict), "pages")
    by_host = rows.groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad"))
    by_host = written(by_host, "hosts")
    g, b = by_host.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    seeds = by_host.where("good > 0").select(F.lit("trust").alias("kind"), F.col("host").alias("node"), (F.col("good") / max(g, 1)).alias("x"))
    seeds = seeds.unionByName(by_host.where("bad > 0").select(F.lit("distrust").alias("kind"), F.col("host").alias("node"), (F.col("bad") / max(b, 1)).alias("x")))
    ranks = spread(edges(rows), seeds, iterations)
    got = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("x"))), F.lit(0.0)).alias(kind)
    hosts = ranks.where("node not like '/%'").groupBy(F.col("node").alias("host")).agg(got("trust"), got("distrust"))
    out = rows.drop("links").join(hosts, "host", "left").fillna(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "trust", "distrust")
