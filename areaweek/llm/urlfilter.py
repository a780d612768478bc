"""URL verdicts from rules and, where no rule fits, from propagation over the host graph.

Only DataFrame functions. A host is a trusted seed when more than half of its pages are
allowed by rules, a blocked seed when more than half are blocked. Trust is personalised
PageRank from the trusted seeds along host edges; distrust is the same from the blocked
seeds along reversed edges. A host is blocked when it holds more distrust than trust, and
at least ``LEAST`` of what a blocked seed restarts with; else it is allowed.

Host edges are the links in the html that name a host, counted, and, as one link each way,
the tie between a host and the nearest host above it (``a.b.c`` and ``b.c``). Links of
a host to itself do not count. Mass is kept in whole units, so sums do not depend on
their order and reruns agree.

Pages are reduced to distinct hosts and path heads before rules and verdicts are joined,
links to counted host pairs in the map tasks, so a hot host is one row in each
task. Every ``PER_WRITE`` rounds the masses are written, which cuts the lineage.

Null urls and those without ``://`` have an empty host and path, fit no rule and are
allowed; they send no links. Null html has no links. Repeated pages are judged, and
counted, each. Other columns of the pages, whatever their names, are not read. No pages
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweek.llm.common import stored

#: Fixed values: (verdict, host, path) of the rules that the query applies.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, ROUNDS, PER_WRITE = 0.85, 20, 5
#: Mass that a seed restarts with, in units, and the share of it that distrust must reach.
SEED, LEAST = 1_000_000_000, 0.01
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def ruled(heads: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, head, rule, verdict) of the longest rule for each of ``heads`` (host, head) that has one.

    ``rules`` holds verdict, host and path. Equal lengths go to the longer host, then to
    the smaller text. Only the lengths of paths that a rule's host has are tried.
    """
    own = rules.select(F.col("host").alias("at"), "path", F.concat("host", "path").alias("rule"), "verdict")
    tried = heads.select("host", "head", F.explode(_suffixes(F.col("host"))).alias("at"))
    lengths = own.select("at", F.length("path").alias("n")).distinct()
    keys = tried.join(lengths, "at").where(F.length("head") >= F.col("n")).withColumn("path", F.expr("left(head, n)"))
    rank = F.struct(-F.length("rule"), -F.length("at"), "rule", "verdict").alias("rank")
    best = keys.join(own, ["at", "path"]).groupBy("host", "head").agg(F.min(rank).alias("best"))
    return best.select("host", "head", "best.rule", "best.verdict")


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    named = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(_LINK), 1)).alias("to"))
    pairs = named.select("src", F.translate("to", _UPPER, _LOWER).alias("dst")).where("src != '' and src != dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def family_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, n): each of ``hosts`` (host) and the nearest host above it that is among them, both ways."""
    above = hosts.where("host != ''").select("host", F.posexplode(_suffixes(F.col("host"))).alias("up", "above")).where("up > 0")
    near = above.join(hosts.select(F.col("host").alias("above")), "above").groupBy("host").agg(F.min_by("above", "up").alias("above"))
    both = F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("above").alias("dst")), F.struct(F.col("above").alias("src"), F.col("host").alias("dst"))))
    return near.select(both.alias("e")).select("e.src", "e.dst", F.lit(1).cast("long").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) in units, for every host that holds any.

    ``links`` (src, dst, n) are directed; ``seeds`` (host, kind) has kind ``trust`` or
    ``distrust``. A host passes its mass on in proportion to its links; distrust goes
    from a link's target to its source.
    """
    sums = links.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    there = sums.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    back = sums.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    edges = there.unionByName(back)
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = stored(edges.join(out, ["kind", "src"]).select(F.col("kind").alias("of"), "src", "dst", (F.lit(damping) * (F.col("n") / F.col("all"))).alias("share")), "host-edges")
    start = stored(seeds.select("kind", "host", F.lit(SEED).cast("long").alias("seed")).distinct(), "host-seeds")
    # What a seed restarts with each round; whole units, rounded down once.
    again = start.select("kind", "host", F.floor(F.lit(1.0 - damping) * F.col("seed")).alias("mass"))
    mass = start.select("kind", "host", F.col("seed").alias("mass"))
    for done in range(1, rounds + 1):
        moved = mass.join(edges, F.expr("kind = of and host = src")).select("kind", F.col("dst").alias("host"), F.floor(F.col("mass") * F.col("share")).alias("mass"))
        mass = moved.unionByName(again).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if done % PER_WRITE == 0 or done == rounds:
            mass = stored(mass, "host-mass")
    held = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0))
    return mass.groupBy("host").agg(held("trust").alias("trust"), held("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", family: bool = True) -> DataFrame:
    """Each page: ``key``, host, path, rule, verdict, and the host's trust and distrust in units."""
    longest = rules.agg(F.coalesce(F.max(F.length("path")), F.lit(0))).first()[0]
    at = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("head", F.left("path", F.lit(longest)))
    heads = stored(at.groupBy("host", "head").agg(F.count(F.lit(1)).alias("pages")), "heads")
    decided = stored(ruled(heads, rules), "ruled")
    by_host = heads.join(decided, ["host", "head"], "left").where("host != ''").groupBy("host").agg(
        F.sum("pages").alias("pages"), *[F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("pages"))), F.lit(0)).alias(v) for v in ("allow", "block")]
    )
    hosts = stored(by_host, "hosts")
    kind = F.when(2 * F.col("allow") > F.col("pages"), "trust").when(2 * F.col("block") > F.col("pages"), "distrust")
    links = host_links(pages, url, html)
    links = links.unionByName(family_links(hosts.select("host"))) if family else links
    spread = propagate(links, hosts.select("host", kind.alias("kind")).where("kind is not null"))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= F.lit(LEAST * (1 - DAMPING) * SEED))
    by_method = spread.select("host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("by_host"))
    known = heads.select("host", "head").join(decided, ["host", "head"], "left").join(by_method, "host", "left")
    answer = known.select(
        "host", "head", "rule", F.coalesce("verdict", "by_host", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"),
    )
    return at.join(answer, ["host", "head"]).select(F.col("key").alias(key), "host", "path", "rule", "verdict", "trust", "distrust")
