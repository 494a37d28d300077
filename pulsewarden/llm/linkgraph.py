"""URL filters: listed rules, then trust and distrust carried along links between hosts.

Rules name a host (with its subdomains) and the start of a path; the longest that fits
decides. For the other pages the hosts' links decide. Trust starts at hosts with allowed
pages and flows along links (personalised PageRank); distrust starts at hosts with blocked
pages and flows against them: who links to a blocked host gains some of its distrust.
Both are fixed points of ``x = (1 - a) * seed + a * spread(x)``, reached by iterating until no
host moves by ``TOLERANCE`` in four rounds (a round shrinks what is missing by a at least); each
round is one join and one sum over the table of distinct host links. A host is blocked if its
distrust reaches a threshold and exceeds its trust.

Links are counted per pair of hosts where the pages lie, so a host with a third of all
pages adds one row for each host that it links to.

Defined results
    null url, or none with ``://``: host and path empty, no rule, verdict allow.
    null html: a page without links. Links without a host, and to the own host, don't count.
    Empty table: empty result. Repeated pages are judged alike; their links count again.
    Other columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulsewarden.session import drop, materialize, sized

#: Host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""

DAMPING = 0.85
TOLERANCE = 1e-7
THRESHOLD = 0.1


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of its name and verdict; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, share: how much of a host's links to others lead to each. ``pages``: host, html."""
    links = (
        pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
        .withColumn("dst", _lower(F.col("dst")))
        .filter("src <> dst AND src <> ''")
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    return links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """trust and distrust of every host in ``seeds`` (host, trust, distrust) or ``links``."""
    along = links.select(F.col("src").alias("host"), F.col("dst").alias("to"),
                         F.col("share").alias("t"), F.lit(0.0).alias("d"))
    against = links.select(F.col("dst").alias("host"), F.col("src").alias("to"),
                           F.lit(0.0).alias("t"), F.col("share").alias("d"))
    steps = materialize(along.unionByName(against))
    base = materialize(
        seeds.unionByName(steps.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust")))
        .groupBy("host").agg(*[(F.max(c) * (1 - damping)).alias(c) for c in ("trust", "distrust")])
    )
    if steps.isEmpty():
        return base
    state = base
    while True:
        before = state
        for _ in range(4):  # a plan that grows with each round costs more than a table
            moved = (
                steps.join(state, "host")
                .select(F.col("to").alias("host"), (F.col("t") * F.col("trust") * damping).alias("trust"),
                        (F.col("d") * F.col("distrust") * damping).alias("distrust"))
            )
            state = base.unionByName(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        state = materialize(state)
        apart = state.unionByName(before.select("host", *[(-F.col(c)).alias(c) for c in ("trust", "distrust")]))
        apart = apart.groupBy("host").agg(*[F.abs(F.sum(c)).alias(c) for c in ("trust", "distrust")])
        moved_by = apart.agg(F.max(F.greatest("trust", "distrust"))).first()[0]
        if before is not base:
            drop(before)
        if moved_by <= tolerance:
            return state


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING,
                tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` (url, html, …) with host, path, rule, verdict, and the host's trust and distrust."""
    results = ("host", "path", "rule", "verdict", "trust", "distrust")
    pages = pages.drop(*results)
    rows = (
        pages.withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
        .withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    )
    share = lambda v: F.avg(F.coalesce(F.col("_rule.verdict") == v, F.lit(False)).cast("double"))
    seeds = rows.filter("host <> ''").groupBy("host").agg(
        share("allow").alias("trust"), share("block").alias("distrust"))
    hosts = propagate(seeds, host_links(rows.select("host", "html")), damping, tolerance)
    known = sized(hosts.select(F.col("host").alias("_host"), "trust", "distrust"))
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return (
        rows.join(known, rows["host"] == known["_host"], "left")
        .withColumn("rule", F.col("_rule.rule"))
        .withColumn("verdict", F.coalesce(F.col("_rule.verdict"), F.when(bad, "block").otherwise("allow")))
        .withColumn("trust", F.coalesce("trust", F.lit(0.0)))
        .withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
        .drop("_rule", "_host")
    )
