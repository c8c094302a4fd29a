"""URL filter: rules first, and for the rest trust and distrust spread over the host graph.

Hosts are linked by the absolute links of their pages, weighted by the number of
linking pages, and each host and its registered domain (last two labels) link each
other. Trust is a personalised PageRank along the links, from hosts in proportion to
their pages that rules allow; distrust runs against the links, from hosts in
proportion to their pages that rules block: who links to a bad host is suspect. The
same two walks started from every host alike give what a host would have if all pages
were allowed, or blocked, so the quotients are shares from 0 to 1. A host is blocked
where its distrust share is above ``LEAST_DISTRUST`` and above its trust share.

DataFrame functions only. Every few steps the ranks, one row per host, are written as
a table; page rows are read twice and HTML once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.line_dedup import lower_ascii
from sitegauge.session import stage

#: (verdict, host, path): a rule fits its host and all subdomains below the path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
DAMPING = 0.85
STEPS, STEPS_PER_TABLE = 12, 3
LEAST_DISTRUST = 0.5

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINKS = r"(?i)<a\s[^<>]*?href\s*=\s*[\x22\x27]?\s*(?:https?:)?//([^/?#\x22\x27\s<>]+)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text and as verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, says).otherwise(verdict)
    return text, verdict


def _domain(host: Column) -> Column:
    """Last two labels; '' for an address in numbers or a single label."""
    return F.when(host.rlike(r"^[0-9.:]*$"), "").otherwise(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts, from columns host and targets."""
    links = (pages.select(F.col("host").alias("src"), F.explode("targets").alias("dst"))
             .groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    hosts = links.select("src").union(links.select("dst")).union(pages.select("host")).distinct().toDF("host")
    up = hosts.select(F.col("host").alias("src"), _domain(F.col("host")).alias("dst"))
    family = up.union(up.select("dst", "src")).withColumn("weight", F.lit(1.0))
    return (links.union(family).where("src <> dst and src <> '' and dst <> ''")
            .groupBy("src", "dst").agg(F.sum("weight").alias("weight")))


def host_shares(pages: DataFrame) -> DataFrame:
    """Columns host, trust and distrust (0 to 1), from pages with host, targets and rule verdict."""
    edges = host_edges(pages)
    given = edges.groupBy("src").agg(F.sum("weight").alias("given"))
    got = edges.groupBy("dst").agg(F.sum("weight").alias("got"))
    edges = stage(edges.join(given, "src").join(got, "dst").select(
        "src", "dst", (F.col("weight") / F.col("given")).alias("ahead"),
        (F.col("weight") / F.col("got")).alias("back")), "host-edges")
    judged = pages.where("host <> ''").groupBy("host").agg(*[
        F.avg((F.coalesce("says", F.lit("")) == v).cast("double")).alias(c)
        for v, c in (("allow", "allowed"), ("block", "blocked"))])
    hosts = edges.select("src").union(edges.select("dst")).distinct().toDF("host")
    starts = stage(judged.join(hosts, "host", "full").select(
        "host", F.coalesce("allowed", F.lit(0.0)).alias("allowed"),
        F.coalesce("blocked", F.lit(0.0)).alias("blocked")), "host-starts")
    walks = {"t": ("allowed", "ahead"), "t1": (None, "ahead"), "d": ("blocked", "back"), "d1": (None, "back")}
    start = {w: F.col(s) if s else F.lit(1.0) for w, (s, _) in walks.items()}
    ranks = starts.select("host", *[start[w].alias(w) for w in walks])
    for step in range(1, STEPS + 1):
        ahead = edges.join(ranks.select(F.col("host").alias("src"), "t", "t1"), "src").groupBy(
            F.col("dst").alias("host")).agg(*[F.sum(F.col(w) * F.col("ahead")).alias(f"{w}_in") for w in ("t", "t1")])
        back = edges.join(ranks.select(F.col("host").alias("dst"), "d", "d1"), "dst").groupBy(
            F.col("src").alias("host")).agg(*[F.sum(F.col(w) * F.col("back")).alias(f"{w}_in") for w in ("d", "d1")])
        ranks = starts.join(ahead, "host", "left").join(back, "host", "left").select("host", *[
            ((1 - DAMPING) * start[w] + DAMPING * F.coalesce(f"{w}_in", F.lit(0.0))).alias(w) for w in walks])
        if step % STEPS_PER_TABLE == 0:
            ranks = stage(ranks, "host-ranks")
    # beyond so many digits the order of the sums would show
    return ranks.select("host", F.round(F.col("t") / F.col("t1"), 9).alias("trust"),
                        F.round(F.col("d") / F.col("d1"), 9).alias("distrust"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule and verdict, and the host's trust and distrust.

    Input columns ``page_id``, ``url`` and ``html``; others are ignored. A null url, or
    one without ``://``, has an empty host and path and fits no rule; the method knows
    nothing of it and allows it. A null html has no links. Repeated rows are judged
    each. An empty table gives an empty result. ``rules`` is a short list, written into
    the plan.
    """
    url = F.col("url").cast("string")
    text, says = rule_for(F.col("host"), F.col("path"), rules)
    narrow = stage(pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
        F.array_distinct(F.transform(F.regexp_extract_all(
            F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(_LINKS), F.lit(1)), lower_ascii)).alias("targets"))
        .select("*", text.alias("rule"), says.alias("says")), "judged-pages")
    method = F.when((F.col("distrust") > LEAST_DISTRUST) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return narrow.join(host_shares(narrow), "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "trust", "distrust")
