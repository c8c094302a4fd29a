"""Robots rules as a join: the first of the host's rules whose prefix fits decides.

A URL is looked up under its prefixes of those lengths that its host's rules have, each
by hash with its host, so what a URL costs does not grow with the number of rules: a
file of n characters has at most sqrt(2n) different lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge.functions import urls as U


def host_rules(rules: DataFrame, agent: str = K.AGENT_TOKEN) -> DataFrame:
    """(host, prefix, place): the rules of each host's group for ``agent``, else of '*'.

    A host's rules come from one robots file, which bounds them: one shuffle by host does.
    Of several named groups only the first one applies, and of rules with the same
    prefix the first one. A prefix '*' fits every URL, as an empty one does, which (a
    bare "Disallow:") allows everything. A rule without a prefix fits none.
    """
    named = F.when(rules["agent"] == "*", F.lit(1)).when(
        F.contains(F.lit(agent), F.lower("agent")), F.lit(0))
    ranked = rules.select("host", "rule_order", "allow", "prefix", F.lower("agent").alias("agent"),
                          named.alias("grp")).where(F.col("grp").isNotNull())
    order = F.struct("grp", "rule_order", "allow", "prefix", "agent")
    first = F.min(order).over(Window.partitionBy("host"))
    is_open = F.coalesce((F.col("prefix") == "") | F.col("allow"), F.lit(True))
    return (ranked.withColumn("first", first)
            .where("grp = first.grp and agent = first.agent and prefix is not null")
            .withColumn("place", F.struct("rule_order", "allow", "prefix", is_open.alias("open")))
            .groupBy("host", F.when(F.col("prefix") != "*", F.col("prefix")).otherwise("").alias("prefix"))
            .agg(F.min("place").alias("place")))


def verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, open) of the distinct ``url`` that some rule of their host fits."""
    of_host = host_rules(rules)
    lengths = of_host.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    asked = urls.select("url").distinct().select(
        "url", U.host(F.col("url")).alias("host"), U.request_target(F.col("url")).alias("target"))
    probes = asked.join(lengths, "host").select("url", "host", F.explode(F.expr(
        "transform(filter(lengths, n -> n <= length(target)), n -> left(target, n))")).alias("prefix"))
    return (probes.join(of_host, ["host", "prefix"]).groupBy("url").agg(F.min("place").alias("place"))
            .select("url", "place.open"))


def _respected(respect_robots: bool | Column) -> Column:
    return respect_robots if isinstance(respect_robots, Column) else F.lit(respect_robots)


def with_robots(urls: DataFrame, rules: DataFrame, url: str = "url",
                respect_robots: bool | Column = True) -> DataFrame:
    """Add boolean ``allowed``; every URL is allowed where robots are not respected.

    Rows are shuffled to meet their verdicts where these are many: bring narrow ones.
    """
    if respect_robots is False:
        return urls.withColumn("allowed", F.lit(True))
    found = verdicts(urls.select(F.col(url).alias("url")), rules).select(
        F.col("url").alias("_asked"), F.col("open").alias("_open"))
    allowed = F.coalesce(~_respected(respect_robots) | F.col("_open"), F.lit(True))
    return (urls.join(found, F.col(url) == F.col("_asked"), "left")
            .withColumn("allowed", allowed).drop("_asked", "_open"))


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url",
                   respect_robots: bool | Column = True) -> DataFrame:
    """URLs that may be fetched."""
    if respect_robots is False:
        return urls
    closed = verdicts(urls.select(F.col(url).alias("url")), rules).where("not open").select(F.col("url").alias("_asked"))
    return urls.join(closed, _respected(respect_robots) & (F.col(url) == F.col("_asked")), "left_anti")


def allowed_pages(pages: DataFrame, rules: DataFrame, respect_robots: bool | Column = True) -> DataFrame:
    """Pages of a crawl that may be fetched; none of a site whose start URL is blocked."""
    open_sites = robots_allowed(pages, rules, "start_url", respect_robots)
    return robots_allowed(open_sites, rules, "url", respect_robots)


def allowed_by_run(pages: DataFrame, rules: DataFrame, runs: DataFrame) -> DataFrame:
    """``allowed_pages`` where each site's run tells whether it respected robots rules; a silent run did."""
    told = runs.select("site", F.col("respect_robots").alias("_respect")).where("not _respect").distinct()
    respected = F.coalesce(F.col("_respect"), F.lit(True))
    return allowed_pages(pages.join(told, "site", "left"), rules, respected).drop("_respect")
