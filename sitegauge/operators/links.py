"""Link edges, domain tests, external links and broken links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge.functions import urls as U
from sitegauge.functions.skew import number_in_order, top_per_group


def links(features: DataFrame) -> DataFrame:
    """One row per http(s) link of the staged feature table."""
    edges = features.select(
        "site", F.col("url").alias("src_url"), F.posexplode_outer("links").alias("pos", "link")
    ).where(F.col("pos").isNotNull())
    return edges.select(
        "site", "src_url", "pos", "link.dst_url",
        U.clean_url(F.col("link.dst_url")).alias("dst_clean"), "link.is_internal")


def external_links(link_edges: DataFrame) -> DataFrame:
    """Distinct off-domain clean URLs per site."""
    return link_edges.where(~F.col("is_internal")).select("site", "dst_clean").distinct()


def external_link_counts(external: DataFrame, max_checks: int | None = None) -> DataFrame:
    """Per site: all external links and how many of them get checked."""
    total = F.count("*")
    return external.groupBy("site").agg(
        total.alias("total_external_links"),
        (total if max_checks is None else F.least(total, F.lit(max_checks))).alias("external_links_checked"))


def unchecked_external_links(external: DataFrame, link_status: DataFrame) -> DataFrame:
    """External links for which there is no check result."""
    return external.join(link_status.select(F.col("url").alias("dst_clean")), "dst_clean", "left_anti").select(
        "site", "dst_clean")


def broken_external_links(external: DataFrame, link_status: DataFrame,
                          max_checks: int | None = None) -> DataFrame:
    """Broken external URLs of every site, numbered by URL in ``pos``.

    ``max_checks`` limits the check to a site's first URLs, as a live check would. Of
    several results for one URL the greatest status counts; a URL without a result is
    not broken, see ``unchecked_external_links``.
    """
    checked = external if max_checks is None else top_per_group(
        external, ["site"], [F.col("dst_clean")], max_checks).drop("rank")
    status = link_status.groupBy("url").agg(F.max("status").alias("status"))
    broken = (checked.join(status, checked["dst_clean"] == status["url"])
              .where(F.col("status").isin(K.BROKEN_EXTERNAL_CODES)).select("site", "url", "status"))
    return number_in_order(broken, ["site"], ["url"], "pos").select(
        "site", "url", "status", F.lit("external").alias("origin"), "pos")


def broken_internal_pages(features: DataFrame) -> DataFrame:
    """Crawled pages that failed or answered with an error status."""
    failed = (F.coalesce(F.col("status_code").isin(K.BROKEN_INTERNAL_CODES), F.lit(False))
              | (F.coalesce(F.col("error"), F.lit("")) != ""))
    return features.where(failed).select(
        "site", "url", F.coalesce(F.col("status_code"), F.lit(0)).alias("status"),
        F.lit("internal").alias("origin"), F.col("ord").alias("pos"))


def broken_links(features: DataFrame, external: DataFrame, link_status: DataFrame,
                 max_checks: int | None = None) -> DataFrame:
    """External then internal broken links; ``pos`` orders rows inside an origin."""
    return broken_external_links(external, link_status, max_checks).unionByName(
        broken_internal_pages(features))
