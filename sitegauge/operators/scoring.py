"""Site health and module risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge.functions.numbers import exact_mean, ratio, round_even
from sitegauge.functions.urls import module_of


def start_urls(features: DataFrame) -> DataFrame:
    """(site, start_url): one per site, the least of those its pages name."""
    named = features.select("site", "start_url").distinct()
    return named.groupBy("site").agg(F.min("start_url").alias("start_url"))


def page_totals(features: DataFrame) -> DataFrame:
    """Per site the page-level sums every score and benchmark needs."""
    measured = F.when(F.col("load_time") > 0, F.col("load_time"))
    return features.groupBy("site").agg(
        F.count("*").alias("pages"),
        F.count_if("has_title").alias("with_title"),
        F.count_if("has_meta_description").alias("with_meta"),
        F.count_if("has_viewport").alias("with_viewport"),
        F.coalesce(F.sum("img_total"), F.lit(0)).alias("images"),
        F.coalesce(F.sum("img_missing_alt"), F.lit(0)).alias("missing_alts"),
        F.count(measured).alias("measured_pages"),
        exact_mean(measured).alias("avg_load"),
        F.max("load_time").alias("max_load")).join(start_urls(features), "site")


def site_totals(features: DataFrame, broken: DataFrame, issues: DataFrame) -> DataFrame:
    """Page, broken-link and issue totals, one row per crawled site."""
    links = broken.groupBy("site").agg(F.count("*").alias("broken"))
    found = issues.groupBy("site").agg(
        F.count("*").alias("issues"), F.sum("is_critical").alias("high_issues"))
    return (page_totals(features)
            .join(links, "site", "left").join(found, "site", "left")
            .na.fill(0, ["broken", "issues", "high_issues"]))


def category_scores(totals: DataFrame) -> DataFrame:
    """Unrounded score per health category; performance may exceed 100."""
    share = lambda c: ratio(F.col(c), F.col("pages")) * 100
    floor = lambda score: F.greatest(F.lit(0.0), score)
    return totals.withColumns({
        "issues_score": floor(100.0 - ratio(F.col("high_issues"), F.col("pages")) * 50),
        "broken_score": floor(100.0 - ratio(F.col("broken"), F.col("pages")) * 200),
        "performance_score": floor(
            100.0 - (F.coalesce(F.col("avg_load"), F.lit(0.0)) - 1.0) * 15),
        "seo_score": share("with_title"),
        "accessibility_score": F.when(F.col("images") == 0, F.lit(100.0)).otherwise(
            floor((1 - ratio(F.col("missing_alts"), F.col("images"))) * 100)),
        "meta_score": share("with_meta"),
        "mobile_score": share("with_viewport"),
    })


SCORE_COLUMNS = ["issues_score", "broken_score", "performance_score", "seo_score",
                 "accessibility_score", "meta_score", "mobile_score"]


def _weighted() -> Column:
    terms = [F.col(c) * w for c, (_, w) in zip(SCORE_COLUMNS, K.HEALTH_WEIGHTS)]
    return reduce(lambda a, b: a + b, terms)


def grade_of(score: Column, color: bool = False) -> Column:
    pick = lambda row: F.lit(row[-1] if color else row[-2])
    ladder = reduce(lambda acc, g: acc.when(score >= g[0], pick(g)),
                    K.GRADES[1:], F.when(score >= K.GRADES[0][0], pick(K.GRADES[0])))
    return ladder.otherwise(pick(K.LOWEST_GRADE))


def health(totals: DataFrame) -> DataFrame:
    """Score, grade, color and breakdown per site."""
    score = round_even(F.least(F.lit(100.0), F.greatest(F.lit(0.0), _weighted())), 1)
    breakdown = F.create_map(*[x for c, (name, _) in zip(SCORE_COLUMNS, K.HEALTH_WEIGHTS)
                               for x in (F.lit(name), round_even(F.col(c), 1))])
    return (category_scores(totals)
            .withColumn("score", score)
            .withColumn("grade", grade_of(F.col("score")))
            .withColumn("color", grade_of(F.col("score"), color=True))
            .withColumn("breakdown", breakdown))


def health_of_sites(sites: DataFrame, scored: DataFrame) -> DataFrame:
    """Health of every listed site; a site without a crawled page gets 0 / F."""
    grade, color = K.EMPTY_GRADE
    return sites.select("site").join(
        scored.select("site", "score", "grade", "color", "breakdown"), "site", "left").select(
        "site", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("grade", F.lit(grade)).alias("grade"),
        F.coalesce("color", F.lit(color)).alias("color"),
        F.coalesce("breakdown", F.create_map().cast("map<string,double>")).alias("breakdown"))


def health_breakdown(scored: DataFrame) -> DataFrame:
    """One row per site and category, rounded to one decimal."""
    return scored.select("site", F.explode("breakdown").alias("category", "score"))


def module_page_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("site", "module").agg(F.count("*").alias("page_count"))


def module_broken_counts(broken: DataFrame) -> DataFrame:
    """Broken links per module of the broken URL."""
    return broken.groupBy("site", module_of("url").alias("module")).agg(
        F.count("*").alias("broken_count"))


def module_aggregates(issues: DataFrame, features: DataFrame, broken: DataFrame) -> DataFrame:
    """Raw risk per module that has issues."""
    stats = issues.groupBy("site", "module").agg(
        F.count("*").alias("issue_count"),
        F.sum("is_open").alias("open_issues"),
        F.sum("is_critical").alias("high_severity"),
        ratio(F.sum("severity_weight"), F.count("*")).alias("avg_weight"))
    joined = (stats.join(module_page_counts(features), ["site", "module"], "left")
              .join(module_broken_counts(broken), ["site", "module"], "left"))
    pages = F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1))
    rate = ratio(F.coalesce("broken_count", F.lit(0)), pages)
    return joined.withColumn("rate", rate).select(
        "site", "module", "issue_count", "open_issues", "high_severity",
        round_even(F.col("avg_weight"), 2).alias("avg_severity_weight"),
        round_even(F.col("rate"), 3).alias("broken_link_rate"),
        (F.col("issue_count") * 0.4 + F.col("avg_weight") * 10 * 0.35
         + F.col("rate") * 100 * 0.25).alias("raw_risk_score"),
        (F.col("issue_count") < K.SMALL_SAMPLE_BELOW).alias("small_sample"))


def normalise(modules: DataFrame) -> DataFrame:
    """Min-max risk score per site (50.0 when all are equal) and its level.

    Site extremes come from a grouped aggregate joined back, so a site's modules are
    not gathered into one window partition.
    """
    extremes = modules.groupBy("site").agg(
        F.min("raw_risk_score").alias("lowest"), F.max("raw_risk_score").alias("highest"))
    raw, low, high = F.col("raw_risk_score"), F.col("lowest"), F.col("highest")
    score = F.when(high > low, round_even(F.try_divide(raw - low, high - low) * 100, 1)).otherwise(
        F.lit(50.0))
    return (modules.join(extremes, "site")
            .withColumn("risk_score", score)
            .withColumn("risk_level", F.when(F.col("risk_score") >= 70, "High")
                        .when(F.col("risk_score") >= 40, "Medium").otherwise("Low"))
            .drop("lowest", "highest"))


def module_risk(issues: DataFrame, features: DataFrame, broken: DataFrame) -> DataFrame:
    """Risk table: one row per site and module with issues."""
    return normalise(module_aggregates(issues, features, broken))


def risk_order() -> list[Column]:
    """Highest risk first; ties by module name."""
    return [F.desc("risk_score"), F.asc("module")]
