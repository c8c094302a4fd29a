"""Report tables: the data behind every screen of the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge.functions.numbers import exact_mean, fixed, ratio, round_even
from sitegauge.functions.skew import top_per_group
from sitegauge.functions.urls import base_domain, seed_url
from sitegauge.operators.robots import with_robots
from sitegauge.operators.scoring import module_page_counts, start_urls

SEVERITIES = ["Low", "Medium", "High"]


def count_by(issues: DataFrame, column: str) -> DataFrame:
    """Issue count per site and value of ``column``."""
    return issues.groupBy("site", column).agg(F.count("*").alias("count"))


def severity_share(issues: DataFrame) -> DataFrame:
    """Issue count and share of the site's issues per severity."""
    counts = count_by(issues, "severity")
    totals = counts.groupBy("site").agg(F.sum("count").alias("total"))
    return counts.join(totals, "site").select(
        "site", "severity", "count", ratio(F.col("count"), F.col("total")).alias("share"))


def top_issue_types(issues: DataFrame, n: int = 12) -> DataFrame:
    return top_per_group(count_by(issues, "issue_type"), ["site"],
                         [F.desc("count"), F.asc("issue_type")], n)


def module_severity_pivot(issues: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return issues.groupBy("site", "module").agg(*counts)


def worst_pages(issues: DataFrame, n: int = 10) -> DataFrame:
    """Pages credited with the most issues."""
    pages = issues.groupBy("site", "page_url").agg(
        F.count("*").alias("total_issues"), F.sum("is_critical").alias("high_severity"),
        F.sum("is_open").alias("open_issues"))
    return top_per_group(pages, ["site"], [F.desc("total_issues"), F.asc("page_url")], n)


def load_summary(features: DataFrame) -> DataFrame:
    """Site mean and number of pages over 3 s, over all measured pages."""
    measured = features.where(F.col("load_time") > 0)
    return measured.groupBy("site").agg(
        F.count("*").alias("measured_pages"), exact_mean(F.col("load_time")).alias("avg_load"),
        F.count_if(F.col("load_time") > 3).alias("slow_pages"))


def slowest_pages(features: DataFrame, n: int = 25) -> DataFrame:
    load = F.col("load_time")
    band = F.when(load > 3, "red").when(load > 1.5, "orange").otherwise("green")
    pages = features.where(load > 0).select("site", "url", "module", "load_time")
    return (top_per_group(pages, ["site"], [F.desc("load_time"), F.asc("url")], n)
            .withColumn("band", band)
            .withColumn("page", F.concat(F.lit("…"), F.right("url", F.lit(45)))))


def short_url(url: Column) -> Column:
    """Last 32 characters after an ellipsis, only when the URL is longer."""
    return F.when(F.length(url) > 32, F.concat(F.lit("…"), F.right(url, F.lit(32)))).otherwise(url)


def module_examples(features: DataFrame, n: int = 2) -> DataFrame:
    """First pages of every module and how many more there are."""
    pages = features.select("site", "module", "ord", "url", "status_code")
    firsts = top_per_group(pages, ["site", "module"], [F.col("ord")], n)
    return firsts.join(module_page_counts(features), ["site", "module"]).select(
        "site", "module", "rank", "status_code", short_url(F.col("url")).alias("short_url"),
        F.greatest(F.col("page_count") - n, F.lit(0)).alias("more_pages"))


def top_types_per_module(issues: DataFrame, n: int = 3) -> DataFrame:
    """Most frequent issue types of a module, as one comma-separated text."""
    counts = issues.groupBy("site", "module", "issue_type").agg(F.count("*").alias("count"))
    top = top_per_group(counts, ["site", "module"], [F.desc("count"), F.asc("issue_type")], n)
    return top.groupBy("site", "module").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "issue_type"))),
        lambda x: x["issue_type"]), ", ").alias("top_types"))


def module_cards(features: DataFrame, issues: DataFrame) -> DataFrame:
    """Crawled modules with page, load and issue statistics and a badge."""
    measured = F.when(F.col("load_time") > 0, F.col("load_time"))
    pages = features.groupBy("site", "module").agg(
        F.count("*").alias("page_count"), F.coalesce(exact_mean(measured), F.lit(0.0)).alias("avg_load"))
    stats = issues.groupBy("site", "module").agg(
        F.count("*").alias("total_issues"), F.sum("is_critical").alias("high_issues"),
        F.sum("is_open").alias("open_issues"))
    keys = ["site", "module"]
    cards = (pages.join(stats, keys, "left").join(top_types_per_module(issues), keys, "left")
             .na.fill(0, ["total_issues", "high_issues", "open_issues"]).na.fill("", ["top_types"]))
    badge = (F.when(F.col("high_issues") > 0, F.concat(F.col("high_issues").cast("string"), F.lit(" HIGH")))
             .when(F.col("total_issues") > 0, F.concat(F.col("total_issues").cast("string"), F.lit(" issues")))
             .otherwise(F.lit("✓ clean")))
    return cards.withColumn("badge", badge)


def modules_of(features: DataFrame) -> DataFrame:
    """Distinct modules of every site."""
    return features.select("site", "module").distinct()


def choices(issues: DataFrame) -> DataFrame:
    """Distinct modules and issue types that scoring inputs can take."""
    pair = F.explode(F.array(
        F.struct(F.lit("module").alias("field"), F.col("module").alias("value")),
        F.struct(F.lit("issue_type").alias("field"), F.col("issue_type").alias("value"))))
    return issues.select("site", pair.alias("p")).select("site", "p.*").distinct()


def crawl_header(features: DataFrame, external_counts: DataFrame, broken: DataFrame,
                 runs: DataFrame | None = None) -> DataFrame:
    """One row per site: base domain, page, module, external and broken totals, and what its run tells.

    ``crawl_time`` (seconds, two digits) and ``respect_robots`` are null where no run tells
    them. A site has one run; of several the longest counts.
    """
    pages = module_page_counts(features).groupBy("site").agg(
        F.sum("page_count").alias("total_pages"), F.count("*").alias("modules"))
    urls = start_urls(features)
    links = broken.groupBy("site").agg(F.count("*").alias("broken_links"))
    header = (pages.join(urls, "site").join(external_counts, "site", "left")
              .join(links, "site", "left")
              .na.fill(0, ["total_external_links", "external_links_checked", "broken_links"])
              .withColumn("base_domain", base_domain(F.col("start_url"))))
    if runs is None:
        return header.withColumns({"crawl_time": F.lit(None).cast("double"), "respect_robots": F.lit(None).cast("boolean")})
    told = runs.groupBy("site").agg(
        round_even(F.max("crawl_seconds"), 2).alias("crawl_time"), F.max("respect_robots").alias("respect_robots"))
    return header.join(told, "site", "left")


def crawl_results(runs: DataFrame, header: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per run: its URL, the totals of its crawl, or the error that kept it from one.

    ``error`` is the reason an invalid start URL is refused for, or that robots rules
    block it, with a ``message``; both are null for a crawl, and its totals are 0 where no
    page came of it. A run that does not tell whether it respects robots rules does.
    """
    seed = seed_url(F.coalesce("start_url", F.lit("")))
    asked = runs.select("site", seed.alias("seed"), "respect_robots",
                        round_even(F.col("crawl_seconds"), 2).alias("crawl_time")).select(
        "site", "seed.url", "seed.is_valid", F.col("seed.error").alias("refused"), "respect_robots", "crawl_time")
    checked = with_robots(asked, rules, "url", F.coalesce("respect_robots", F.lit(True)))
    counts = ["total_pages", "modules", "broken_links", "external_links_checked", "total_external_links"]
    crawled = F.col("is_valid") & F.col("allowed")
    error = F.when(~F.col("is_valid"), F.col("refused")).when(~F.col("allowed"), F.lit(K.BLOCKED_ERROR))
    message = F.when(F.col("is_valid") & ~F.col("allowed"), F.lit(K.BLOCKED_MESSAGE))
    return checked.join(header.select("site", *counts), "site", "left").select(
        "site", "url", F.when(crawled, base_domain(F.col("url"))).alias("base_domain"),
        *[F.when(crawled, F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counts],
        F.when(crawled, F.col("crawl_time")).alias("crawl_time"),
        error.alias("error"), message.alias("message"))


def _duration() -> Column:
    return F.coalesce(F.concat(F.col("crawl_time").cast("string"), F.lit("s")), F.lit(K.NOT_KNOWN))


def kpi_strip(header: DataFrame, issues: DataFrame) -> DataFrame:
    """Headline counts per site."""
    status = lambda s: F.count_if(F.col("status") == s)
    severity = lambda s: F.count_if(F.col("severity") == s)
    counts = issues.groupBy("site").agg(
        F.count("*").alias("issues"), severity("High").alias("high"), severity("Medium").alias("medium"),
        severity("Low").alias("low"), F.sum("is_open").alias("open"), status("Fixed").alias("fixed"),
        status("Reopened").alias("reopened"))
    columns = [c for c in counts.columns if c != "site"]
    return header.select("site", "total_pages", "modules", "broken_links", _duration().alias("crawl_time")).join(
        counts, "site", "left").na.fill(0, columns)


def crawl_summary(header: DataFrame, issues: DataFrame) -> DataFrame:
    """Metric / value / meaning rows per site; what the run did not tell is "n/a"."""
    totals = header.join(issues.groupBy("site").agg(F.count("*").alias("issues")), "site", "left").na.fill(0, ["issues"])
    respected = F.when(F.col("respect_robots"), "Yes").when(~F.col("respect_robots"), "No").otherwise(K.NOT_KNOWN)
    values = [F.col("start_url"), F.col("total_pages"), F.col("modules"), F.col("issues"),
              F.col("broken_links"), F.col("external_links_checked"), _duration(), respected]
    rows = F.array(*[
        F.struct(F.lit(metric).alias("metric"), value.cast("string").alias("value"),
                 F.lit(meaning).alias("meaning"))
        for (metric, meaning), value in zip(K.SUMMARY_MEANINGS, values)])
    return totals.select("site", F.inline(rows))


def score_explanation(scored: DataFrame) -> DataFrame:
    """Why a site with many issues may still score well."""
    number = lambda c: F.col(c).cast("string")
    few = F.when(F.col("high_issues") == 0, F.concat(
        F.lit("none of the "), number("issues"), F.lit(" issues are High-severity"))).otherwise(
        F.concat(F.lit("only "), number("high_issues"), F.lit(" of the "), number("issues"),
                 F.lit(" issues are High-severity ("),
                 fixed(ratio(F.col("high_issues"), F.col("pages")), 1),
                 F.lit(" per page) — the Issues score rewards low high-severity density")))
    drag = F.when(F.col("broken") > 0, F.concat(
        number("broken"), F.lit(" broken link(s) are the biggest drag on your grade (Broken Links score = "),
        fixed(round_even(F.col("broken_score"), 1), 0), F.lit("/100)")))
    return scored.select("site", "score", "grade", F.concat_ws("; ", few, drag).alias("explanation"))


def category_table(scored: DataFrame) -> DataFrame:
    """Seven rows per site: capped score, status and the live calculation text."""
    number = lambda c: F.col(c).cast("string")
    pages = number("pages")
    arrow = F.lit(" → score ")
    live = {
        "Issues": [number("high_issues"), F.lit(" high-sev issues ÷ "), pages, F.lit(" pages")],
        "Broken Links": [number("broken"), F.lit(" broken ÷ "), pages, F.lit(" pages")],
        "Performance": [F.lit("avg load "), fixed(F.coalesce("avg_load", F.lit(0.0)), 2), F.lit("s")],
        "SEO": [number("with_title"), F.lit(" of "), pages, F.lit(" pages have <title>")],
        "Accessibility": [(F.col("images") - F.col("missing_alts")).cast("string"), F.lit(" of "),
                          number("images"), F.lit(" images have alt text")],
        "Meta Tags": [number("with_meta"), F.lit(" of "), pages, F.lit(" pages have meta desc")],
        "Mobile": [number("with_viewport"), F.lit(" of "), pages, F.lit(" pages have viewport tag")],
    }
    rows = []
    for category, icon, weight, checked, formula, good in K.CATEGORY_TEXTS:
        value = F.least(F.element_at("breakdown", F.lit(category)), F.lit(100.0))
        status = (F.when(value >= 70, K.GOOD).when(value >= 40, K.NEEDS_WORK_CATEGORY)
                  .otherwise(K.POOR))
        shown = fixed(value, 0)
        rows.append(F.struct(
            F.lit(icon).alias("icon"), F.lit(category).alias("category"),
            F.lit(weight).alias("weight"), F.concat(shown, F.lit(" / 100")).alias("your_score"),
            status.alias("status"), F.lit(checked).alias("what_is_checked"),
            F.concat(*live[category], arrow, shown).alias("this_site"),
            F.lit(formula).alias("formula"), F.lit(good).alias("good_score_means")))
    return scored.select("site", F.inline(F.array(*rows)))


def risk_components(risk: DataFrame) -> DataFrame:
    """Contribution of volume, severity and broken links, from the rounded inputs."""
    return risk.select(
        "site", "module",
        round_even(F.col("issue_count") * 0.4, 2).alias("issue_volume"),
        round_even(F.col("avg_severity_weight") * 10 * 0.35, 2).alias("severity"),
        round_even(F.col("broken_link_rate") * 100 * 0.25, 2).alias("broken_links"))


def risk_display(risk: DataFrame) -> DataFrame:
    return risk.select(
        "site", "module", "issue_count", "open_issues", "high_severity",
        F.concat(fixed(F.col("broken_link_rate") * 100, 1), F.lit("%")).alias("broken_link_rate"),
        fixed(F.col("risk_score"), 1).alias("risk_score"), "risk_level",
        F.when(F.col("small_sample"), K.SMALL_SAMPLE_TEXT).otherwise(K.ENOUGH_SAMPLE_TEXT)
        .alias("small_sample"))


def small_samples(risk: DataFrame) -> DataFrame:
    """Modules whose score is directional only."""
    return risk.where("small_sample").select("site", "module", "issue_count")


def issue_listing(issues: DataFrame) -> DataFrame:
    """The raw issue table under its display names."""
    return issues.select("site", *[F.col(c).alias(label) for c, label in K.LISTING_COLUMNS])
