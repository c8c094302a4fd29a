"""Issue rules, de-duplication, status draw, numbering and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge.functions.skew import number_per_group
from sitegauge.functions.urls import module_of

# rows of one site that are numbered together
PAGES_PER_CHUNK = 10_000
_FIELDS = ["issue_type", "severity", "occurrences", "fix_time_hours", "description", "source"]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def _issue(rule_no, form_no, issue_type, severity, occurrences, hours, description, source) -> str:
    return (f"named_struct('rule_no', {rule_no}, 'form_no', {form_no}, 'issue_type', "
            f"{_quoted(issue_type)}, 'severity', {severity}, 'occurrences', cast({occurrences} as bigint), "
            f"'fix_time_hours', cast({hours} as double), 'description', {description}, "
            f"'source', '{source}')")


def _rule(no, cond, issue_type, severity, hours, description, source, occurrences="1") -> str:
    return (f"case when {cond} then "
            f"{_issue(no, 0, issue_type, severity, occurrences, hours, description, source)} end")


def _page(*tail: str) -> str:
    """Text starting with "Page '<url>' ", then the given pieces (columns or quoted texts)."""
    return "concat('Page \\'', url, '\\' ', " + ", ".join(tail) + ")"


def _page_rules() -> Column:
    """Array of the issues of one page, in rule order."""
    t = _quoted
    load, low, medium, high = "coalesce(load_time, 0)", t("Low"), t("Medium"), t("High")
    missing = lambda flag: f"has_html and not coalesce({flag}, false)"
    codes = lambda values: ", ".join(map(str, values))
    before_forms = [
        _rule(1, f"status_code in ({codes(K.GONE_CODES)})", "Broken Link (404)", high, 0.5,
              _page(t("returns HTTP "), "status_code", t(" — broken or removed.")), "crawl_status"),
        _rule(2, f"status_code in ({codes(K.SERVER_ERROR_CODES)})", "Server Error", high, 2.0,
              _page(t("returns server error "), "status_code", t(".")), "crawl_status"),
        _rule(3, "error = 'timeout'", "Page Timeout", high, 3.0,
              _page(t(f"timed out after {K.TIMEOUT_SECONDS}s.")), "crawl_timeout"),
        _rule(4, f"{load} > 3", "Slow Page Load", f"if(load_time > 6, {high}, {medium})", 4.0,
              _page(t("loaded in "), "load_time", t("s (threshold: 3s).")), "crawl_performance"),
        _rule(5, f"{load} > 1.5 and {load} <= 3", "Moderate Load Time", low, 2.0,
              _page(t("loaded in "), "load_time", t("s — consider optimization.")),
              "crawl_performance"),
        _rule(6, missing("has_title"), "Missing Page Title", medium, 0.25,
              _page(t("has no <title> tag — impacts SEO.")), "crawl_seo"),
        _rule(7, missing("has_meta_description"), "Missing Meta Description", low, 0.25,
              _page(t("missing meta description.")), "crawl_seo"),
        _rule(8, "h1_count > 1", "Multiple H1 Tags", low, 0.5,
              _page(t("has "), "h1_count", t(" H1 tags; only one recommended.")), "crawl_seo",
              "h1_count"),
        _rule(9, "has_html and coalesce(h1_count, 0) = 0", "Missing H1 Tag", medium, 0.5,
              _page(t("has no H1 heading — impacts accessibility/SEO.")), "crawl_accessibility"),
        _rule(10, "img_missing_alt > 0", "Missing Image Alt Text",
              f"if(img_missing_alt > 5, {medium}, {low})", "rint(img_missing_alt) / 10",
              f"concat(img_missing_alt, '/', img_total, {t(' images on ' + chr(39))}, url, "
              f"{t(chr(39) + ' lack alt text (WCAG 2.1 violation).')})",
              "crawl_accessibility", "img_missing_alt"),
    ]
    form = _issue(
        11, "i", "Form Without Client-Side Validation", high, 1, 2.0,
        f"concat({t('Form on ' + chr(39))}, url, {t(chr(39) + ' (action=' + chr(39))}, f.action, "
        f"{t(chr(39) + ') has ')}, f.input_count, {t(' inputs with no validation.')})", "crawl_forms")
    forms = (f"transform(coalesce(forms, array()), (f, i) -> "
             f"case when not f.has_validation and f.input_count > 0 then {form} end)")
    after_forms = [
        _rule(12, missing("has_viewport"), "Missing Viewport Meta Tag", medium, 0.25,
              _page(t("missing viewport meta — not mobile-responsive.")), "crawl_mobile"),
        _rule(13, missing("has_canonical") + " and depth > 0", "Missing Canonical Tag", low, 0.25,
              _page(t("missing canonical tag — duplicate content risk.")), "crawl_seo"),
        _rule(14, missing("has_og"), "Missing Open Graph Tags", low, 0.5,
              _page(t("has no Open Graph tags — poor social sharing.")), "crawl_seo"),
    ]
    return F.expr(f"filter(concat(array({', '.join(before_forms)}), {forms}, "
                  f"array({', '.join(after_forms)})), x -> x is not null)")


def page_issues(features: DataFrame) -> DataFrame:
    """Issues of the crawled pages: one map-only pass, no union of filtered scans."""
    return (features
            .select("site", F.lit(0).alias("phase"), F.col("ord").alias("pos"),
                    F.col("url").alias("page_url"), "module", F.explode(_page_rules()).alias("i"))
            .select("site", "phase", "pos", "i.rule_no", "i.form_no", "page_url", "module",
                    *[f"i.{c}" for c in _FIELDS]))


def link_issues(broken: DataFrame) -> DataFrame:
    """Issues of broken links; external links come before internal ones."""
    status = F.col("status")
    dead = status == 0
    return broken.select(
        "site",
        F.when(F.col("origin") == "external", F.lit(1)).otherwise(F.lit(2)).alias("phase"),
        "pos",
        F.when(dead, F.lit(16)).otherwise(F.lit(15)).alias("rule_no"),
        F.lit(0).alias("form_no"),
        F.col("url").alias("page_url"),
        module_of("url").alias("module"),
        F.when(dead, F.lit("Unreachable Link")).otherwise(F.lit("Broken External Link"))
        .alias("issue_type"),
        F.when(dead | status.isin(K.GONE_CODES), F.lit("High")).otherwise(F.lit("Medium"))
        .alias("severity"),
        F.lit(1).cast("long").alias("occurrences"),
        F.lit(0.5).alias("fix_time_hours"),
        F.concat(F.lit("Link '"), F.col("url"), F.lit("' returned status "),
                 status.cast("string"), F.lit(".")).alias("description"),
        F.lit("crawl_links").alias("source"))


def raw_issues(features: DataFrame, broken: DataFrame) -> DataFrame:
    """All issues before de-duplication, with status Open."""
    return (page_issues(features).unionByName(link_issues(broken))
            .withColumn("status", F.lit("Open")))


def with_issue_ids(raw: DataFrame) -> DataFrame:
    """Add ``id``: 1, 2, … per site in page, rule and form order, broken links last."""
    chunk = F.struct("phase", F.floor(F.col("pos") / PAGES_PER_CHUNK).alias("block"))
    return number_per_group(
        raw, ["site"], chunk,
        [F.col(c) for c in ("phase", "pos", "rule_no", "form_no")], "id")


def deduplicate(raw: DataFrame) -> DataFrame:
    """One issue per (site, module, issue_type): first row's fields, occurrences summed.

    Partial aggregation runs before the shuffle, so a hot module costs each task
    one row.
    """
    kept = ["page_url", "severity", "status", "fix_time_hours", "description", "source"]
    order = F.struct("phase", "pos", "rule_no", "form_no")
    merged = raw.groupBy("site", "module", "issue_type").agg(
        F.min(F.struct(order.alias("first_seen"), *kept)).alias("first"),
        F.sum("occurrences").alias("occurrences"))
    return merged.select(
        "site", "module", "issue_type", "occurrences", "first.first_seen",
        *[f"first.{c}" for c in kept])


def draw_status(issues: DataFrame) -> DataFrame:
    """Synthetic status of crawl issues: a four-slot draw per severity.

    The draw depends on the issue's key only, not on row order or partitions.
    """
    digit = F.substring(F.md5(F.concat_ws("|", "site", "module", "issue_type")), 1, 1)
    slot = ((F.instr(F.lit("0123456789abcdef"), digit) - 1) % 4 + 1).cast("int")
    options = {s: F.element_at(F.array(*[F.lit(x) for x in slots]), slot)
               for s, slots in K.STATUS_SLOTS.items()}
    return issues.withColumn(
        "status", F.when(F.col("severity") == "Low", options["Low"])
        .when(F.col("severity") == "Medium", options["Medium"]).otherwise(options["High"]))


def enrich(issues: DataFrame) -> DataFrame:
    """Fill missing columns with "Unknown" and add weight and 0/1 flags."""
    for name in ("module", "issue_type", "severity", "status", "occurrences",
                 "fix_time_hours", "description"):
        if name not in issues.columns:
            issues = issues.withColumn(name, F.lit("Unknown"))
    weight = F.create_map(*[F.lit(x) for kv in K.SEVERITY_WEIGHTS.items() for x in kv])
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    return issues.withColumns({
        "severity_weight": F.coalesce(F.try_element_at(weight, F.col("severity")), F.lit(1.0)),
        "is_critical": flag(F.col("severity") == "High"),
        "is_recurring": flag(F.col("status") == "Reopened"),
        "is_open": flag(F.col("status").isin("Open", "Reopened")),
    })


def issues_of(features: DataFrame, broken: DataFrame) -> DataFrame:
    """De-duplicated, status-carrying, enriched issues of a crawl."""
    return enrich(draw_status(deduplicate(raw_issues(features, broken))))
