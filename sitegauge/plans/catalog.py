"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge.functions import urls as U
from sitegauge.operators import (
    advice, clusters, features, forest, issues, keywords, links, reach, reports, robots, scoring,
)
from sitegauge.plans.audit import Audit
from sitegauge.sources import derived, sinks
from sitegauge.sources.crawl import keep_html_only

Query = Callable[[SparkSession, str], DataFrame]


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def given_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "pages")


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_html_only(derived.crawl_pages(given_pages(spark, sf_dir)))


def audit_of(spark: SparkSession, sf_dir: str) -> Audit:
    pages = crawl(spark, sf_dir)
    return Audit(pages, derived.link_status, runs=derived.crawl_runs(pages))


def on_audit(build: Callable[[Audit], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(audit_of(spark, sf_dir))


def on_features(build: Callable[[DataFrame], DataFrame]) -> Query:
    """A query that reads the features once needs no staged table."""
    return lambda spark, sf_dir: build(features.page_features(crawl(spark, sf_dir)))


def on_urls(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(given_pages(spark, sf_dir))


FLAT_FEATURES = [
    "site", "ord", "url", "status_code", "load_time", "error", "has_html", "module", "depth",
    "title", "meta_description", "img_total", "img_missing_alt", "form_count", "button_count",
    "has_canonical", "has_viewport", "has_og", "has_title", "has_meta_description", "h1_count",
    "element_count", "scripts"]
ISSUE_COLUMNS = ["site", "page_url", "module", "issue_type", "severity", "status", "occurrences",
                 "fix_time_hours", "description", "source"]


def crawl_scan(spark, sf_dir):
    return crawl(spark, sf_dir).select(
        "site", "ord", "url", "status_code", "content_type", "load_time", "error",
        F.md5("html").alias("html_md5"))


def robots_check(spark, sf_dir):
    pages = crawl(spark, sf_dir).select("site", "start_url", "url")
    return robots.allowed_pages(pages, derived.robots_rules(pages)).select("site", "url")


def crawl_results(audit: Audit) -> DataFrame:
    return reports.crawl_results(audit.runs, audit.header, derived.robots_rules(audit.pages))


def fetched_pages(spark, sf_dir):
    """Pages that may be fetched, where each site's run tells whether it respects robots rules."""
    pages = crawl(spark, sf_dir)
    return robots.allowed_by_run(pages.select("site", "start_url", "url"), derived.robots_rules(pages),
                                 derived.crawl_runs(pages)).select("site", "url")


def crawl_order(max_pages: int | None = None) -> Query:
    def query(spark, sf_dir):
        audit = audit_of(spark, sf_dir)
        starts = scoring.start_urls(audit.features)
        return reach.link_reach(starts, audit.links, derived.robots_rules(starts), max_pages)

    return query


def broken_of_first(audit: Audit) -> DataFrame:
    """Broken links when only the first external links of a site are checked."""
    return links.broken_links(audit.features, audit.external, derived.link_status(audit.external),
                              K.MAX_EXTERNAL_CHECKS)


def text_of(audit: Audit) -> DataFrame:
    return keywords.issue_docs(audit.issues)


def document_docs(spark, sf_dir) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    return docs.select(F.col("lang").alias("corpus"), "doc_id", "text")


def document_keywords(spark, sf_dir):
    docs = keywords.enough_docs(document_docs(spark, sf_dir))
    return keywords.top_keywords(keywords.tfidf(keywords.tokens(docs)))


def issue_keywords(audit: Audit) -> DataFrame:
    return keywords.top_keywords(keywords.tfidf(keywords.tokens(
        keywords.enough_docs(text_of(audit)))))


def issue_clusters(audit: Audit) -> DataFrame:
    clustered, _ = clusters.issue_clusters(audit.issues)
    return clustered.select("site", "module", "issue_type", "cluster")


def site_clusters(audit: Audit) -> DataFrame:
    """Clusters of every site's own issues, all sites at once."""
    clustered, _ = clusters.issue_clusters(audit.issues, "site")
    return clustered.select("site", "module", "issue_type", "cluster")


def cluster_profile(audit: Audit) -> DataFrame:
    return shown_profile(clusters.cluster_profile(*clusters.issue_clusters(audit.issues)))


def drawn_cluster_profile(audit: Audit) -> DataFrame:
    """The profile of clusters drawn by hash, which SQL can draw as well."""
    weights = keywords.tfidf(keywords.tokens(text_of(audit)))
    return shown_profile(clusters.cluster_profile(derived.drawn(audit.issues), weights))


def shown_profile(profile: DataFrame) -> DataFrame:
    return profile.select(
        "cluster", "label", F.array_join("keywords", ", ").alias("keywords"), "count", "share",
        "small_sample", F.array_join("examples", " | ").alias("examples"),
        F.array_join("top_modules", ", ").alias("top_modules"),
        F.to_json("severities").alias("severities"))


def train_test_split(audit: Audit) -> DataFrame:
    rows, _, _ = forest.prepare(audit.issues)
    return rows.select("row_key", "label", "module_enc", "type_enc", "occurrences",
                       "fix_time_hours", "severity_weight", "is_test")


def forest_report(audit: Audit) -> DataFrame:
    return forest.classification_report(forest.confusion(forest.train(audit.issues).scored_test))


def forest_metrics(audit: Audit) -> DataFrame:
    return forest.model_cards(forest.train(audit.issues).scored_test)


def forest_confusion(audit: Audit) -> DataFrame:
    return forest.confusion(forest.train(audit.issues).scored_test)


def feature_importance(audit: Audit) -> DataFrame:
    return forest.feature_importance(forest.train(audit.issues).nodes)


def forest_predictions(audit: Audit) -> DataFrame:
    return forest.predictions(forest.train(audit.issues).scored_test)


def forest_scores(audit: Audit) -> DataFrame:
    return forest.score(forest.train(audit.issues), derived.scoring_inputs(audit.issues))


DRAWN_SIZE = {"trees": derived.DRAWN_TREES, "depth": derived.DRAWN_DEPTH}


def drawn_forest_predictions(audit: Audit) -> DataFrame:
    """Test rows scored by trees that SQL can draw as well."""
    rows, _, _ = forest.prepare(audit.issues)
    nodes = derived.drawn_nodes(audit.issues)
    return forest.predictions(forest.with_probabilities(nodes, rows.where("is_test"), **DRAWN_SIZE))


def drawn_forest_scores(audit: Audit) -> DataFrame:
    inputs = derived.scoring_inputs(audit.issues)
    codes = [forest.category_codes(audit.issues, c) for c in ("module", "issue_type")]
    return forest.verdicts(derived.drawn_nodes(audit.issues), forest.scoring_rows(inputs, *codes), inputs.columns,
                           **DRAWN_SIZE)


def one_class_repair(audit: Audit) -> DataFrame:
    """Only the issues that are not critical: one class, so a copy with one flipped label is added."""
    rows = audit.issues.where("is_critical = 0").select(
        F.concat_ws("|", "site", "module", "issue_type").alias("row_key"), F.col("is_critical").alias("label"))
    return forest.two_classes(rows)


def issue_defaults(audit: Audit) -> DataFrame:
    """An issue table that lacks four of its columns."""
    bare = audit.issues.select("site", "module", "issue_type", "severity")
    return issues.enrich(bare).select(
        "site", "module", "issue_type", "status", "occurrences", "fix_time_hours", "description",
        "severity_weight", "is_critical", "is_recurring", "is_open")


def clean_site_advice(audit: Audit) -> DataFrame:
    """Advice for the crawled sites, had no issue been found."""
    none = audit.issues.where("false")
    totals = scoring.site_totals(audit.features, audit.broken.where("false"), none)
    return advice.recommendations(advice.advice_inputs(totals, none))


def seed_urls(pages: DataFrame) -> DataFrame:
    typed = derived.typed_urls(pages)
    return typed.select("page_id", F.inline(F.array(U.seed_url(F.col("raw_url")))))


def health_scores(audit: Audit) -> DataFrame:
    return scoring.health_of_sites(audit.pages.select("site").distinct(), audit.health).select(
        "site", "score", "grade", "color")


def queries() -> dict[str, Query]:
    return {
        # sources, URLs, page features
        "crawl_scan": crawl_scan,
        "seed_urls": on_urls(seed_urls),
        "url_clean": on_urls(lambda p: p.select("page_id", U.clean_url(F.col("url")).alias("clean"))),
        "url_module": on_urls(lambda p: p.select("page_id", U.module_of("url").alias("module"))),
        "page_depth": on_urls(lambda p: p.select("page_id", U.depth(F.col("url")).alias("depth"))),
        "same_domain": on_urls(lambda p: p.select("page_id", U.is_same_domain(
            F.col("url"), F.lit("cheap-pills.example.com")).alias("is_internal"))),
        "page_features": on_features(lambda f: f.select(*FLAT_FEATURES)),
        "page_headings": on_features(features.page_headings),
        "page_forms": on_features(features.page_forms),
        "page_links": on_features(links.links),
        # link graph
        "external_links": on_features(lambda f: links.external_links(links.links(f))),
        "external_link_counts": on_features(
            lambda f: links.external_link_counts(links.external_links(links.links(f)))),
        "broken_links": on_audit(lambda a: a.broken),
        "robots_allowed": robots_check,
        "robots_by_run": fetched_pages,
        "broken_links_first20": on_audit(broken_of_first),
        "link_reach": crawl_order(),
        "link_reach_first50": crawl_order(K.MAX_PAGES),
        # issues
        "issues_raw": on_audit(lambda a: a.raw_issues.select(*ISSUE_COLUMNS)),
        "issue_ids": on_audit(lambda a: issues.with_issue_ids(a.raw_issues).select(
            "site", "id", "page_url", "issue_type", "form_no")),
        "issues": on_audit(lambda a: a.issues.select(*ISSUE_COLUMNS)),
        "issue_flags": on_audit(lambda a: a.issues.select(
            "site", "module", "issue_type", "severity_weight", "is_critical", "is_recurring",
            "is_open")),
        "issue_listing": on_audit(lambda a: reports.issue_listing(a.issues)),
        "issue_defaults": on_audit(issue_defaults),
        "export_rows": on_audit(lambda a: sinks.export_rows(a.issues)),
        # scores
        "health_scores": on_audit(health_scores),
        "health_breakdown": on_audit(lambda a: scoring.health_breakdown(a.health)),
        "module_risk": on_audit(lambda a: a.risk),
        "risk_components": on_audit(lambda a: reports.risk_components(a.risk)),
        "risk_display": on_audit(lambda a: reports.risk_display(a.risk)),
        "risk_small_sample": on_audit(lambda a: reports.small_samples(a.risk)),
        # reports
        "issue_type_top12": on_audit(lambda a: reports.top_issue_types(a.issues)),
        "module_counts": on_audit(lambda a: reports.count_by(a.issues, "module")),
        "severity_share": on_audit(lambda a: reports.severity_share(a.issues)),
        "status_counts": on_audit(lambda a: reports.count_by(a.issues, "status")),
        "module_severity_pivot": on_audit(lambda a: reports.module_severity_pivot(a.issues)),
        "slowest_pages": on_features(reports.slowest_pages),
        "load_summary": on_features(reports.load_summary),
        "worst_pages": on_audit(lambda a: reports.worst_pages(a.issues)),
        "module_cards": on_audit(lambda a: reports.module_cards(a.features, a.issues)),
        "module_examples": on_audit(lambda a: reports.module_examples(a.features)),
        "site_modules": on_features(reports.modules_of),
        "scoring_choices": on_audit(lambda a: reports.choices(a.issues)),
        "kpi_strip": on_audit(lambda a: reports.kpi_strip(a.header, a.issues)),
        "crawl_header": on_audit(lambda a: a.header),
        "crawl_results": on_audit(crawl_results),
        "crawl_summary": on_audit(lambda a: a.summary),
        "score_explanation": on_audit(lambda a: reports.score_explanation(a.health)),
        "category_table": on_audit(lambda a: reports.category_table(a.health)),
        # text
        "clean_tokens": on_audit(lambda a: keywords.tokens(text_of(a)).select(
            "corpus", "doc_id", F.posexplode("words").alias("pos", "word"))),
        "ngrams": on_audit(lambda a: keywords.term_counts(keywords.tokens(text_of(a)))),
        "vocabulary": on_audit(lambda a: keywords.vocabulary(keywords.tokens(text_of(a)))),
        "tfidf_keywords": on_audit(issue_keywords),
        "document_keywords": document_keywords,
        "text_guard": on_audit(lambda a: keywords.text_guard(text_of(a))),
        "issue_clusters": on_audit(issue_clusters),
        "site_clusters": on_audit(site_clusters),
        "cluster_profile": on_audit(cluster_profile),
        # model
        "module_codes": on_audit(lambda a: forest.category_codes(a.issues, "module")),
        "train_test_split": on_audit(train_test_split),
        "forest_metrics": on_audit(forest_metrics),
        "forest_confusion": on_audit(forest_confusion),
        "forest_report": on_audit(forest_report),
        "feature_importance": on_audit(feature_importance),
        "forest_scores": on_audit(forest_scores),
        "forest_predictions": on_audit(forest_predictions),
        "model_guard": on_audit(lambda a: forest.model_guard(a.issues)),
        "one_class_repair": on_audit(one_class_repair),
        # reports over predictions and clusters that are drawn by hash
        "drawn_confusion": on_audit(lambda a: forest.confusion(derived.drawn(a.issues))),
        "drawn_model_cards": on_audit(lambda a: forest.model_cards(derived.drawn(a.issues))),
        "drawn_report": on_audit(
            lambda a: forest.classification_report(forest.confusion(derived.drawn(a.issues)))),
        "drawn_forest_predictions": on_audit(drawn_forest_predictions),
        "drawn_forest_scores": on_audit(drawn_forest_scores),
        "drawn_forest_importance": on_audit(
            lambda a: forest.feature_importance(derived.drawn_nodes(a.issues))),
        "drawn_cluster_modules": on_audit(lambda a: clusters.cluster_counts(derived.drawn(a.issues), "module")),
        "drawn_cluster_profile": on_audit(drawn_cluster_profile),
        # advice
        "recommendations": on_audit(lambda a: advice.recommendations(a.advice_inputs)),
        "clean_site_advice": on_audit(clean_site_advice),
        "recurrence_flags": on_audit(lambda a: advice.recurrence_flags(a.advice_inputs)),
        "priority_tests": on_audit(lambda a: advice.priority_tests(a.risk)),
        "benchmarks": on_audit(lambda a: advice.benchmarks(a.advice_inputs)),
    }
