"""End-to-end audit: crawl tables in, every result table out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.operators import advice, issues, links, reports, robots, scoring
from sitegauge.operators.features import page_features
from sitegauge.session import stage


@dataclass
class Audit:
    """Lazy result tables of one crawl table.

    The HTML is scanned once: features are staged as a narrow table, all later steps
    read that. ``link_status`` is a function of the distinct external links or a table.
    With robots ``rules`` only pages that may be fetched are audited, but for sites whose
    row of ``runs`` says that they did not respect them. ``runs`` also tells how long a
    crawl took. ``max_checks`` limits the external links that are looked up per site.
    """

    pages: DataFrame
    link_status: object
    rules: DataFrame | None = None
    max_checks: int | None = None
    runs: DataFrame | None = None

    @cached_property
    def features(self) -> DataFrame:
        """Staged features, rebalanced: many large HTML splits leave few narrow rows each.

        Robots rules are applied to the features, so the HTML itself is never shuffled.
        """
        found = page_features(self.pages)
        if self.rules is not None:
            found = (robots.allowed_pages(found, self.rules) if self.runs is None
                     else robots.allowed_by_run(found, self.rules, self.runs))
        return stage(found.hint("rebalance", "site", "url"), "features")

    @cached_property
    def links(self) -> DataFrame:
        return links.links(self.features)

    @cached_property
    def external(self) -> DataFrame:
        return links.external_links(self.links)

    @cached_property
    def broken(self) -> DataFrame:
        """Broken links; staged because scores, risk, issues and reports all read them."""
        status = self.link_status(self.external) if callable(self.link_status) else self.link_status
        return stage(links.broken_links(self.features, self.external, status, self.max_checks), "broken")

    @cached_property
    def raw_issues(self) -> DataFrame:
        return issues.raw_issues(self.features, self.broken)

    @cached_property
    def issues(self) -> DataFrame:
        """De-duplicated issues; staged, every report reads them."""
        return stage(issues.issues_of(self.features, self.broken), "issues")

    @cached_property
    def totals(self) -> DataFrame:
        return scoring.site_totals(self.features, self.broken, self.issues)

    @cached_property
    def health(self) -> DataFrame:
        return scoring.health(self.totals)

    @cached_property
    def risk(self) -> DataFrame:
        return scoring.module_risk(self.issues, self.features, self.broken)

    @cached_property
    def told(self) -> DataFrame | None:
        """The runs; without them, given rules were respected by every site."""
        if self.runs is not None or self.rules is None:
            return self.runs
        return scoring.start_urls(self.features).select(
            "site", "start_url", F.lit(None).cast("double").alias("crawl_seconds"), F.lit(True).alias("respect_robots"))

    @cached_property
    def header(self) -> DataFrame:
        return reports.crawl_header(
            self.features, links.external_link_counts(self.external, self.max_checks), self.broken, self.told)

    @cached_property
    def summary(self) -> DataFrame:
        return reports.crawl_summary(self.header, self.issues)

    @cached_property
    def advice_inputs(self) -> DataFrame:
        return advice.advice_inputs(self.totals, self.issues)
