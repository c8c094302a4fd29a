import csv
import glob

import pytest
from pyspark.sql import functions as F

from sitegauge import schemas
from sitegauge.operators import advice, links, reports, scoring
from sitegauge.operators.features import page_features
from sitegauge.operators.issues import enrich
from sitegauge.plans.audit import Audit
from sitegauge.sources.sinks import export_rows, write_issue_csv

TOTALS = ("site string, start_url string, pages long, with_title long, with_meta long, with_viewport long, "
          "images long, missing_alts long, measured_pages long, avg_load double, max_load double, "
          "broken long, issues long, high_issues long")


def totals(spark, **values):
    base = dict(site="s", start_url="https://s.test/", pages=26, with_title=26, with_meta=26, with_viewport=26,
                images=0, missing_alts=0, measured_pages=26, avg_load=1.0, max_load=1.0, broken=0, issues=0,
                high_issues=0)
    return spark.createDataFrame([tuple({**base, **values}.values())], TOTALS)


@pytest.mark.parametrize("values, column, expected", [
    (dict(high_issues=10), "issues_score", 81), (dict(broken=10), "broken_score", 23),
    (dict(broken=1, pages=10), "broken_score", 80), (dict(avg_load=1.5), "performance_score", 92.5),
    (dict(avg_load=3.0), "performance_score", 70), (dict(avg_load=5.0), "performance_score", 40),
    (dict(avg_load=None), "performance_score", 115), (dict(with_title=21), "seo_score", 81),
    (dict(images=50, missing_alts=10), "accessibility_score", 80), (dict(), "accessibility_score", 100),
    (dict(with_meta=13), "meta_score", 50), (dict(), "mobile_score", 100), (dict(broken=26), "broken_score", 0)])
def test_category_scores(spark, values, column, expected):
    got = scoring.category_scores(totals(spark, **values)).first()[column]
    assert abs(got - expected) < 0.5


def test_grades(spark):
    df = spark.createDataFrame([(s,) for s in (80.0, 79.9, 65.0, 64.9, 50.0, 49.9, 35.0, 34.9)], "s double")
    got = df.select(scoring.grade_of(F.col("s")), scoring.grade_of(F.col("s"), color=True)).collect()
    assert [r[0] for r in got] == list("ABBCCDDF")
    assert [r[1] for r in got][:2] == ["green", "orange"]


def test_sites_without_pages(spark):
    sites = spark.createDataFrame([("s",), ("empty",)], "site string")
    got = {r.site: r for r in scoring.health_of_sites(sites, scoring.health(totals(spark))).collect()}
    assert (got["empty"].score, got["empty"].grade, got["empty"].color, got["empty"].breakdown) == (0.0, "F", "red", {})
    assert got["s"].score == 100.0


def issues(spark, *rows):
    full = [(r.get("site", "s"), i + 1, r.get("page_url", f"https://s.test/{i}"), r.get("module", "M"),
             r.get("issue_type", "T"), r.get("severity", "Low"), r.get("status", "Open"), r.get("occurrences", 1),
             r.get("hours", 1.0), r.get("description", "d"), "crawl_seo") for i, r in enumerate(rows)]
    return enrich(spark.createDataFrame(full, schemas.ISSUES))


NO_LINKS = "site string, url string, status int, origin string, pos long"


def test_risk_levels_ties_and_single_module(spark, crawl):
    from sitegauge.operators.features import page_features
    features = page_features(crawl(*[{"url": f"https://s.test/about/{i}"} for i in range(4)]))
    broken = spark.createDataFrame([("s", "https://s.test/about/9", 404, "internal", 1)], NO_LINKS)
    one = scoring.module_risk(issues(spark, {"module": "About"}), features, broken).first()
    assert (one.risk_score, one.risk_level, one.broken_link_rate, one.small_sample) == (50.0, "Medium", 0.25, True)
    assert one.raw_risk_score == pytest.approx(0.4 + 3.5 + 6.25)
    several = issues(spark, *[{"module": "A", "severity": "High"}] * 6, {"module": "B"}, {"module": "C"})
    got = scoring.module_risk(several, features, broken).orderBy(*scoring.risk_order()).collect()
    assert [(r.module, r.risk_score, r.risk_level) for r in got] == [
        ("A", 100.0, "High"), ("B", 0.0, "Low"), ("C", 0.0, "Low")]
    scores = spark.createDataFrame([("s", c, float(v)) for c, v in zip("abcd", (0, 39.96, 70, 100))],
                                   "site string, module string, raw_risk_score double")
    assert [r.risk_level for r in scoring.normalise(scores).orderBy("module").collect()] == [
        "Low", "Medium", "High", "High"]


def test_result_does_not_depend_on_partitions(spark, crawl):
    rows = [{"site": f"s{i % 3}", "url": f"https://s.test/p{i % 7}/{i}", "load_time": (i * 37 % 70) / 10,
             "status_code": 404 if i % 5 == 0 else 200, "html": "<p><img>" * (i % 4)} for i in range(60)]
    status = spark.createDataFrame([], schemas.LINK_STATUS)
    results = []
    for parts in (1, 7):
        audit = Audit(crawl(*rows).repartition(parts), status)
        results.append([sorted(map(str, df.collect())) for df in (audit.risk, audit.health, audit.issues, audit.header)])
    assert results[0] == results[1]


def test_top_lists_and_pivot(spark):
    many = issues(spark, *[{"issue_type": f"T{i:02d}"} for i in range(15) for _ in range(i + 1)],
                  *[{"site": "z", "severity": "High", "status": "Fixed"}] * 3)
    top = reports.top_issue_types(many).where("site = 's'").orderBy("rank").collect()
    assert [r.issue_type for r in top] == [f"T{i:02d}" for i in range(14, 2, -1)]
    pivot = {(r.site, r.module): (r.Low, r.Medium, r.High) for r in reports.module_severity_pivot(many).collect()}
    assert pivot == {("s", "M"): (120, 0, 0), ("z", "M"): (0, 0, 3)}
    assert {r.site: r.share for r in reports.severity_share(many).collect()} == {"s": 1.0, "z": 1.0}


def test_slowest_and_cards(spark, crawl):
    from sitegauge.operators.features import page_features
    features = page_features(crawl(*[{"url": f"https://s.test/about/{'x' * 60}{i}", "load_time": i / 10} for i in range(40)],
                                   {"load_time": None}))
    slow = reports.slowest_pages(features).orderBy("rank").collect()
    assert len(slow) == 25 and slow[0].load_time == 3.9 and slow[0].band == "red" and slow[-1].band == "green"
    assert slow[0].page == "…" + ("https://s.test/about/" + "x" * 60 + "39")[-45:]
    summary = reports.load_summary(features).first()
    assert (summary.measured_pages, summary.avg_load, summary.slow_pages) == (39, 2.0, 9)
    cards = reports.module_cards(features, issues(spark, {"module": "About", "severity": "High"})).first()
    assert (cards.page_count, cards.badge, cards.top_types) == (41, "1 HIGH", "T")
    examples = reports.module_examples(features).orderBy("rank").collect()
    assert [r.more_pages for r in examples] == [39, 39] and examples[0].short_url.startswith("…x")


def test_recommendation_rules(spark):
    rows = [{"issue_type": "Missing Canonical Tag", "module": f"m{i}"} for i in range(4)]
    rows += [{"issue_type": k} for k in ("Form Without Client-Side Validation", "Slow Page Load", "Missing Page Title",
                                         "Missing Viewport Meta Tag", "Server Error")]
    found = issues(spark, *rows)
    inputs = advice.advice_inputs(
        totals(spark, issues=9, broken=2, missing_alts=3, images=5, max_load=6.25, with_meta=20), found)
    got = advice.recommendations(inputs).orderBy("priority", "seq").collect()
    assert [r.title for r in got] == [
        "Fix 2 Broken Link(s)", "Resolve 1 Server Error(s) (5xx)", "Add Validation to 1 Form(s)",
        "Optimise 1 Slow Page(s) — max 6.2s", "Add Alt Text to 3 Image(s) — WCAG 2.1",
        "Fix 1 Missing Titles & 0 Meta Descriptions", "Add Viewport Meta to 1 Page(s)",
        "Add Canonical Tags to 4 Pages", "Enforce HTTPS + HSTS Headers", "Set Up Continuous Automated Testing"]
    assert [r.frequency for r in advice.recurrence_flags(inputs).collect()] == [
        "Check monthly", "Re-test after every major release"]
    marks = {r.metric: (r.this_site, r.result) for r in advice.benchmarks(inputs).collect()}
    assert marks["Average Load Time"] == ("1.00s", "✅ Good")
    assert marks["Pages With Meta Description"] == ("20/26", "⚠️ Needs Work")
    assert marks["Images With Alt Text"] == ("2/5", "⚠️ Needs Work")
    few = advice.advice_inputs(totals(spark, issues=3), issues(spark, *rows[:3]))
    assert [r.priority for r in advice.recommendations(few).collect()] == [8, 9]
    none = advice.advice_inputs(totals(spark), issues(spark, {"site": "other"}))
    assert [r.title for r in advice.recommendations(none).collect()] == ["No issues detected"]
    assert advice.recurrence_flags(none).count() == advice.benchmarks(none).count() == 0


def test_focus(spark):
    df = spark.createDataFrame([("Authentication",), ("My Cart Page",), ("Legal",)], "m string")
    got = [r[0] for r in df.select(advice.module_focus(F.col("m"))).collect()]
    assert got[0].startswith("Login") and got[1].startswith("Add/remove") and got[2].startswith("Functional")


def test_csv_export(spark, tmp_path):
    found = issues(spark, {"description": 'a "quoted", text', "severity": "High"}, {"site": "t"})
    starts = spark.createDataFrame([("s", "https://www.s.test/"), ("t", "https://t.test/")], "site string, start_url string")
    write_issue_csv(found, starts, str(tmp_path / "out"))
    files = glob.glob(str(tmp_path / "out" / "domain=s.test" / "*.csv"))
    with open(files[0], newline="") as handle:
        table = list(csv.DictReader(handle))
    assert list(table[0]) == ["module", "issue_type", "severity", "status", "occurrences", "fix_time_hours",
                              "description", "source", "page_url"]
    assert table[0]["description"] == 'a "quoted", text'
    assert export_rows(found).count() == 2


def test_explanation_and_categories(spark):
    scored = scoring.health(totals(spark, issues=5, avg_load=0.2, broken=1))
    table = {r.category: r for r in reports.category_table(scored).collect()}
    assert table["Performance"].your_score == "100 / 100"
    assert table["Performance"].this_site == "avg load 0.20s → score 100"
    assert reports.score_explanation(scored).first().explanation == (
        "none of the 5 issues are High-severity; 1 broken link(s) are the biggest drag on your grade "
        "(Broken Links score = 92/100)")


def test_one_row_per_site_whatever_its_start_urls(crawl):
    pages = crawl(*[{"start_url": u, "html": "<title>t</title>"} for u in
                    ("https://s.test/", "https://s.test/", "http://s.test/", None)], {"site": "t", "start_url": None})
    features = page_features(pages)
    totals = {r.site: (r.pages, r.with_title, r.start_url) for r in scoring.page_totals(features).collect()}
    assert totals == {"s": (4, 4, "http://s.test/"), "t": (1, 0, None)}
    broken = links.broken_internal_pages(features)
    counts = links.external_link_counts(links.external_links(links.links(features)))
    header = reports.crawl_header(features, counts, broken).collect()
    assert sorted((r.site, r.total_pages, r.start_url) for r in header) == [("s", 4, "http://s.test/"), ("t", 1, None)]


def test_runs_give_durations_and_errors(spark, crawl):
    pages = crawl({"html": "<title>t</title>"}, {"html": "<p>"}, {"site": "t", "start_url": "http://www.t.test/"},
                  {"site": "u", "start_url": None})
    runs = spark.createDataFrame([
        ("s", " s.test ", 12.3456, None), ("t", "http://www.t.test/", None, False), ("gone", "https://gone.test/", 3.0, True),
        ("shut", "https://shut.test/", 0.1, None), ("open", "https://shut.test/", 0.1, False), ("bad", "https:///x", 9.0, True),
        ("null", None, None, True)], schemas.CRAWL_RUNS)
    rules = spark.createDataFrame([("shut.test", "*", 0, False, "/")], schemas.ROBOTS_RULES)
    audit = Audit(pages, spark.createDataFrame([], schemas.LINK_STATUS), rules, runs=runs)
    header = {r.site: (r.base_domain, r.crawl_time, r.respect_robots) for r in audit.header.collect()}
    assert header == {"s": ("s.test", 12.35, None), "t": ("t.test", None, False), "u": (None, None, None)}
    told = {(r.site, r.metric): r.value for r in audit.summary.collect()}
    assert [told[site, "Crawl Duration"] for site in "stu"] == ["12.35s", "n/a", "n/a"]
    assert [told[site, "robots.txt Respected"] for site in "stu"] == ["n/a", "No", "n/a"]
    results = {r.site: r for r in reports.crawl_results(runs, audit.header, rules).collect()}
    assert len(results) == 7 and results["s"].url == "https://s.test" and results["s"].total_pages == 2
    assert [results[s].error for s in ("s", "t", "gone", "open")] == [None] * 4 and results["gone"].total_pages == 0
    assert results["shut"].error == "robots_blocked" and "blocked by robots.txt" in results["shut"].message
    assert results["shut"].total_pages is None and results["open"].crawl_time == 0.1
    assert {results[s].error for s in ("bad", "null")} == {"Invalid URL — no domain found."}
