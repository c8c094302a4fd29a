from pyspark.sql import functions as F

from sitegauge.operators import issues as I
from sitegauge.operators import links as L
from sitegauge.operators.features import page_features

GOOD = ('<title>t</title><meta name="description" content="d"><meta name="viewport"><h1>x</h1>'
        '<meta property="og:title" content="t"><link rel="canonical">')


def found(pages):
    return [(r.pos, r.issue_type, r.severity, r.occurrences, r.fix_time_hours, r.description)
            for r in I.page_issues(page_features(pages)).orderBy("pos", "rule_no", "form_no").collect()]


def kinds(pages):
    return [(pos, kind, severity) for pos, kind, severity, *_ in found(pages)]


def test_load_time_boundaries(crawl):
    times = [None, 0.0, 1.5, 1.501, 3.0, 3.001, 6.0, 6.001]
    got = kinds(crawl(*[{"load_time": t} for t in times]))
    assert got == [(3, "Moderate Load Time", "Low"), (4, "Moderate Load Time", "Low"),
                   (5, "Slow Page Load", "Medium"), (6, "Slow Page Load", "Medium"), (7, "Slow Page Load", "High")]


def test_status_and_errors(crawl):
    got = kinds(crawl(*[{"status_code": c} for c in (404, 410, 500, 502, 503, 403)],
                      {"status_code": None, "error": "timeout"}, {"status_code": None, "error": "ssl_error"}))
    assert got == [(0, "Broken Link (404)", "High"), (1, "Broken Link (404)", "High"), (2, "Server Error", "High"),
                   (3, "Server Error", "High"), (4, "Server Error", "High"), (6, "Page Timeout", "High")]


def test_markup_rules_and_order(crawl):
    assert found(crawl({"html": GOOD})) == []
    bare = kinds(crawl({"html": "<p>"}))
    assert [k for _, k, _ in bare] == [
        "Missing Page Title", "Missing Meta Description", "Missing H1 Tag", "Missing Viewport Meta Tag",
        "Missing Canonical Tag", "Missing Open Graph Tags"]
    home = kinds(crawl({"html": "<p>", "url": "https://s.test/"}))
    assert "Missing Canonical Tag" not in [k for _, k, _ in home]
    assert found(crawl({"html": ""}, {"html": None})) == []


def test_counted_rules(crawl):
    pages = crawl({"html": GOOD + "<h1>y</h1>"}, {"html": GOOD + "<img>" * 5 + '<img alt="a">'},
                  {"html": GOOD + "<img>" * 6})
    assert [(k, s, n, h) for _, k, s, n, h, _ in found(pages)] == [
        ("Multiple H1 Tags", "Low", 2, 0.5), ("Missing Image Alt Text", "Low", 5, 0.5),
        ("Missing Image Alt Text", "Medium", 6, 0.6)]
    assert found(pages)[1][5] == "5/6 images on 'https://s.test/about/1' lack alt text (WCAG 2.1 violation)."


def test_every_unvalidated_form_is_an_issue(crawl):
    html = GOOD + '<form action="/a"><input></form><form><input required="1"></form><form></form><form><input><input></form>'
    got = found(crawl({"html": html}))
    assert [d for *_, d in got] == [
        "Form on 'https://s.test/about/0' (action='/a') has 1 inputs with no validation.",
        "Form on 'https://s.test/about/0' (action='') has 2 inputs with no validation."]


def test_a_missing_page_is_reported_twice(crawl):
    features = page_features(crawl({"status_code": 404, "html": GOOD}))
    raw = I.raw_issues(features, L.broken_internal_pages(features))
    assert [r.issue_type for r in I.with_issue_ids(raw).orderBy("id").collect()] == [
        "Broken Link (404)", "Broken External Link"]


def test_link_issues(spark):
    broken = spark.createDataFrame(
        [("s", "https://x.test/", s, "external", i + 1) for i, s in enumerate((0, 403, 404, 410, 500))],
        "site string, url string, status int, origin string, pos long")
    got = I.link_issues(broken).orderBy("pos").collect()
    assert [(r.issue_type, r.severity) for r in got] == [
        ("Unreachable Link", "High"), ("Broken External Link", "Medium"), ("Broken External Link", "High"),
        ("Broken External Link", "High"), ("Broken External Link", "Medium")]
    assert got[0].description == "Link 'https://x.test/' returned status 0."


def test_dedup_keeps_first_and_sums(crawl):
    pages = crawl(*[{"html": GOOD + "<img>" * n, "load_time": t} for n, t in ((2, 6.5), (7, 3.5), (1, 1.0))])
    raw = I.page_issues(page_features(pages)).withColumn("status", F.lit("Open"))
    got = {r.issue_type: r for r in I.deduplicate(raw.repartition(7)).collect()}
    alt = got["Missing Image Alt Text"]
    assert (alt.occurrences, alt.severity, alt.page_url) == (10, "Low", "https://s.test/about/0")
    assert (got["Slow Page Load"].severity, got["Slow Page Load"].occurrences) == ("High", 2)
    total = raw.agg(F.sum("occurrences")).first()[0]
    assert sum(r.occurrences for r in got.values()) == total


def test_ids_are_dense_over_chunks(crawl, monkeypatch):
    monkeypatch.setattr(I, "PAGES_PER_CHUNK", 3)
    pages = crawl(*[{"html": "<p>", "ord": o, "site": s} for s in "ab" for o in range(10)])
    features = page_features(pages)
    raw = I.raw_issues(features, L.broken_internal_pages(features))
    got = I.with_issue_ids(raw).orderBy("site", "pos", "rule_no").collect()
    for site in "ab":
        assert [r.id for r in got if r.site == site] == list(range(1, 61))


def test_status_draw_ignores_order_and_uses_the_slots(spark):
    rows = [("s", f"m{i}", "t", sev) for i in range(200) for sev in ("Low", "Medium", "High")]
    df = spark.createDataFrame(rows, "site string, module string, issue_type string, severity string")
    one = {tuple(r) for r in I.draw_status(df.repartition(1)).collect()}
    assert one == {tuple(r) for r in I.draw_status(df.repartition(7)).collect()}
    seen = {sev: {r[4] for r in one if r[3] == sev} for sev in ("Low", "Medium", "High")}
    assert seen == {"Low": {"Open", "Fixed"}, "Medium": {"Open", "Reopened", "Fixed"}, "High": {"Open", "Reopened"}}


def test_enrich_defaults(spark):
    df = spark.createDataFrame([("High", "Reopened"), ("Odd", "Fixed"), (None, None)], "severity string, status string")
    got = I.enrich(df).collect()
    assert [(r.severity_weight, r.is_critical, r.is_recurring, r.is_open) for r in got] == [
        (3.0, 1, 1, 1), (1.0, 0, 0, 0), (1.0, 0, 0, 0)]
    assert got[0].module == got[0].description == got[0].occurrences == "Unknown"
