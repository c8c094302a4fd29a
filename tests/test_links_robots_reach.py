import random
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge import schemas
from sitegauge.operators import links as L
from sitegauge.operators import reach
from sitegauge.operators.features import page_features
from sitegauge.operators.reach import link_reach
from sitegauge.operators.robots import (
    allowed_by_run, allowed_pages, host_rules, robots_allowed, verdicts, with_robots,
)

EDGE = "site string, src_url string, pos int, dst_url string, dst_clean string, is_internal boolean"


def test_all_external_links_are_checked(spark):
    urls = [f"https://x{i:03d}.test/" for i in range(100)]
    edges = spark.createDataFrame(
        [("a", "p", i, u, u, False) for i, u in enumerate(reversed(urls))]
        + [("b", "p", 0, urls[30], urls[30], False), ("b", "q", 0, urls[30], urls[30], False)], EDGE)
    external = L.external_links(edges)
    counts = lambda *limit: {r.site: (r.total_external_links, r.external_links_checked)
                             for r in L.external_link_counts(external, *limit).collect()}
    assert counts() == {"a": (100, 100), "b": (1, 1)} and counts(20) == {"a": (100, 20), "b": (1, 1)}
    # a second result for a URL does not count it twice
    status = spark.createDataFrame([(u, 404) for u in urls[:99]] + [(urls[0], 200)], schemas.LINK_STATUS)
    broken = L.broken_external_links(external, status).collect()
    assert sorted((r.pos, r.url) for r in broken if r.site == "a") == list(enumerate(urls[:99], 1))
    assert [r.url for r in broken if r.site == "b"] == [urls[30]]
    assert [tuple(r) for r in L.unchecked_external_links(external, status).collect()] == [("a", urls[99])]
    first = L.broken_external_links(external, status, K.MAX_EXTERNAL_CHECKS).collect()
    assert sorted(r.url for r in first if r.site == "a") == urls[:20]


def test_broken_codes(spark, crawl):
    codes = [200, 301, 403, 404, 410, 418, 500, 502, 503, 504, 0]
    edges = spark.createDataFrame([("a", "p", i, f"u{c}", f"u{c}", False) for i, c in enumerate(codes)], EDGE)
    status = spark.createDataFrame([(f"u{c}", c) for c in codes], schemas.LINK_STATUS)
    broken = L.broken_external_links(L.external_links(edges), status)
    assert sorted(r.status for r in broken.collect()) == sorted(K.BROKEN_EXTERNAL_CODES)
    pages = crawl(*[{"status_code": c} for c in codes], {"status_code": None, "error": "ssl_error"},
                  {"status_code": None, "error": None}, {"status_code": 200, "error": ""})
    internal = L.broken_internal_pages(page_features(pages))
    assert sorted(r.status for r in internal.collect()) == [0, 404, 410, 500, 502, 503]


ROBOTS = """
User-agent: otherbot
Disallow: /

User-agent: MOZ
Allow: /open/x
Disallow: /open
Disallow: /q?a=

User-agent: *
Disallow: /
"""


def test_robots_agree_with_the_standard_parser(spark):
    parser = RobotFileParser()
    parser.parse(ROBOTS.splitlines())
    rules = [("s.test", "otherbot", 0, False, "/"), ("s.test", "MOZ", 1, True, "/open/x"),
             ("s.test", "MOZ", 2, False, "/open"), ("s.test", "MOZ", 3, False, "/q?a="),
             ("s.test", "*", 4, False, "/"), ("t.test", "*", 0, False, ""), ("t.test", "*", 1, False, "/a"),
             ("w.test", "*", 0, False, "*")]
    table = spark.createDataFrame(rules, schemas.ROBOTS_RULES)
    urls = ["https://s.test", "https://s.test/open", "https://s.test/open/xy", "https://s.test/opening",
            "https://s.test/q?a=1", "https://s.test/q?b=1", "https://s.test/z"]
    others = ["https://t.test/a", "https://u.test/a", "https://w.test/a"]
    df = spark.createDataFrame([(u,) for u in urls + others], "url string")
    got = {r.url for r in robots_allowed(df, table).collect()}
    assert got == {u for u in urls if parser.can_fetch("mozilla", u)} | {"https://t.test/a", "https://u.test/a"}
    assert robots_allowed(df, table, respect_robots=False).count() == len(urls + others)


def edge_rows(site, graph):
    return [(site, page, i, target, target, True) for page, targets in graph.items() for i, target in enumerate(targets)]


def visits(rows, site):
    return [r.url for r in sorted(rows, key=lambda r: r.visit_no) if r.site == site]


# start "s" links a, b; the expected orders are written out by hand
SMALL = {"s": ["a", "b", "a"], "a": ["c", "s", "b", "d"], "b": ["d", "e"], "c": ["f"], "e": ["f", "g"], "g": ["a", "h"]}


def test_small_graph_is_visited_level_by_level(spark):
    url = lambda n: f"https://x.test/{n}"
    graph = {url(p): [url(t) for t in ts] for p, ts in SMALL.items()}
    table = spark.createDataFrame(edge_rows("x", graph) + [("x", url("s"), 9, "https://y.test/", "https://y.test/", False)], EDGE)
    starts = spark.createDataFrame([("x", url("s"))], "site string, start_url string")
    rules = spark.createDataFrame([("x.test", "*", 0, False, "/b"), ("x.test", "*", 1, False, "/f")], schemas.ROBOTS_RULES)
    order = lambda *more: [u[-1] for u in visits(link_reach(starts, table, *more).collect(), "x")]
    assert order() == list("sabcdefgh")
    assert order(None, 4) == list("sabc") and order(None, 1) == ["s"]
    assert order(rules) == list("sacd")
    levels = {r.url[-1]: r.level for r in link_reach(starts, table).collect()}
    assert levels == {"s": 0, "a": 1, "b": 1, "c": 2, "d": 2, "e": 2, "f": 3, "g": 3, "h": 4}


def test_large_sites_are_reached_whole(spark):
    """A chain of fans: 30 levels of 12 pages; and random graphs, checked by their properties."""
    page = lambda level, i: f"https://a.test/l{level}/{i}"
    fans = {page(v, 0): [page(v + 1, i) for i in range(12)] for v in range(30)}
    rng = random.Random(3)
    names = [f"https://b.test/n{i}" for i in range(150)]
    wild = {n: [rng.choice(names) for _ in range(rng.randint(0, 4))] for n in names}
    table = spark.createDataFrame(edge_rows("a", fans) + edge_rows("b", wild), EDGE)
    starts = spark.createDataFrame([("a", page(0, 0)), ("b", names[0])], "site string, start_url string")
    rows = link_reach(starts, table).collect()
    assert visits(rows, "a") == [page(0, 0)] + [page(v, i) for v in range(1, 31) for i in range(12)]
    of = {r.url: r for r in rows if r.site == "b"}
    assert sorted(r.visit_no for r in of.values()) == list(range(1, len(of) + 1))
    for name, r in of.items():
        # every target is visited, at most one level further down; a page comes from the level above
        assert all(of[t].level <= r.level + 1 for t in wild[name])
        assert name == names[0] or any(name in wild[p] and of[p].level == r.level - 1 for p in of)
    assert sorted(of.values(), key=lambda r: r.visit_no) == sorted(of.values(), key=lambda r: (r.level, r.visit_no))
    limited = link_reach(starts, table, None, 20).collect()
    assert visits(limited, "b") == visits(rows, "b")[:20] and len(visits(limited, "a")) == 20


def test_a_long_chain_ends(spark, monkeypatch):
    """45 levels, each page also linking back; a branch at level 10 that is found again later.

    Keys are replaced by ranks and tables merged every few jobs.
    """
    monkeypatch.setattr(reach, "RANK_AFTER", 8)
    monkeypatch.setattr(reach, "MERGE_AFTER", 2)
    page = lambda i: f"https://c.test/{i:04d}"
    graph = {page(i): [page(max(i - 1, 0)), page(i + 1), page(0)] for i in range(45)}
    graph[page(10)] = [page(11), page(9000), page(12)]
    graph[page(9000)] = [page(13), page(9001)]
    table = spark.createDataFrame(edge_rows("c", graph), EDGE)
    starts = spark.createDataFrame([("c", page(0))], "site string, start_url string")
    order, queue, seen = [], [page(0)], {page(0)}
    while queue:
        order.append(queue.pop(0))
        for target in graph.get(order[-1], []):
            if target not in seen:
                seen.add(target)
                queue.append(target)
    rows = link_reach(starts, table).collect()
    assert visits(rows, "c") == order and max(r.level for r in rows) == 44
    assert visits(link_reach(starts, table, None, 17).collect(), "c") == order[:17]


def test_reach_from_a_start_url_with_a_query(spark):
    table = spark.createDataFrame([
        ("s", "https://s.test/?utm=1", 0, "https://s.test/a", "https://s.test/a", True),
        ("s", "https://s.test/a", 0, "https://s.test/b", "https://s.test/b", True)], EDGE)
    starts = spark.createDataFrame([("s", "https://s.test/?utm=1")], "site string, start_url string")
    assert visits(link_reach(starts, table).collect(), "s") == [
        "https://s.test/", "https://s.test/a", "https://s.test/b"]


def test_blocked_start_blocks_the_site(spark):
    pages = spark.createDataFrame(
        [("a", "https://a.test/", "https://b.test/x"), ("b", "https://b.test/", "https://b.test/x"),
         ("b", "https://b.test/", "https://a.test/x")], "site string, start_url string, url string")
    closed = spark.createDataFrame([("a.test", "*", 0, False, "/")], schemas.ROBOTS_RULES)
    assert [tuple(r)[::2] for r in allowed_pages(pages, closed).select(*pages.columns).collect()] == [("b", "https://b.test/x")]
    assert allowed_pages(pages, closed, respect_robots=False).count() == 3
    starts = spark.createDataFrame([("a", "https://a.test/")], "site string, start_url string")
    edges = spark.createDataFrame([("a", "https://a.test/", 0, "https://a.test/x", "https://a.test/x", True)], EDGE)
    robots = spark.createDataFrame([("a.test", "*", 0, False, "/")], schemas.ROBOTS_RULES)
    assert link_reach(starts, edges, robots).count() == 0
    assert link_reach(starts, edges).count() == 2


def first_fit(rules, target):
    """The verdict of the first rule whose prefix fits, by a plain loop over all of them."""
    for _, _, _, allow, prefix in sorted(rules, key=lambda r: r[2]):
        if prefix == "*" or target.startswith(prefix):
            return True if prefix == "" else allow
    return True


def test_many_rules_agree_with_a_plain_loop(spark):
    draw = random.Random(5)
    word = lambda least, most: "/" + "".join(draw.choice("ab/?") for _ in range(draw.randint(least, most)))
    rules = [("s.test", "*", i, draw.random() < 0.5, word(2, 7)) for i in range(300)]
    rules += [("s.test", "*", 300, False, "*"), ("s.test", "*", 301, True, "/"), ("e.test", "*", 0, False, ""),
              ("n.test", "*", 0, False, None), ("n.test", "*", None, None, "/b")]
    rules += [("s.test", "otherbot", 0, False, "/"), (None, "*", 0, False, "/")]
    targets = [word(0, 12) for _ in range(400)]
    urls = [f"https://s.test{t}" for t in targets] + ["https://e.test/x", "https://n.test/a", "https://n.test/b", None, ""]
    own = [r for r in rules if r[0] == "s.test" and r[1] == "*"]
    want = [first_fit(own, t) for t in targets] + [True] * 5
    assert 50 < sum(want) < 350
    # rows that repeat stay, columns with the names used inside as well
    df = spark.createDataFrame([(u, i, "mine", "x") for i, u in enumerate(urls)], "url string, host int, open string, prefix string")
    got = with_robots(df.union(df), spark.createDataFrame(rules, schemas.ROBOTS_RULES))
    assert got.columns == ["url", "host", "open", "prefix", "allowed"]
    assert sorted((r.host, r.allowed) for r in got.collect()) == sorted(2 * list(enumerate(want)))
    assert robots_allowed(df, spark.createDataFrame([], schemas.ROBOTS_RULES)).count() == len(urls)
    assert robots_allowed(df.limit(0), spark.createDataFrame(rules, schemas.ROBOTS_RULES)).count() == 0


def test_a_url_is_looked_up_as_often_with_ten_thousand_rules_as_with_three(spark):
    few = [("s.test", "*", i, False, p) for i, p in enumerate(["/aaaaa", "/bbbbb", "/ccccc"])]
    many = [("s.test", "*", i, False, f"/{i:05d}") for i in range(10_000)]
    asked = spark.createDataFrame([(f"https://s.test/{i:05d}/x",) for i in range(0, 20_000, 40)], "url string")
    plans = []
    for rules, blocked in ((few, 0), (many, 250)):
        found = verdicts(asked, spark.createDataFrame(rules, schemas.ROBOTS_RULES))
        assert found.where("not open").count() == blocked
        plans.append(host_rules(spark.createDataFrame(rules, schemas.ROBOTS_RULES)).select(
            F.length("prefix")).distinct().count())
    assert plans == [1, 1]


def test_runs_tell_which_sites_respect_robots(spark):
    pages = spark.createDataFrame(
        [(s, f"https://{s}.test/", f"https://{s}.test/{p}") for s in "abc" for p in "xy"], "site string, start_url string, url string")
    rules = spark.createDataFrame([(f"{s}.test", "*", 0, False, "/x") for s in "abc"], schemas.ROBOTS_RULES)
    runs = spark.createDataFrame([("a", None, 1.0, False), ("a", None, 2.0, False), ("b", None, None, None)], schemas.CRAWL_RUNS)
    got = sorted((r.site, r.url[-1]) for r in allowed_by_run(pages, rules, runs).collect())
    assert got == [("a", "x"), ("a", "y"), ("b", "y"), ("c", "y")]
