import os
import re

import numpy as np
import pytest

from sitegauge.llm import url_trust

SF = "/root/testdata/sf0.001"


def parts(url):
    m = re.search("://", url or "")
    if not m:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[m.end():]).groups()
    return re.sub("[A-Z]", lambda x: x.group().lower(), host), path


def rule_of(host, path, rules):
    fit = [(len(h + p), h + p, says) for says, h, p in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def domain(host):
    return "" if re.fullmatch(r"[0-9.:]*", host) else ".".join(host.split(".")[-2:]) if "." in host.strip(".") else ""


def brute(pages, rules):
    """Rows of (page_id, host, path, rule, verdict) with dense matrices."""
    rows, weight = [], {}
    for page_id, url, html in pages:
        host, path = parts(url)
        rows.append((page_id, host, path, *rule_of(host, path, rules)))
        for target in {m.lower() for m in re.findall(r"(?i)href=\"(?:https?:)?//([^/?#\"]+)", html or "")}:
            weight[host, target] = weight.get((host, target), 0) + 1
    hosts = {h for e in weight for h in e} | {r[1] for r in rows}
    for h in list(hosts):
        for e in ((h, domain(h)), (domain(h), h)):
            weight[e] = weight.get(e, 0) + 1
    weight = {e: w for e, w in weight.items() if e[0] != e[1] and all(e)}
    names = sorted({h for e in weight for h in e} | {r[1] for r in rows if r[1]})
    at = {h: i for i, h in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for (a, b), w in weight.items():
        m[at[a], at[b]] = w
    share = {says: np.array([np.mean([r[4] == says for r in rows if r[1] == h] or [0.0]) for h in names])
             for says in ("allow", "block")}
    norm = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300)

    def walk(p, start):
        rank = start
        for _ in range(url_trust.STEPS):
            rank = 0.15 * start + 0.85 * (rank @ p)
        return rank

    one = np.ones(len(names))
    trust = walk(norm(m), share["allow"]) / walk(norm(m), one)
    distrust = walk(norm(m.T), share["block"]) / walk(norm(m.T), one)
    out = []
    for page_id, host, path, rule, says in rows:
        bad = host in at and distrust[at[host]] > 0.5 and distrust[at[host]] > trust[at[host]]
        out.append((page_id, host, path, rule, says or ("block" if bad else "allow")))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


PAGES = [(1, "http://WWW.Example.com/en/1?x#y", '<a href="http://good.org/x">'), (2, "https://blog.example.com/en/2", ""),
         (3, "http://a.example.com/de/", '<A class="b" HREF="//Spam.biz/1"><a href="/rel">'), (4, "http://bad.net/es/1", None),
         (5, "http://bad.net/fr/1", '<a href="http://bad.net/x"><a href="http://friend.org">'), (6, "http://bad.net/fr/2", ""),
         (7, "http://bad.net/de/1", ""), (8, "http://links.org/a", '<a href="http://bad.net/">' * 3),
         (9, "http://friend.org", ""), (10, None, None), (None, "no scheme", ""), (11, "", ""), (12, "http://1.2.3.4:80/fr/", ""),
         (13, "http://net/es/", ""), (14, "ftp://user@x.NET:21/es/q", ""), (15, "http://com?x=1", ""), (16, "http://co.uk.com", ""),
         (16, "http://co.uk.com", ""), (17, "x://y://z.net/es/", "<a href=" + "a" * 50_000), (18, "http://spam.biz/p\n/q", "<a " * 20_000),
         (19, "http://notexample.com/en/", ""), (20, "://only.net/es/", ""),
         *[(30 + i, f"http://worse.net/es/{i}", "") for i in range(9)], (40, "http://worse.net/en/", ""),
         (41, "http://fan.org/", '<a href="https://worse.net/es/1">')]


def test_against_matrices(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, host string")
    want = brute(PAGES, url_trust.RULES)
    assert found(url_trust.judge(pages.repartition(3))) == want
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}
    assert url_trust.judge(pages.where("false")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert found(url_trust.judge(pages)) == brute([tuple(r) for r in pages.collect()], url_trust.RULES)


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string")
    plan = url_trust.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
