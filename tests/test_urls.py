import random
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from sitegauge.functions import urls as U

URLS = ["https://a.test", "https://a.test/", "http://www.a.test:80/x/y.html?q=1#f", "https://a.test/x;p?q",
        "https://a.test//x//y/", "https://u@a.test/my_page", "mailto:x@y", "//a.test/z", "rel/path", "",
        "https://a.test/Shop-Now/1", "https://a.test/foo2bar/x", "https://a.test/o'neil_x/", "https://a.test/author",
        "https://a.test/postage", "https://a.test/capital", "https://a.test/shopping-cart", "https://a.test/my_page",
        "https://a.test/ÉCOLE-été/1", "https://a.test/?login", "https://a.test/#login"]


def rows(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, url string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_parts_agree_with_urllib(spark):
    got = rows(spark, URLS, U.host(F.col("url")), U.path(F.col("url")), U.depth(F.col("url")), U.clean_url(F.col("url")))
    for url, (host, path, _, _) in zip(URLS, got):
        parsed = urlparse(url)
        assert host == parsed.netloc, url
        assert path == parsed.path, url
    assert [depth for _, _, depth, _ in got] == [0, 0, 2, 1, 2, 1, 1, 1, 2, 0, 2, 2, 1, 1, 1, 1, 1, 1, 2, 0, 0]
    cut = {2: "http://www.a.test:80/x/y.html", 3: "https://a.test/x;p", 19: "https://a.test/", 20: "https://a.test/"}
    assert [clean for _, _, _, clean in got] == [cut.get(i, url) for i, url in enumerate(URLS)]


def test_module_examples(spark):
    got = dict(zip(URLS, (m for m, in rows(spark, URLS, U.module_of("url")))))
    assert got["https://a.test"] == got["https://a.test/?login"] == "Homepage"
    assert got["https://a.test/author"] == "Authentication"
    assert got["https://a.test/postage"] == "Blog/Content"
    assert got["https://a.test/capital"] == "API"
    assert got["https://a.test/shopping-cart"] == "Cart"
    assert got["https://a.test/my_page"] == "My Page"
    assert got["https://a.test/foo2bar/x"] == "Foo2Bar"
    assert got["https://a.test/o'neil_x/"] == "O'Neil X"
    assert got["https://a.test/ÉCOLE-été/1"] == "École Été"


def test_seed_urls(spark):
    values = ["  example.com ", "http://x.test/a", "https:///path", "https://[::1", "ftp://x"]
    got = [r[0] for r in rows(spark, values, U.seed_url(F.col("url")))]
    assert [(r.is_valid, r.url) for r in got] == [
        (True, "https://example.com"), (True, "http://x.test/a"), (False, "https:///path"),
        (False, "https://[::1"), (True, "https://ftp://x")]
    assert got[2].error == "Invalid URL — no domain found."
    assert got[3].error == "Could not parse the URL."


def test_same_domain(spark):
    values = ["https://a.test/", "https://www.a.test/", "https://shop.a.test/", "https://xa.test/", "https://a.test.b/"]
    got = [r[0] for r in rows(spark, values, U.is_same_domain(F.col("url"), F.lit("a.test")))]
    assert got == [True, True, True, False, False]


def test_resolution_agrees_with_urllib(spark):
    rng = random.Random(7)
    pieces = ["", "/", "a", "b/c", "../", "./", "..", ".", "?q=1", "?", "#f", "#", "//h.test/p", "https://h.test",
              "https:x", "http:/y", "ftp://z", "x:y", ";p", "a//b", "%20", "é"]
    hrefs = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    hrefs = [h for h in hrefs if not h.startswith("#") and "://" not in h[8:] and not h.startswith("///")]
    for base in ("https://s.test/", "https://s.test", "https://s.test/d/e?k=v", "https://s.test/d/e/"):
        df = spark.createDataFrame([(i, [h], base) for i, h in enumerate(hrefs)], "i int, h array<string>, base string")
        got = [r[1] for r in df.select("i", U.resolve_all("h", "base")).orderBy("i").collect()]
        for href, urls in zip(hrefs, got):
            full = urljoin(base, href)
            expected = [full] if urlparse(full).scheme in ("http", "https") else []
            assert urls == expected, (base, href)
