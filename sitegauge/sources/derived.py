"""Crawl tables derived by arithmetic from a table of (page_id, url, html).

The given pages carry no fetch status, load time or link checks, so those columns
are computed from ``page_id``: every page of the input takes part, and the derived
tables grow with it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = ["about", "login", "checkout", "cart", "orders", "dashboard", "my-account", "search",
            "products", "blog", "help", "api", "privacy", "team_page"]
STATUS_CYCLE = [200, 404, 200, 403, 200, 500, 0, 200, 410, 200, 503, 200, 200]


def _pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _page_path(x: str) -> str:
    sections = ", ".join(f"'{s}'" for s in SECTIONS)
    return (f"if({x} < 100 and {x} % 20 = 0, '', "
            f"concat(element_at(array({sections}), cast({x} % 14 + 1 as int)), '/', {x}))")


# links to two pages of the same site: in the same block of 20 and in a later hundred
_NEAR = "(page_id - page_id % 20 + (page_id % 20 * 3 + 1) % 20)"
_FAR = ("((page_id - page_id % 20) % 100 + (page_id div 100 * 2 + page_id % 2) * 100"
        " + (page_id % 20 * 7 + 2) % 20)")

_EXTRA_HTML = [
    "repeat('<img src=\"a.png\">', cast(page_id % 8 as int))",
    "repeat('<img src=\"b.png\" alt=\"ok\">', cast(page_id % 3 as int))",
    "case page_id % 5 when 0 then '<form action=\"/f\" method=\"post\"><input name=\"a\"></form>'"
    " when 1 then '<form action=\"/g\"><input type=\"email\"></form>' else '' end",
    "if(page_id % 4 <> 0, '<meta name=\"description\" content=\"d\">', '')",
    "if(page_id % 3 <> 0, '<meta name=\"viewport\" content=\"width=device-width\">', '')",
    "if(page_id % 2 = 0, '<link rel=\"canonical\" href=\"/c\">', '')",
    "if(page_id % 6 = 0, '<meta property=\"og:title\" content=\"t\">', '')",
    "if(page_id % 9 = 0, '<h1>second</h1>', '')",
    "if(page_id % 7 < 3, concat('<a href=\"https://ext-', page_id % 97, '.test/x?y=1\">e</a>',"
    " '<a href=\"//ext-', page_id * 3 % 13, '.test/x#top\">f</a>'), '')",
    f"concat('<a href=\"/', {_page_path(_NEAR)}, '\">n</a>')",
    f"concat('<a href=\"/', {_page_path(_FAR)}, '\">n</a>')",
]


def crawl_pages(pages: DataFrame) -> DataFrame:
    """Crawl table of five sites over all given pages."""
    failed = "(page_id % 31 = 3 or page_id % 37 = 11)"
    site = "concat('site-', page_id div 20 % 5)"
    start = f"concat('https://', {site}, '.test/')"
    body = ("case when page_id % 10 = 3 then"
            " replace(replace(html, '<h1>', '<h5>'), '</h1>', '</h5>')"
            " when page_id % 11 = 4 then"
            " replace(replace(html, '<title>', '<b>'), '</title>', '</b>') else html end")
    return pages.selectExpr(
        f"{site} as site",
        f"{start} as start_url",
        "page_id as ord",
        f"concat({start}, {_page_path('page_id')}) as url",
        f"case when {failed} then null when page_id % 23 = 5 then 404"
        " when page_id % 29 = 7 then 500 else 200 end as status_code",
        "if(page_id % 41 = 9, 'application/pdf', 'text/html; charset=utf-8') as content_type",
        f"if({failed}, null, cast(page_id * 7919 % 7000 as double) / 1000) as load_time",
        "case when page_id % 31 = 3 then 'timeout'"
        " when page_id % 37 = 11 then 'connection_error' end as error",
        f"if({failed}, null, concat({', '.join([body, *_EXTRA_HTML])})) as html")


def typed_urls(pages: DataFrame) -> DataFrame:
    """URLs as a user may type them: without scheme, with spaces, without a host."""
    pid = F.col("page_id")
    bare = F.regexp_replace("url", "^https?://", "")
    return pages.select("page_id", F.when(pid % 5 == 1, bare)
                        .when(pid % 5 == 2, F.concat(F.lit("  "), bare, F.lit(" ")))
                        .when(pid % 11 == 3, F.lit("https:///nowhere"))
                        .when(pid % 13 == 4, F.concat(F.lit("["), bare))
                        .otherwise(F.col("url")).alias("raw_url"))


def scoring_inputs(issues: DataFrame) -> DataFrame:
    """Scoring rows from an issue table; modules whose name has 7 or 14 letters become unseen."""
    unseen = F.length("module") % 7 == 0
    return issues.select(
        F.when(unseen, F.concat(F.lit("New "), F.col("module"))).otherwise(F.col("module"))
        .alias("module"), "issue_type", "occurrences",
        F.col("fix_time_hours").alias("fix_time"), "severity")


def link_status(external: DataFrame) -> DataFrame:
    """Check result for every distinct external link, from the number in its host."""
    number = F.regexp_extract("url", r"ext-(\d+)", 1).cast("int")
    return external.select(
        F.col("dst_clean").alias("url")).distinct().select(
        "url", _pick(number % 13, STATUS_CYCLE).alias("status"))


def robots_rules(crawl: DataFrame) -> DataFrame:
    """Three rules for every host of the crawl and one site blocked for another agent."""
    from sitegauge.functions.urls import host

    rules = F.array(
        _rule("*", 0, True, "/help/10"), _rule("*", 1, False, "/help"),
        _rule("*", 2, False, "/privacy"), _rule("otherbot", 3, False, "/"))
    return (crawl.select(host(F.col("start_url")).alias("host")).distinct()
            .select("host", F.inline(rules)))


def crawl_runs(crawl: DataFrame) -> DataFrame:
    """Four runs per site of the crawl: its own, which lasted as long as its pages took, one
    of a page that robots rules block, one that ignores the rules, and one without a host.

    The last site's own run tells nothing, and the one before did not respect the rules.
    """
    number = F.substring_index("site", "-", -1)
    seconds = F.round(F.sum(F.col("load_time").cast("decimal(18,3)")), 2).cast("double")
    own = crawl.groupBy("site", "start_url").agg(seconds.alias("crawl_seconds"))

    def run(suffix: str, url: Column, took: Column, respects: Column) -> Column:
        return F.struct(F.concat(F.col("site"), F.lit(suffix)).alias("site"), url.alias("start_url"),
                        took.cast("double").alias("crawl_seconds"), respects.alias("respect_robots"))

    told = lambda x: F.when(number != "4", x)
    private = F.concat("start_url", F.lit("privacy"))
    return own.select(F.inline(F.array(
        run("", F.col("start_url"), told(F.col("crawl_seconds")), told(number != "3")),
        run("-private", private, F.lit(0.25), F.lit(True)),
        run("-ignoring", private, F.lit(0.5), F.lit(False)),
        run("-nowhere", F.lit("https:///nowhere"), F.lit(None), F.lit(True)))))


def _rule(agent: str, order: int, allow: bool, prefix: str) -> Column:
    return F.struct(F.lit(agent).alias("agent"), F.lit(order).alias("rule_order"),
                    F.lit(allow).alias("allow"), F.lit(prefix).alias("prefix"))


def drawn(issues: DataFrame) -> DataFrame:
    """Predictions and clusters drawn from a hash of the issue, for the reports over them."""
    key = F.concat_ws("|", "site", "module", "issue_type")
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(key), 1, 1)) - 1
    label = F.col("is_critical")
    return issues.withColumns({
        "doc_id": key, "label": label, "cluster": digit % 3, "confidence": 0.5 + digit / 32,
        "predicted": F.when(digit < 12, label).otherwise(1 - label)})


#: Size of the drawn forest; with eight trees the mean of its shares is exact.
DRAWN_TREES, DRAWN_DEPTH = 8, 3


def drawn_nodes(issues: DataFrame) -> DataFrame:
    """Trees drawn by hash over the issues' feature values, in the form of a fitted forest's nodes.

    A test compares with a share of the largest value of its feature.
    """
    inner = 2 ** DRAWN_DEPTH - 1
    place = F.concat_ws("|", "tree", "node")
    digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(place), k, 1)) - 1
    largest = issues.agg(
        (F.count_distinct("module") - 1).cast("double").alias("module"),
        (F.count_distinct("issue_type") - 1).cast("double").alias("issue_type"),
        F.max("occurrences").cast("double").alias("occurrences"),
        F.max("fix_time_hours").cast("double").alias("hours"), F.lit(3.0).alias("weight_max"))
    nodes = largest.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(DRAWN_TREES - 1))).alias("tree"),
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * inner))).alias("node"))
    is_inner = F.col("node") < inner
    top = F.get(F.array("module", "issue_type", "occurrences", "hours", "weight_max"), digit(1) % 5)
    child = lambda add: F.when(is_inner, 2 * F.col("node") + add).otherwise(-1)
    return nodes.select(
        "tree", "node", F.when(is_inner, digit(1) % 5).otherwise(-1).alias("feature"),
        F.when(is_inner, top * digit(2) / 16).alias("threshold"),
        child(1).alias("below"), child(2).alias("above"), ((digit(3) + 1) / 32).alias("gain"),
        (digit(4) + 1.0).alias("weight"), (1 - digit(5) / 16).alias("share_0"), (digit(5) / 16).alias("share_1"))
