"""Declared schemas of the input tables (no inference at read time)."""

from pyspark.sql import types as T

CRAWL_PAGES = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("start_url", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("load_time", T.DoubleType()),
    T.StructField("error", T.StringType()),
    T.StructField("html", T.StringType()),
])

LINK_STATUS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
])

ROBOTS_RULES = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("rule_order", T.IntegerType()),
    T.StructField("allow", T.BooleanType()),
    T.StructField("prefix", T.StringType()),
])

# one row per site that was asked for, whether pages came of it or not
CRAWL_RUNS = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("start_url", T.StringType()),
    T.StructField("crawl_seconds", T.DoubleType()),
    T.StructField("respect_robots", T.BooleanType()),
])

ISSUES = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("page_url", T.StringType()),
    T.StructField("module", T.StringType()),
    T.StructField("issue_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("occurrences", T.LongType()),
    T.StructField("fix_time_hours", T.DoubleType()),
    T.StructField("description", T.StringType()),
    T.StructField("source", T.StringType()),
])

SCORING_INPUT = T.StructType([
    T.StructField("module", T.StringType()),
    T.StructField("issue_type", T.StringType()),
    T.StructField("occurrences", T.IntegerType()),
    T.StructField("fix_time", T.DoubleType()),
    T.StructField("severity", T.StringType()),
])
