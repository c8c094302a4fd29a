"""Crawl input tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge import schemas


def read_crawl_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan a crawl table with the declared schema; HTML is kept for text/html only."""
    return keep_html_only(spark.read.format(fmt).schema(schemas.CRAWL_PAGES).load(path))


def read_link_status(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.LINK_STATUS).load(path)


def read_robots_rules(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.ROBOTS_RULES).load(path)


def read_crawl_runs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.CRAWL_RUNS).load(path)


def keep_html_only(pages: DataFrame) -> DataFrame:
    """Drop the body of pages whose content type is not text/html, whatever the status."""
    return pages.withColumn(
        "html", F.when(F.contains(F.col("content_type"), F.lit("text/html")), F.col("html")))
