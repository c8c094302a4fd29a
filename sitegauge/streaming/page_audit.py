"""The page rules on a streaming crawl table.

Features and page issues are stateless columns, so the batch operators apply as they
are; no watermark or state is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sitegauge import schemas
from sitegauge.operators.features import page_features
from sitegauge.operators.issues import page_issues
from sitegauge.sources.crawl import keep_html_only


def read_crawl_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.CRAWL_PAGES).parquet(path)


def write_issue_stream(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the issues of arriving pages to a parquet table and stop when caught up."""
    found = page_issues(page_features(keep_html_only(pages)))
    return (found.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))
