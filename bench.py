"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query starts from the raw tables and includes its own HTML scan and staged
tables. Two queries run first to warm the JVM; each is then timed once.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from sitegauge.plans import catalog  # noqa: E402
from sitegauge.session import RECOMMENDED_CONF  # noqa: E402

HEADLINE = [
    "page_features", "page_links", "broken_links", "robots_allowed", "link_reach", "issues_raw", "issue_ids", "issues",
    "health_scores", "module_risk", "module_cards", "crawl_summary", "category_table", "slowest_pages",
    "worst_pages", "tfidf_keywords", "document_keywords", "recommendations", "benchmarks",
    "train_test_split", "forest_report", "cluster_profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
               .config("spark.sql.shuffle.partitions", cpus))
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # the given tables are one small row group each, which Spark reads in one task; a large
    # table has splits enough, so only here the rows are dealt to all cores first
    read = catalog.given
    catalog.given = lambda spark, sf_dir, table: read(spark, sf_dir, table).repartition(int(cpus))
    registered = catalog.queries()
    run = lambda name: registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in ("module_risk", "tfidf_keywords"):
        run(name)
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
