import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitegauge import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staged")))
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def crawl(spark):
    """Build a crawl table from short dicts; absent keys get plain defaults."""

    def build(*rows):
        defaults = {"site": "s", "start_url": "https://s.test/", "status_code": 200,
                    "content_type": "text/html", "load_time": 1.0, "error": None, "html": None}
        full = []
        for i, row in enumerate(rows):
            merged = {**defaults, "ord": i, "url": f"https://s.test/about/{i}", **row}
            full.append(tuple(merged[f.name] for f in schemas.CRAWL_PAGES.fields))
        return spark.createDataFrame(full, schemas.CRAWL_PAGES)

    return build
