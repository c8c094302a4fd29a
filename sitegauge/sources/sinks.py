"""Issue export."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge.functions.urls import base_domain


def export_rows(issues: DataFrame) -> DataFrame:
    """The nine export columns in their fixed order, with the site first."""
    return issues.select("site", *K.EXPORT_COLUMNS)


def write_issue_csv(issues: DataFrame, start_urls: DataFrame, path: str) -> None:
    """CSV with header, one folder per base domain (``domain=<base domain>``).

    Rows go out as they are partitioned; no site is gathered into one task.
    """
    domains = start_urls.select("site", base_domain(F.col("start_url")).alias("domain")).distinct()
    (export_rows(issues).join(domains, "site").select("domain", *K.EXPORT_COLUMNS)
     .write.partitionBy("domain").option("header", True).option("escape", '"').csv(path))
