"""Session settings and staged tables.

A job that needs the narrow result of the HTML pass more than once writes it to
a table in the cluster's shared checkpoint folder and reads it back. That scans
the HTML once, cuts the lineage, survives the loss of executors, and lets later
steps prune columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot join keys even where that costs one more shuffle downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # HTML decompresses to several times its file size
    "spark.sql.files.maxPartitionBytes": "64m",
}

def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for staged tables.

    It is the one named by ``spark.checkpoint.dir`` or set with ``setCheckpointDir``;
    where neither is given, as in tests, a folder of the warehouse, which all
    executors can reach as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Nothing reads the write's own shuffle files again, so they are removed with it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/sitegauge/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete a table that ``stage`` wrote; call it when all that reads it is written itself."""
    spark = staged.sparkSession
    files = staged.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage_steps(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for a plan of several equal steps, each of which is one shuffle or two.

    Adaptive execution would plan all steps anew after each of their shuffles, and
    numbered class names would have equal code compiled once per step.
    """
    conf = df.sparkSession.conf
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.useIdInClassName": "false"}
    before = {key: conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            conf.set(key, value)
        return stage(df, name)
    finally:
        for key, value in before.items():
            conf.set(key, value)
