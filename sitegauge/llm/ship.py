"""Gives the executors this package, so that their Python workers can import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import sitegauge

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source to the application, once; Spark hands it to every executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(sitegauge.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="sitegauge-"), "sitegauge.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("sitegauge", os.path.relpath(path, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
