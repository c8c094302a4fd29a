"""Gapless row numbers per group, in order, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.session import stage

#: The lower bits of ``monotonically_increasing_id``: a row's place in its partition.
_PLACE = (1 << 33) - 1


def number_rows(rows: DataFrame, group: str, order: list[str], name: str, total: str) -> DataFrame:
    """Adds each row's number from 0 in its group (``name``) and the group's size (``total``).

    Rows are range-partitioned by group and order and staged with their place in the
    partition; what the partitions hold of each group is counted and summed up, so only
    one count per partition and group meets in a task. Rows that tie in all of ``order``
    are told apart by their place in ``rows``, which must be a written table, so a tie of
    any length is split as well. ``group`` must not be null.
    """
    keys = [group, *order, "_at"]
    placed = stage(
        rows.withColumn("_at", F.monotonically_increasing_id())
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_at")
        .withColumns({"_part": F.spark_partition_id(),
                      "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}), "numbered")
    held = placed.groupBy("_part", group).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.select("_part", group, F.sum("_n").over(whole).alias(total),
                         (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (placed.join(shifts, ["_part", group])
            .withColumn(name, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift"))
