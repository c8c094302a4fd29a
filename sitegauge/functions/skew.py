"""Exact per-group selection that never gathers a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.session import stage

#: Parts that the rows of a group are dealt into where they meet its one row.
PARTS = 64


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """First ``n`` rows of every group, numbered from 1 in column ``rank``.

    ``n`` is a small constant of the report, so Spark's window group limit keeps at
    most ``n`` rows per group and task before the shuffle, whatever the group's size.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def with_group_row(df: DataFrame, of_group: DataFrame, key: str, dealt_by: Column, how: str = "inner") -> DataFrame:
    """Rows of ``df`` joined with the one row of their group, without gathering a group.

    Spark knows the size of the staged rows of the groups: few are broadcast, and for
    many the rows of a group are dealt into ``PARTS`` by ``dealt_by`` before they meet.
    """
    parts = stage(of_group.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), "group-rows")
    dealt = df.withColumn("_part", F.pmod(dealt_by, F.lit(PARTS)).cast("int"))
    return dealt.join(parts, [key, "_part"], how).drop("_part")


def number_per_group(df: DataFrame, keys: list[str], chunk: Column, order: list[Column],
                     name: str) -> DataFrame:
    """Number the rows of every group from 1, in order, in bounded pieces.

    ``chunk`` must grow with ``order`` inside a group and hold a bounded number of
    rows. Rows are counted per chunk, the counts are summed up over the chunks of a
    group, and rows are numbered inside their chunk only.
    """
    chunked = df.withColumn("_chunk", chunk)
    counts = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (chunked
            .withColumn("_row", F.row_number().over(inside))
            .join(offsets, [*keys, "_chunk"])
            .withColumn(name, (F.col("_before") + F.col("_row")).cast("long"))
            .drop("_chunk", "_row", "_before"))


def number_in_order(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of every group from 1 by the columns ``order``, whatever a group's size.

    The rows are range-partitioned by keys and order and staged with their partition,
    which is the chunk: it grows with the order and holds a bounded number of rows.
    """
    ranged = stage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    return number_per_group(ranged, keys, F.col("_part"), [F.col(c) for c in order], name).drop("_part")
