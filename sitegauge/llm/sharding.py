"""Weighted rendezvous sharding of records by a stable key, with DataFrame functions only.

Every shard draws a number for every key: u in (0, 1) from the MD5 of ``key:shard``, and
the score ln(u) / weight. The shard of the highest score takes the record, so a shard
gets records in proportion to its weight. A shard that is added draws new numbers but
changes no other score, so it takes records only into itself; one that is removed gives
away its own only; a changed weight moves records to or from that shard only. Nothing
but the key, the shard's name and its weight decides: no table of places is kept, and
any engine with MD5 finds the same place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.numbering import number_rows
from sitegauge.session import stage

SHARDS = 16
#: Hexadecimal digits of the MD5 that are read as a number; a double holds them exactly.
_DIGITS = 13
#: Stands for a null key.
_NO_KEY = "-"


def _score(key: Column, shard: int, weight: float) -> Column:
    drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, _DIGITS), 16, 10).cast("double")
    return F.log((drawn + 0.5) / float(16 ** _DIGITS)) / F.lit(float(weight))


def _best(key: Column, weights: Sequence[float]) -> Column:
    """(score, -shard) of the shard that takes the key; of equal scores the lower shard."""
    drawn = [F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("minus"))
             for i, w in enumerate(weights) if w > 0]
    if not drawn:
        raise ValueError("at least one shard must have a weight above 0")
    return F.greatest(*drawn) if len(drawn) > 1 else drawn[0]


def key_of(column: str) -> Column:
    """The record key as text; rows with a null key share one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(_NO_KEY))


def assign(records: DataFrame, weights: Sequence[float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """Adds the shard, from 0, of every record. A shard of weight 0 takes nothing."""
    return records.withColumn(name, -_best(key_of(key), weights)["minus"])


def moves(records: DataFrame, before: Sequence[float], after: Sequence[float], key: str = "doc_id") -> DataFrame:
    """Keys, ``from_shard`` and ``to_shard`` of the records that a change of the weights moves."""
    placed = assign(assign(records.select(key), before, key, "from_shard"), after, key, "to_shard")
    return placed.where("from_shard <> to_shard")


def write_shards(records: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id") -> None:
    """Writes the records as Parquet, one folder ``shard=i`` for every shard that holds any."""
    assign(records, weights, key).write.partitionBy("shard").parquet(path)


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot and grown_shard, over ``n`` equal shards.

    ``size`` is one more than the UTF-8 bytes of the text, ``slot`` the row's number from
    0 in its shard by doc_id, and ``grown_shard`` its shard were there one more. A null
    text has no bytes: size 1 and checksum 0, like an empty one. Rows that share a doc_id
    share a shard; so do rows with a null one, which come first in it. Rows that tie in
    doc_id have their slots by checksum and size; beyond that they are equal rows. An
    empty table gives an empty result; other columns are ignored.
    """
    key = key_of("doc_id")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    drawn = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key")).select(
        "doc_id", "size", "text_crc32", _best(F.col("key"), [1.0] * n).alias("best"),
        _score(F.col("key"), n, 1.0).alias("newcomer"))
    placed = stage(drawn.select(
        "doc_id", "size", "text_crc32", (-F.col("best.minus")).alias("shard"),
        F.when(F.col("newcomer") > F.col("best.score"), F.lit(n)).otherwise(-F.col("best.minus")).alias("grown_shard")),
        "shards")
    return number_rows(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", "rows").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
