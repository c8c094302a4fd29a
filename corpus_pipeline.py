"""Corpus pipeline: from raw documents to the token digests of a mixed training set.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept;
its result is written as Parquet and read again as the next one's docs.

1. quality: documents that the Kneser-Ney classifier rejects go.
2. line_dedup: lines that an earlier document holds go.
3. near_dedup: of each group of near duplicates (five-word shingles, similarity 0.8) one document stays.
4. mixing: rows are repeated or dropped so that sources meet their target words.
5. bpe: each row that is left is encoded and decoded.

Each case of odd rows is defined by the operators' own descriptions; an empty table
passes every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm import bpe, line_dedup, mixing, near_dedup, quality
from sitegauge.llm.queries import tokenizer_file
from sitegauge.llm.ship import ship
from sitegauge.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.one_of_each(docs, near_dedup.FIVE_WORDS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.digests(docs, tokenizer_file())


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents), ("line_dedup", without_repeated_lines), ("near_dedup", without_near_duplicates),
    ("mixing", mixed), ("bpe", encoded)]

#: SQL can express neither the language model nor the rounding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
