"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm import (alignment, ann, bpe, fingerprints, licences, line_dedup, merkle, mixing, near_dedup, pii,
                           quality, sharding, url_trust)
from sitegauge.llm.ship import ship

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file() -> str:
    """Place of the public word-BPE file, read-only and never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def alignment_files() -> alignment.Files:
    """Places of the two public vocabularies that are aligned."""
    import public_tokenizers

    return alignment.Files(public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def over(*tables: str, run: Callable[..., DataFrame]) -> Query:
    """A query that applies ``run`` to whole given tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(*[spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables])

    return query


def queries() -> dict[str, Query]:
    return {
        "op1_pii": over("documents", run=pii.personal_data),
        "op2_licences": over("documents", run=licences.scan),
        "op3_fingerprints": over("documents", run=fingerprints.fingerprints),
        "op4_mixture": over("documents", run=mixing.mixture),
        "op5_line_dedup": over("documents", run=line_dedup.digests),
        "op6_quality": over("documents", "labels", run=quality.judged),
        "op7_url_trust": over("pages", run=url_trust.judge),
        "op8_bpe": over("documents", run=lambda docs: bpe.digests(docs, tokenizer_file())),
        "op11_sharding": over("documents", run=sharding.shards),
        "op12_alignment": over("documents", run=lambda docs: alignment.measures(docs, alignment_files())),
        "op13_manifest": over("documents", run=merkle.audited),
        "op10_neighbours": over("embeddings", run=ann.nearest),
        "op9_near_dedup": over("documents", run=near_dedup.near_duplicates),
    }
