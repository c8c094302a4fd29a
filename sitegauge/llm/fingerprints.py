"""Document fingerprints by one-permutation MinHash with optimal densification.

Every shingle of five words is hashed once. The top bits of the hash choose one of
``BINS`` bins and the bin keeps the least hash that falls into it. An empty bin
copies a filled one, which a random order of the bins, fixed per empty bin, finds
first, so that all bins of two texts agree with the probability of their Jaccard
similarity. Of every bin only the low ``BITS`` bits are stored, packed and written in
hexadecimal. Two unequal bins share these bits with probability ``2**-BITS``, which
``likeness`` takes out again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm import words

SHINGLE_WORDS = 5
BINS = 512
BITS = 4

_EMPTY = np.uint64(2**64 - 1)
_ORDER = np.argsort(np.random.default_rng(22).random((BINS, BINS)), axis=1).astype(np.int32)
#: Makes the stored bits of bins that copied the same value independent of each other.
_BIN_SALT = np.random.default_rng(23).integers(0, 2**63, BINS, dtype=np.uint64)
_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def _minima(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of bins per text; a bin without a shingle holds _EMPTY."""
    hashes, counts = words.shingle_hashes(data, offsets, SHINGLE_WORDS)
    bins = np.full(len(counts) * BINS, _EMPTY, np.uint64)
    if len(hashes):
        cell = np.repeat(np.arange(len(counts)), counts) * BINS + (hashes >> _BIN_SHIFT).astype(np.int64)
        np.minimum.at(bins, cell, hashes)
    return bins.reshape(len(counts), BINS)


def _densify(bins: np.ndarray) -> np.ndarray:
    """Fill every empty bin of a text that has any shingle."""
    filled = bins != _EMPTY
    row, column = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out = bins.copy()
    for turn in range(BINS):
        if not len(row):
            break
        source = _ORDER[column, turn]
        found = filled[row, source]
        out[row[found], column[found]] = bins[row[found], source[found]]
        row, column = row[~found], column[~found]
    return out


def sketch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of every bin, one row per text, and which texts have a shingle at all."""
    data, offsets = words.bytes_of(texts)
    low = np.zeros((len(texts), BINS), np.uint8)
    some = np.zeros(len(texts), bool)
    for first, last in words.pieces(offsets):
        part = offsets[first:last + 1]
        bins = _densify(_minima(data[part[0]:part[-1]], part - part[0]))
        some[first:last] = bins[:, 0] != _EMPTY
        low[first:last] = (words.mix(bins ^ _BIN_SALT) & np.uint64(2**BITS - 1)).astype(np.uint8)
    low[~some] = 0
    return low, some


def pack(low: np.ndarray, some: np.ndarray) -> list[str]:
    """Hexadecimal text of the packed bits; of a text without words, the empty string."""
    pairs = (low[:, 0::2] << BITS) | low[:, 1::2]
    return [row.tobytes().hex() if there else "" for row, there in zip(pairs, some)]


def likeness(low_a: np.ndarray, some_a: np.ndarray, low_b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity row by row, 0 to 1; 1 for two texts without words, 0 for one."""
    chance = 2.0 ** -BITS
    equal = (low_a == low_b).mean(axis=1)
    estimate = np.clip((equal - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, estimate, (some_a == some_b).astype(float))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and, inside it, in document order, ghosts last.

    The last row of a batch waits for the next one, which may hold its successor.
    """
    names = [part.split()[0] for part in RESULT.split(", ")]
    waiting = None
    for batch in words.slices(batches):
        table = pa.table(batch.columns, names=batch.schema.names)
        if waiting is not None:
            table = pa.concat_tables([waiting, table]).combine_chunks()
        waiting = table.slice(len(table) - 1)
        if len(table) < 2:
            continue
        texts = [t or "" for t in table["text"].to_pylist()]
        ids, buckets = table["doc_id"].to_pylist(), table["bucket"].to_pylist()
        ghosts = table["ghost"].to_pylist()
        rows = [i for i in range(len(texts) - 1) if not ghosts[i] and buckets[i] == buckets[i + 1]]
        if not rows:
            continue
        edited = [_edited(texts[i], texts[i + 1]) for i in rows]
        own, own_some = sketch(pa.array(texts, pa.large_string()))
        new, new_some = sketch(pa.array(edited, pa.large_string()))
        at, after = np.array(rows), np.array(rows) + 1
        yield pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i in rows], pa.int64()),
            pa.array([len(texts[i]) for i in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(pack(own[at], own_some[at])),
            pa.array(pack(new, new_some)),
            pa.array(likeness(own[at], own_some[at], new, new_some)),
            pa.array(likeness(own[at], own_some[at], own[after], own_some[after])),
        ], names=names)


def in_neighbour_buckets(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents in buckets of neighbouring ids, each followed by the next bucket's first row.

    The order is descending ``doc_id``, null last, equal ids by text. There are as many
    buckets as shuffle partitions; their limits are approximate quantiles of the ids.
    The first row of every bucket is added to the bucket before it as a ghost, and the
    very first one to the last, so that every row's successor stands in its own bucket.
    What reaches the driver is one id per shuffle partition. Returns the rows with
    columns bucket and ghost, and the number of buckets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / wanted for i in range(1, wanted)] or [0.5]
    found = docs.agg(F.percentile_approx("doc_id", steps, 10 * wanted).alias("e")).first()["e"]
    edges = np.array(sorted(set(found or [])), np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        # bucket 0 holds the largest ids; null goes to one after the least
        above = len(edges) - np.searchsorted(edges, ids.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(ids.isna(), len(edges) + 1, above))

    bucket = bucket_of("doc_id")
    placed = docs.withColumn("bucket", bucket).withColumn("ghost", F.lit(False))
    heads = {r["bucket"]: r["head"] for r in docs.select("doc_id").distinct().withColumn("bucket", bucket)
             .groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    if not heads:
        return placed, 1
    order = sorted(heads)
    ghost_of = spark.createDataFrame([(heads[b], order[i - 1]) for i, b in enumerate(order)],
                                     "head long, target int")
    ghosts = (docs.join(F.broadcast(ghost_of), F.col("doc_id").eqNullSafe(F.col("head")))
              .select("doc_id", "text", F.col("target").alias("bucket"), F.lit(True).alias("ghost")))
    return placed.unionByName(ghosts), order[-1] + 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, with their likeness.

    Input columns ``doc_id`` and ``text``; others are ignored. A null text counts as
    empty. A text without words has the empty string as fingerprint; it is like another
    such text (1.0) and unlike any other (0.0). Rows that share a ``doc_id`` are each
    fingerprinted and follow one another by text. With a single row, its successor is
    itself. An empty table gives an empty result.
    """
    placed, n = in_neighbour_buckets(docs)
    laid = (placed.repartitionById(n, F.col("bucket"))
            .sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), "text"))
    return laid.mapInArrow(_fingerprint_rows, RESULT)
