"""Removal of lines that an earlier document holds already, with DataFrame functions only.

Lines are compared by two 64-bit hashes of their key, which is the line with white
space stripped at both ends and A-Z lower-cased. The occurrences of a line are first
narrowed to at most ``SLOTS`` rows, each with the first document of a share of the
documents; so a line that stands in a third of all documents is as cheap as any other.
These rows are range-partitioned by hash and sorted by document inside, where a window
streams over them and takes the first occurrence. All lines of the first document
stay, so its positions need no order; those of the others make up the bitmaps.

The result is not text but a bitmap per document, compressed to run lengths: how many
lines to keep, how many to drop, and so on; what follows the last run is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_KEY_CHARS = 10
#: Rows that the occurrences of one line are narrowed to before they meet.
SLOTS = 64

SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null document number, which counts as the largest.
NO_ID = 2**63 - 1


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else left; the quick way where the text is all ASCII."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _identified(docs: DataFrame) -> DataFrame:
    """Adds what names a row in the bitmaps: document number and text hash."""
    return docs.withColumns({
        "_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
        "_text": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})


def occurrences(docs: DataFrame) -> DataFrame:
    """Hashes of every line whose key is long enough, with document and position."""
    key = lower_ascii(F.btrim("line", F.lit(SPACE)))
    return (_identified(docs)
            .select("_doc", "_text", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
            .select("_doc", "_text", "pos", key.alias("key"))
            .where(F.char_length("key") >= MIN_KEY_CHARS)
            .select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("second"), "key").alias("g"),
                    "_doc", "_text", "pos"))


def repeated_lines(found: DataFrame) -> DataFrame:
    """Hashes of the lines that stand in two documents or more, with the first document."""
    narrowed = (found.groupBy("h", "g", F.pmod(F.xxhash64("_doc"), F.lit(SLOTS)).alias("slot"))
                .agg(F.min("_doc").alias("first"), F.max("_doc").alias("last")))
    ranged = narrowed.repartitionByRange("h").sortWithinPartitions("h", "g", "first")
    line = Window.partitionBy("h", "g")
    return (ranged.withColumn("nth", F.row_number().over(line.orderBy("first")))
            .withColumn("last", F.max("last").over(line))
            .where((F.col("nth") == 1) & (F.col("first") < F.col("last")))
            .select("h", "g", "first"))


def _runs(dropped: Column) -> Column:
    """Sorted distinct positions -> runs of (keep, drop) lengths."""
    steps = F.arrays_zip(dropped.alias("pos"), F.concat(F.array(F.lit(-2)), dropped).alias("prev"))
    breaks = F.filter(steps, lambda s: s["pos"].isNull() | (s["pos"] != s["prev"] + 1))
    pairs = F.zip_with(breaks, F.slice(breaks, F.lit(2), F.size(breaks)), lambda a, b: F.struct(
        (a["pos"] - F.greatest(a["prev"], F.lit(-1)) - 1).alias("keep"),
        (b["prev"] - a["pos"] + 1).alias("drop")))
    return F.filter(pairs, lambda r: r["drop"].isNotNull())


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """Compressed keep bitmap of every document that loses a line.

    Columns: ``_doc`` and ``_text`` (document number and text hash), ``keep_runs``
    (array of keep and drop lengths in order of the lines) and ``n_dropped``. A null
    text counts as empty, so as one empty line; an empty table has no bitmaps. Rows
    with a null number count as one document, which comes last. Lines that repeat
    only inside one document, or whose key is shorter than ten code points, stay.
    """
    found = occurrences(docs)
    return (found.join(repeated_lines(found), ["h", "g"])
            .where(F.col("_doc") > F.col("first"))
            .groupBy("_doc", "_text").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
            .select("_doc", "_text", _runs(F.col("dropped")).alias("keep_runs"),
                    F.size("dropped").cast("long").alias("n_dropped")))


def with_kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``_n_lines``, ``_n_dropped`` and ``_kept_text``."""
    bitmaps = bitmaps.withColumnsRenamed({"keep_runs": "_keep_runs", "n_dropped": "_n_dropped"})
    mask = F.flatten(F.transform("_keep_runs", lambda r: F.concat(
        F.array_repeat(F.lit(True), r["keep"]), F.array_repeat(F.lit(False), r["drop"]))))
    lines = _lines(F.col("text"))
    kept = F.filter(F.arrays_zip(lines.alias("line"), mask.alias("keep")),
                    lambda z: F.coalesce(z["keep"], F.lit(True)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (_identified(docs).join(bitmaps, ["_doc", "_text"], "left")
            .withColumn("_n_lines", F.size(lines).cast("long"))
            .withColumn("_kept_text", F.when(F.col("_keep_runs").isNull(), text).otherwise(
                F.array_join(F.transform(kept, lambda z: z["line"]), "\n")))
            .withColumn("_n_dropped", F.coalesce("_n_dropped", F.lit(0).cast("long")))
            .drop("_doc", "_text", "_keep_runs"))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and SHA-256 of the kept text."""
    narrow = docs.select("doc_id", "text")
    return with_kept_text(narrow, keep_bitmaps(narrow)).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("_kept_text", 256).alias("kept_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with their repeated lines removed; ``n_chars`` follows, if there."""
    kept = with_kept_text(docs, keep_bitmaps(docs.select("doc_id", "text")))
    kept = kept.withColumn("text", F.col("_kept_text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*docs.columns)
