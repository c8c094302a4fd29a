"""Alignment of two tokenizers over a corpus: which tokens of one cover the bytes of the other's.

1. Documents are grouped by their full text, so every distinct text is tokenised and
   aligned once, however many documents hold it; its pair counts weigh as often.
2. Distinct texts are gathered to blocks of bounded size as they are aligned. A block
   keeps the list of its distinct id pairs with their weighted counts, and each of its
   texts the places of its pairs in that list. Only the lists are shuffled for the
   corpus counts, so a pair that stands in every text costs one row per block.
3. Corpus counts, and whether a count is the highest of its B id, go back to the blocks,
   which sum them up over the links of their texts.
4. The measures of a text are joined to its documents. A text that very many documents
   hold is dealt over ``SLOTS`` rows before.

Links need no search: where tokens of A and of B each cut a text into pieces, every piece
between two neighbouring cuts of either kind lies in one token of each, and every pair of
overlapping tokens shares just one such piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.session import stage

#: UTF-8 bytes of the texts of a block; a longer text is a block by itself.
BLOCK_BYTES = 8 << 20
#: Rows that one text is dealt over on its way to its documents.
SLOTS = 64

_SPACE = "▁"


class Files(NamedTuple):
    """Where the vocabularies are, on every executor, and the pattern that splits texts for A."""

    byte_ranks: str
    pieces: str
    pattern: str


class Aligned(NamedTuple):
    """Token ids of one text, and how many tokens each side has used up at the end of every group."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    codes: np.ndarray


class Aligner:
    """Both vocabularies, loaded once per Python worker."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken

        with open(files.byte_ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.byte_level = tiktoken.Encoding("a", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
        self.a_length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.a_length[rank] = len(token)
        self.b_bytes = [self._piece_bytes(i) for i in range(self.pieces.get_piece_size())]
        self.b_length = np.array([len(piece) for piece in self.b_bytes], np.int64)
        names = [str(i) for i in range(max(len(self.a_length), len(self.b_bytes)))]
        self.within, self.a_last, self.b_last = (
            np.array([name + mark for name in names], object) for mark in ",|;")

    def _piece_bytes(self, i: int) -> bytes:
        if self.pieces.is_byte(i):
            return bytes([int(self.pieces.id_to_piece(i)[3:-1], 16)])
        return self.pieces.id_to_piece(i).replace(_SPACE, " ").encode()

    def align(self, text: str, b_ids: list[int]) -> Aligned | None:
        """The alignment of a text, given its B ids; none where joined tokens are not the text."""
        whole = (" " + text).encode()
        a_ids = self.byte_level.encode_ordinary(" " + text)
        if (not text or b"".join(map(self.b_bytes.__getitem__, b_ids)) != whole
                or self.byte_level.decode_bytes(a_ids) != whole):
            return None
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_cuts, b_cuts = self.a_length[a].cumsum(), self.b_length[b].cumsum()
        cuts, times = np.unique(np.concatenate([a_cuts, b_cuts]), return_counts=True)
        of_a, of_b = a_cuts.searchsorted(cuts), b_cuts.searchsorted(cuts)
        shared = times == 2
        return Aligned(a, b, of_a[shared] + 1, of_b[shared] + 1, a[of_a] << 32 | b[of_b])

    def aligned(self, texts: list[str]) -> Iterator[Aligned | None]:
        return map(self.align, texts, self.pieces.encode(texts, num_threads=1))

    def written(self, found: Aligned) -> str:
        """The groups as text: ids of A, ``|``, ids of B, groups joined by ``;``."""
        a, b, a_ends, b_ends = found[:4]
        a_names, b_names = self.within[a], self.within[b]
        a_names[a_ends - 1], b_names[b_ends - 1] = self.a_last[a[a_ends - 1]], self.b_last[b[b_ends - 1]]
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.repeat(np.append(0, b_ends[:-1]), np.diff(a_ends, prepend=0))] = a_names
        out[np.arange(len(b)) + np.repeat(a_ends, np.diff(b_ends, prepend=0))] = b_names
        return "".join(out.tolist())[:-1]


@lru_cache(maxsize=2)
def _aligner(files: Files) -> Aligner:
    return Aligner(files)


_TEXT_ROW = ("digest string, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "pairs array<int>, times array<int>, codes array<long>, weights array<long>")
_TEXT_SCHEMA = pa.schema([
    ("digest", pa.string()), ("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
    ("codes", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts), kind))


class _Block:
    """Aligned texts on their way to one block."""

    def __init__(self):
        self.rows, self.codes, self.times, self.weights, self.bytes = [], [], [], [], 0

    def add(self, aligner: Aligner, digest: str, n: int, text: str, found: Aligned | None) -> None:
        self.bytes += len(text.encode())
        if found is None:
            codes = times = np.zeros(0, np.int64)
            self.rows.append((digest, 0, 0, 0, 0, ""))
        else:
            codes, times = np.unique(found.codes, return_counts=True)
            groups = sha256(aligner.written(found).encode()).hexdigest()
            self.rows.append((digest, len(found.a), len(found.b), len(found.a_ends), len(found.codes), groups))
        self.codes.append(codes)
        self.times.append(times)
        self.weights.append(times * n)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The texts, in several batches so that none grows large, then the list of pairs."""
        codes, places = np.unique(np.concatenate(self.codes), return_inverse=True)
        weights = np.zeros(len(codes), np.int64)
        np.add.at(weights, places, np.concatenate(self.weights))
        places = np.split(places, np.cumsum([len(c) for c in self.codes])[:-1])
        m = len(self.rows)
        block = pa.array([int(self.rows[0][0][:15], 16)] * m, pa.int64())
        digest, *numbers, groups = zip(*self.rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(digest), block, *[pa.array(x, pa.int64()) for x in numbers], pa.array(groups),
             _lists(places, pa.int32()), _lists(self.times, pa.int32()),
             pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))], schema=_TEXT_SCHEMA)
        yield pa.RecordBatch.from_pylist(
            [{"block": block[0].as_py(), "codes": codes, "weights": weights}], schema=_TEXT_SCHEMA)


def _align_rows(batches: Iterator[pa.RecordBatch], files: Files) -> Iterator[pa.RecordBatch]:
    """digest, n and text of distinct texts -> their rows and one row per block."""
    aligner, block = _aligner(files), _Block()
    for batch in batches:
        # a few texts at a time, so that the ids of a batch are not all held at once
        for start in range(0, batch.num_rows, 200):
            digests, counts, texts = (c.slice(start, 200).to_pylist() for c in batch.columns)
            for row in zip(digests, counts, texts, aligner.aligned(texts)):
                if block.rows and block.bytes + len(row[2].encode()) > BLOCK_BYTES:
                    yield from block.batches()
                    block = _Block()
                block.add(aligner, *row)
    if block.rows:
        yield from block.batches()


def _sums(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Texts of a block and the answers to its pairs -> digest, n_best and count_sum."""
    m = answers.num_rows
    count, best = np.zeros(m, np.int64), np.zeros(m, np.int64)
    place = answers.column("place").to_numpy()
    count[place] = answers.column("count").to_numpy()
    best[place] = answers.column("best").to_numpy()
    pairs = texts.column("pairs").combine_chunks()
    times = texts.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    places = pairs.flatten().to_numpy(zero_copy_only=False)
    ends = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
    summed = [np.append(0, np.cumsum(times * x[places]))[ends] for x in (best, count)]
    return pa.table([texts.column("digest").combine_chunks(), *[pa.array(np.diff(x)) for x in summed]],
                    names=["digest", "n_best", "count_sum"])


def _digest() -> Column:
    text = F.col("text").cast("string")
    return F.when(text != "", F.sha2(text, 256))


def align_texts(docs: DataFrame, files: Files) -> DataFrame:
    """Written table of the distinct texts, each with its measures, and of the blocks' pairs (``digest`` null)."""
    texts = (docs.select(F.col("text").cast("string").alias("text")).where("text <> ''")
             .groupBy("text").agg(F.count("*").alias("n")))
    return stage(texts.select(_digest().alias("digest"), "n", "text")
                 .mapInArrow(partial(_align_rows, files=files), _TEXT_ROW), "aligned")


def _block_pairs(aligned: DataFrame) -> DataFrame:
    return aligned.where("digest IS NULL").select(
        "block", F.posexplode(F.arrays_zip("codes", "weights")).alias("place", "pair")).select(
        "block", "place", F.col("pair.codes").alias("code"), F.col("pair.weights").alias("weight"))


def _counted(aligned: DataFrame) -> DataFrame:
    """code, b_id, count and best (1 where the count is the highest of its B id) of every id pair."""
    counts = (_block_pairs(aligned).groupBy("code").agg(F.sum("weight").alias("count"))
              .withColumn("b_id", F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))))
    highest = counts.groupBy("b_id").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b_id").select(
        "code", "b_id", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))


def pair_counts(docs: DataFrame, files: Files) -> DataFrame:
    """The token dictionary of a corpus: a_id, b_id, how many links hold the pair, and whether no pair of its B id has more."""
    return _counted(align_texts(docs, files)).select(
        F.shiftright("code", 32).cast("int").alias("a_id"), F.col("b_id").cast("int").alias("b_id"),
        "count", (F.col("best") == 1).alias("best"))


def measures(docs: DataFrame, files: Files) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A is a byte-level BPE, B a piece BPE; both read the text with a space in front. A
    text that is null, empty or not given back by the joined tokens of either (B writes
    a space as U+2581, so a text that holds that character is not) has no tokens: zeros
    and an empty groups_sha256, and its pairs count nowhere. Rows with equal texts have
    equal measures, whatever their doc_id, and each of them counts; null doc_ids stay
    null. An empty table gives an empty result; other columns are ignored.
    """
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"),
                             F.pmod(F.monotonically_increasing_id(), F.lit(SLOTS)).alias("slot")), "alignment-rows")
    aligned = align_texts(docs, files)
    known = stage(_counted(aligned).drop("b_id"), "alignment-counts")
    answers = _block_pairs(aligned).join(known, "code").select(
        F.col("block").alias("of_block"), "place", "count", "best")
    texts = aligned.where("digest IS NOT NULL")
    sums = (texts.select("block", "digest", "pairs", "times").groupBy("block")
            .cogroup(answers.groupBy("of_block")).applyInArrow(_sums, "digest string, n_best long, count_sum long"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    measured = texts.select("digest", *numbers[:4], "groups_sha256").join(sums, "digest")
    places = rows.where("digest IS NOT NULL").select("digest", "slot").distinct()
    found = rows.join(places.join(measured, "digest"), ["digest", "slot"], "left")
    return found.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
                        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
