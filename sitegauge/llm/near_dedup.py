"""Near-duplicate documents by MinHash banding, confirmed on full shingle sets.

1. Every text becomes the set of its hashed word shingles, a digest of that set and
   ``HASHES`` universal hash minima. Documents with equal sets are one node from here on.
2. Minima are cut into bands; nodes that agree in a whole band share a bucket. Two
   sets of just the similarity asked for (``Likeness``) miss each other in all bands
   less than once in a million times.
3. Instead of all pairs of a bucket, its members are first compared with one leader,
   the member that shares most buckets with others, as the original of a group of
   copies does. Pairs whose minima agree too rarely are dropped, the others are
   confirmed on the full sets, and links are joined to components.
4. A bucket whose members are in one component is done: no further pair of it could
   change the result. For the members of all others an exact prefix join finds every
   pair that could still join two components, without a cap: two sets of similarity
   0.85, say, share a shingle among the rarest 15 % of each, and early enough in both
   for the rest to reach the needed overlap. Per shingle, only rows outside its largest
   component look for partners, so a large group of copies is not paired with itself.

Node names, buckets and links stay in tables; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm import words as W
from sitegauge.llm.components import components
from sitegauge.session import discard, stage

HASHES = 120
#: Bits of the filter that keeps most texts without a part in any bucket from being shuffled.
FILTER_BITS = 1 << 26


class Likeness(NamedTuple):
    """When two documents are near duplicates: similarity in percent on shingles of so many words."""

    words: int = 3
    percent: int = 85
    #: ``HASHES`` minima are cut into bands of so many.
    band_rows: int = 5
    #: Least share of equal minima of a pair that is confirmed: five standard deviations below ``percent``.
    least_agreement: float = 0.68


THREE_WORDS = Likeness()
FIVE_WORDS = Likeness(5, 80, 4, 0.61)

_RNG = np.random.default_rng(24)
_FACTOR = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADDEND = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_SALTS = _RNG.integers(0, 2**63, 2, dtype=np.uint64)


def row_id() -> Column:
    """Number of a document; where it is null, a negative number from its text."""
    return F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(text_hash(), 1))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _sketch_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    W.make_room()
    for batch in batches:
        data, offsets = W.bytes_of(batch.column(3))
        for first, last in W.pieces(offsets):
            part = offsets[first:last + 1]
            hashes, counts = W.shingle_hashes(data[part[0]:part[-1]], part - part[0], size)
            n = len(counts)
            minima = np.zeros((n, HASHES), np.uint16)
            sizes, digest = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            some = np.flatnonzero(counts)
            if len(some):
                starts = (np.cumsum(counts) - counts)[some]
                for i in range(HASHES):
                    least = np.minimum.reduceat((hashes * _FACTOR[i] + _ADDEND[i]) >> np.uint64(32), starts)
                    minima[some, i] = W.mix(least) & np.uint64(0xFFFF)
                for at, piece in zip(some, np.split(hashes, starts[1:])):
                    own = np.unique(piece)
                    sizes[at] = len(own)
                    digest[at, 0] = W.mix(own ^ _SALTS[0]).sum()
                    digest[at, 1] = W.mix(own ^ _SALTS[1]).sum()
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i).slice(first, n) for i in range(3)], pa.array(sizes),
                pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)),
                pa.array([m.tobytes() for m in minima], pa.binary())],
                names=["doc_id", "id", "text_hash", "n_shingles", "lo", "hi", "minima"])


def sketches(docs: DataFrame, like: Likeness = THREE_WORDS) -> DataFrame:
    """Per row: doc_id, id, text_hash, number of distinct shingles, set digest and hash minima."""
    text = F.col("text").cast("string").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id().alias("id"),
                       text_hash().alias("text_hash"), text).mapInArrow(
        partial(_sketch_rows, size=like.words), "doc_id long, id long, text_hash long, n_shingles long, lo long, hi long, minima binary")


def _agreeing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    W.make_room()
    for batch in batches:
        if batch.num_rows:
            a, b = (np.array([np.frombuffer(m, np.uint16) for m in batch.column(i).to_pylist()]) for i in (2, 3))
            kept = (a == b).mean(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(kept))


def _linked(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    W.make_room()
    for batch in W.slices(batches, 500):
        sets = []
        for i in (2, 3):
            data, offsets = W.bytes_of(batch.column(i))
            hashes, counts = W.shingle_hashes(data, offsets, like.words)
            sets.append(np.split(hashes, np.cumsum(counts)[:-1]))
        kept = []
        for x, y in zip(*sets):
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(100 * both >= like.percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
            pa.array(kept, pa.bool_()))


def _shingle_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """id, component and text -> id, component and the sorted distinct shingles."""
    W.make_room()
    for batch in W.slices(batches, 500):
        data, offsets = W.bytes_of(batch.column(2))
        hashes, counts = W.shingle_hashes(data, offsets, size)
        sets = [np.unique(x).view(np.int64) for x in np.split(hashes, np.cumsum(counts)[:-1])]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()),
            pa.ListArray.from_arrays(np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32),
                                     np.concatenate(sets))], names=["node", "c", "size", "shingles"])


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Written table of the pairs (a, b) whose minima agree often enough and whose full sets are similar."""
    minima = nodes.select("node", "minima")
    similar = stage(
        pairs.join(minima.toDF("a", "minima_a"), "a").join(minima.toDF("b", "minima_b"), "b")
        .select("a", "b", "minima_a", "minima_b").mapInArrow(
            partial(_agreeing, least=like.least_agreement), "a long, b long").distinct(), "near-pairs")
    linked = stage(
        similar.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        .select("a", "b", "text_a", "text_b").mapInArrow(
            partial(_linked, like=like), "a long, b long").distinct(), "near-linked")
    discard(similar)
    return linked


def _prefix_pairs(labelled: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Written table of the pairs (a, b) of different components that a prefix join cannot rule out.

    ``labelled`` has columns node and c, its component.
    """
    sets = labelled.join(texts.withColumnRenamed("id", "node"), "node").select("node", "c", "text").mapInArrow(
        partial(_shingle_rows, size=like.words), "node long, c long, size long, shingles array<long>")
    sets = stage(sets, "near-sets")
    rows = sets.select("node", "c", "size", F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    kept = F.col("size") - F.floor((F.col("size") * like.percent + 99) / 100).cast("long") + 1
    prefixes = stage(
        rows.join(often, "shingle").groupBy("node", "c", "size")
        .agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("s"))
        .select("node", "c", "size", F.posexplode(F.slice("s", F.lit(1), kept.cast("int"))).alias("pos", "s"))
        .where("s.often > 1").select("node", "c", "size", "pos", "s.shingle"), "near-prefixes")
    discard(sets)
    of_c = prefixes.groupBy("shingle", "c").agg(F.count("*").alias("n"))
    main = of_c.groupBy("shingle").agg(F.max_by("c", "n").alias("main"), F.count("*").alias("cs")).where("cs > 1")
    right = prefixes.join(main.select("shingle", "main"), "shingle")
    left = right.where("c <> main").select("shingle", *[F.col(x).alias(f"{x}_") for x in ("node", "c", "size", "pos")])
    # were this the first shingle they share, so many could follow at most, itself included
    reach = F.least(F.col("size") - F.col("pos"), F.col("size_") - F.col("pos_"))
    pairs = stage(
        left.join(right, "shingle")
        .where((F.col("c") != F.col("c_")) & ((100 + like.percent) * reach >= like.percent * (F.col("size") + F.col("size_"))))
        .select(*_pair("node", "node_")).distinct(), "near-candidates")
    discard(prefixes)
    return pairs


def _bucket_rows(nodes: DataFrame, like: Likeness) -> DataFrame:
    """(bucket, node, size, score) of the buckets that hold two nodes or more."""
    width = 2 * like.band_rows
    bands = nodes.select("node", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.substring("minima", 1 + i * width, width)) for i in range(HASHES // like.band_rows)])).alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stage(bands.join(sizes, "bucket"), "near-buckets")
    scores = shared.groupBy("node").agg(F.sum("size").alias("degree")).select(
        "node", (F.col("degree") * 2**20 + F.pmod(F.xxhash64("node"), F.lit(2**20))).alias("score"))
    scored = stage(shared.join(scores, "node"), "near-shared")
    discard(shared)
    return scored


def _perhaps(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts (id, text) but for such as surely have none of the ids: the bit of their id's hash is not set.

    The bits are made and tested by Spark's bitmap functions; however many the ids, they
    take 8 MB at most where they are broadcast.
    """
    at = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    piece, place = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    bits = (ids.select(piece.alias("_piece"), place.alias("_place")).repartition("_piece")
            .groupBy("_piece").agg(F.bitmap_construct_agg("_place").alias("_bits")))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1))
    return texts.withColumn("_piece", piece).join(F.broadcast(bits), "_piece").where(bit == 1).select("id", "text")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def node_components(nodes: DataFrame, texts: DataFrame, known: DataFrame, like: Likeness = THREE_WORDS) -> DataFrame:
    """Columns node and component for every node that is not the least of its component.

    ``known`` holds links (a, b) that need no confirmation.
    """
    rows = _bucket_rows(nodes, like)
    leader = rows.groupBy("bucket").agg(F.max_by("node", "score").alias("leader"))
    pairs = rows.join(leader, "bucket").where("node <> leader").select(*_pair("node", "leader")).distinct()
    ids = rows.select(F.col("node").alias("id")).distinct()
    # a semi join would be moved to before the filter
    shared = stage(_perhaps(texts, ids).join(ids, "id").dropDuplicates(["id", "text"]), "near-texts")
    confirmed = _confirmed(pairs, nodes, shared, like)
    links = stage(confirmed.union(known), "near-links")
    labels = components(links.toDF("u", "v"))
    labelled = rows.select("bucket", "node").join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("c"))
    apart = labelled.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y")
    open_nodes = stage(labelled.join(apart.select("bucket"), "bucket", "left_semi").select("node", "c").distinct(),
                       "near-open")
    # all that reads these is written by now
    for table in (confirmed, labels, rows):
        discard(table)
    candidates = _prefix_pairs(open_nodes, shared, like)
    more = _confirmed(candidates, nodes, shared, like)
    for table in (open_nodes, candidates, shared):
        discard(table)
    return components(links.union(more).toDF("u", "v"))


def _labelled(docs: DataFrame, like: Likeness) -> DataFrame:
    """Per row: doc_id, id, text_hash, n_shingles and label, the name of its component."""
    rows = stage(sketches(docs, like), "near-sketches")
    some = rows.where("n_shingles > 0")
    nodes = stage(some.groupBy("lo", "hi").agg(F.min("id").alias("node"), F.first("minima").alias("minima")),
                  "near-nodes")
    texts = docs.select(row_id().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    several = some.groupBy("id").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).where("x < y").select("id")
    of_id = some.join(several, "id").join(nodes.select("lo", "hi", "node"), ["lo", "hi"]).select("id", "node")
    one_document = of_id.join(of_id.groupBy("id").agg(F.min("node").alias("least")), "id").select(
        *_pair("node", "least")).distinct()
    labels = node_components(nodes, texts, one_document, like)
    node_of = nodes.select("lo", "hi", "node").join(labels, "node", "left").select(
        "lo", "hi", F.coalesce("component", "node").alias("label"))
    return rows.drop("minima").join(node_of, ["lo", "hi"], "left").select(
        "doc_id", "id", "text_hash", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("id")).alias("label"))


def near_duplicates(docs: DataFrame, like: Likeness = THREE_WORDS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    Words are runs of other than white space (\\x20, \\x09-\\x0D), A-Z lower-cased; a
    document is the set of its shingles of ``like.words`` words, with fewer words the whole
    sequence. Documents whose sets have a Jaccard similarity of ``like.percent`` or more are linked;
    ``component_id`` is the least doc_id that links lead to. A null or empty text, or
    one without words, has no shingles, is linked with nothing and is its own component.
    Rows that share a doc_id are one document. Rows with a null doc_id take part by their
    text; a component of these alone has a null component_id and is kept. An empty table
    gives an empty result; other columns are ignored.
    """
    placed = _labelled(docs, like)
    least = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "label").select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, like: Likeness = THREE_WORDS) -> DataFrame:
    """The documents with one row of each component: of its least doc_id, the text of least hash."""
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash", "id")
    kept = _labelled(docs, like).groupBy("label").agg(F.min(order).alias("o")).select(
        F.col("o.id").alias("_id"), F.col("o.text_hash").alias("_t"))
    keyed = docs.withColumns({"_id": row_id(), "_t": text_hash()})
    return keyed.join(kept, ["_id", "_t"], "left_semi").dropDuplicates(["_id", "_t"]).select(*docs.columns)
