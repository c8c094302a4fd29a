"""Merkle manifest of a dataset by time-forward processing: a tree per source, a tree over their roots.

A node's label is its level and its number there, so every child has a smaller label than
its parent. Digests travel as messages to the parent's label through a priority queue
ordered by label: on disk it is the shuffle, which deals messages to chunks of
``CHUNK`` consecutive nodes and sorts them; inside a chunk it is a heap that takes the
messages through ``LEVELS`` levels and hands the digest on top to the next round. So a
source of any size is done in a few rounds, and no task holds more than a chunk.

The reversed sweep goes down the same rounds from the root: a message carries the proof
suffix of a node (the siblings from its level up to the root) to its chunk, where the
heap delivers to every child the suffix with its own siblings put in front, down to the
leaves. A proof path is text: per level the digests to the left, ``|``, those to the
right, and levels joined by ``;``. It can be folded without the tree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.numbering import number_rows
from sitegauge.session import stage

#: Children of a node.
FAN = 3
#: Levels that a chunk is taken through in one round.
LEVELS = 8
CHUNK = FAN ** LEVELS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree string, idx long, n long, digest string"
#: A queue row is a node of a chunk or, with idx -1, the message to the chunk.
_QUEUE = ("tree", "chunk", "idx", "n", "digest", "data", "path", "subroot", "root")


def _hash(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    height = 0
    while n > 1:
        n, height = -(-n // FAN), height + 1
    return height


def _forward(digests: list[str], height: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """Digest on top of ``height`` levels above the chunk, and the children of every label."""
    queue = [(1, i // FAN, i, digest) for i, digest in enumerate(digests)]  # in order, so a heap
    children: dict[tuple[int, int], list[str]] = {}
    top = digests[0]
    while queue:
        level, number = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, number):
            run.append(heapq.heappop(queue)[3])
        children[level, number] = run
        top = _hash(*run)
        if level < height:
            heapq.heappush(queue, (level + 1, number // FAN, number, top))
    return top, children


def _backward(children: dict[tuple[int, int], list[str]], height: int, path: str) -> list[str]:
    """Proof paths of the chunk's nodes, given the path of the node on top."""
    queue = [(-height, 0, path)]
    paths = []
    while queue:
        level, number, above = heapq.heappop(queue)
        level = -level
        for i, run in ((i, children[level, number]) for i in range(len(children[level, number]))):
            own = f"{''.join(run[:i])}|{''.join(run[i + 1:])}" + (f";{above}" if above else "")
            if level == 1:
                paths.append(own)
            else:
                heapq.heappush(queue, (1 - level, number * FAN + i, own))
    return paths


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    return (list(group) for _, group in groupby(rows, key=itemgetter(0, 1)))


def _rise(n: int) -> int:
    """Levels from the nodes of a chunk to its top, where their tree has ``n`` nodes."""
    return LEVELS if n > CHUNK else _height(n)


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _chunks(batches):
        tree, chunk, _, n, _ = rows[0]
        top, _ = _forward([row[4] for row in rows], _rise(n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([tree]), pa.array([chunk]), pa.array([-(-n // CHUNK)]), pa.array([top])],
            names=["tree", "idx", "n", "digest"])


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for message, *rows in _chunks(batches):
        path, subroot, root = message[6:]
        height = _rise(rows[0][3])
        digests = [row[4] for row in rows]
        paths = _backward(_forward(digests, height)[1], height, path)
        m = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[0] for row in rows], pa.string()), pa.array([row[2] for row in rows], pa.int64()),
             pa.array(digests), pa.array([row[5] for row in rows], pa.string()), pa.array(paths),
             pa.array([subroot] * m), pa.array([root] * m)],
            names=["tree", "idx", "digest", "data", "path", "subroot", "root"])


def _chunk() -> Column:
    return F.floor(F.col("idx") / CHUNK).cast("long").alias("chunk")


def sweep(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of the forward sweep, the given nodes (tree, idx, n, digest, data) first.

    Every round holds what is left of the trees that had more than one node in the round
    before; a tree's root is its one row with ``n`` = 1.
    """
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        queue = rounds[-1].where("n > 1").select("tree", _chunk(), "idx", "n", "digest")
        climbed = (queue.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "idx")
                   .mapInArrow(_climb, _NODE))
        rounds.append(stage(climbed, "merkle-round"))
        most = -(-most // CHUNK)
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree."""
    tops = [nodes.where("n = 1").select("tree", "digest") for nodes in rounds]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def deliver(rounds: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """(tree, idx, digest, data, path, subroot, root) of every node that ``sweep`` was given.

    ``seeds`` holds what the reversed sweep begins with at every root: tree, path,
    subroot and root.
    """
    known = None
    for nodes in reversed(rounds):
        data = F.col("data") if "data" in nodes.columns else F.lit(None).cast("string")
        nodes = nodes.withColumn("data", data)
        lone = nodes.where("n = 1").join(seeds, "tree").select(
            "tree", "idx", "digest", "data", "path", "subroot", "root")
        if known is None:
            known = lone
            continue
        own = nodes.where("n > 1").select(
            "tree", _chunk(), "idx", "n", "digest", "data",
            *[F.lit(None).cast("string").alias(c) for c in ("path", "subroot", "root")])
        messages = known.select(
            "tree", F.col("idx").alias("chunk"), F.lit(-1).cast("long").alias("idx"),
            F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"),
            F.lit(None).cast("string").alias("data"), "path", "subroot", "root")
        queue = own.unionByName(messages).select(*_QUEUE)
        known = (queue.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "idx")
                 .mapInArrow(_descend, "tree string, idx long, digest string, data string, path string, "
                                       "subroot string, root string")
                 .unionByName(lone))
    return known


def leaf_of(columns: dict[str, Column]) -> Column:
    """Digest of a row: every value with its byte count in front, or ``-`` where it is null."""
    texts = [column.cast("string") for column in columns.values()]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tree_of(source: str) -> Column:
    """Name of a source's tree, never null; it sorts as the sources do, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def proofs(docs: DataFrame, data: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, data, proof path, subroot and root.

    The leaves of a source ascend by doc_id, null first; rows that tie go by their digest.
    A null source has a tree of its own, the first. A source of one row has its leaf for
    a subroot, and a table of one source its subroot for a root; an empty table gives an
    empty result. ``data`` is any text column to carry along. Other columns are ignored.
    """
    leaves = stage(docs.select(
        tree_of("source").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of({c: F.col(c) for c in FIELDS}).alias("digest"),
        (F.lit(None) if data is None else data).cast("string").alias("data")), "merkle-leaves")
    numbered = stage(
        number_rows(leaves, "tree", ["doc_id", "digest"], "idx", "n")
        .withColumn("data", F.to_json(F.struct("doc_id", "data"))).drop("doc_id"), "merkle-nodes")
    rounds = sweep(numbered)
    subroots = stage(roots(rounds), "merkle-subroots")
    items = number_rows(subroots.select(F.lit("").alias("all"), "tree", "digest"), "all", ["tree"], "idx", "n")
    upper = sweep(stage(items.select(
        F.col("all").alias("tree"), "idx", "n", "digest", F.col("tree").alias("data")), "merkle-items"))
    top = roots(upper).select("tree", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    seeds = deliver(upper, top).select(F.col("data").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    carried = F.from_json("data", "doc_id long, data string")
    return deliver(rounds, stage(seeds, "merkle-seeds")).select(
        carried["doc_id"].alias("doc_id"), F.col("digest").alias("leaf"), carried["data"].alias("data"),
        "path", "subroot", "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof path lead to."""
    levels = F.filter(F.split(path, ";"), lambda level: level != "")
    return F.aggregate(levels, leaf, lambda own, level: F.sha2(F.concat(
        F.substring_index(level, "|", 1), own, F.substring_index(level, "|", -1)), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.translate(path, "|;", ""), 256)


def verify(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id and ``verified`` of every row of ``docs`` that the manifest (``proofs``) names by its doc_id."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        leaf_of({c: F.col(c) for c in FIELDS}).alias("found"))
    return found.join(manifest.select("doc_id", "path", "root"), "doc_id").select(
        "doc_id", (fold(F.col("found"), F.col("path")) == F.col("root")).alias("verified"))


def tampered_leaf() -> Column:
    """Leaf of a row whose text lost its line ends, where 2 divides the CRC-32 of its decimal doc_id."""
    fields = {c: F.col(c) for c in FIELDS} | {"text": F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))}
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.when(crc % 2 == 0, leaf_of(fields))


def audited(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, and folded_root and verified after the tampering."""
    found = proofs(docs, tampered_leaf())
    folded = fold(F.coalesce("data", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
