"""Mixing of sources to target weights by pivotal dependent rounding.

Every source gets a target number of words and so a real number of copies per
document. The whole part is taken; the fractions of a source are rounded together. A
document is paired with the pool of those after it, shorter ones, and words go from
one to the other, in a random direction, until the copy fraction of one of the two is
0 or 1. Directions are weighted so that every document keeps its expected copies, and
the words of a source stay exactly the same in sum, but for the last document left.

The documents of a source are split into chunks by a hash. A chunk leaves one
document over, and what the chunks leave is combined in chunks again: a reduction
tree over ``CHUNK_ROWS`` children. All draws come from hashes, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm import words
from sitegauge.session import stage

SHARE_PERCENT = 150
MOST_COPIES = 2
WEIGHTS = (5, 2, 1)
CHUNK_ROWS = 1000

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Target words of every source, from the sources' sizes.

    Sources in order of code points, null last, weigh ``WEIGHTS`` in turn and share
    ``SHARE_PERCENT`` of all words. A target stops at ``MOST_COPIES`` times its
    source's size; the excess goes to the others by weight, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    result: dict[str | None, float] = {}
    left, open_ = SHARE_PERCENT * sum(sizes.values()) / 100, list(order)
    while open_:
        per_weight = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if per_weight * weight[s] > MOST_COPIES * sizes[s]]
        if not above:
            result.update((s, per_weight * weight[s]) for s in open_)
            break
        for s in above:
            result[s] = float(MOST_COPIES * sizes[s])
            left -= result[s]
        open_ = [s for s in open_ if s not in result]
        left = max(left, 0.0)
    return result


def _row_key() -> tuple[Column, Column]:
    """Two hashes that name a row by number, source and text, nulls told from empty."""
    row = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")]
    row += [c.isNull() for c in row]
    return F.xxhash64(*row), F.xxhash64(F.lit("second"), *row)


def _settle(x: np.ndarray, size: np.ndarray, key: np.ndarray, last: bool) -> np.ndarray:
    """Round the fractions of one chunk in order; at most one stays fractional.

    Each document is paired with the pool of all after it. Words go from one to the
    other until the document's fraction is 0 or 1, or that of the whole pool is. The
    pool's fractions move together: they are ``scale * x + shift`` of what they were.
    """
    draw = (words.mix(key) >> np.uint64(11)).astype(np.float64) / 2.0**53
    second = (words.mix(words.mix(key) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    x = x.copy()
    empty = size == 0
    x[empty] = draw[empty] < x[empty]
    pool_size = np.append(np.cumsum(size[::-1])[::-1], 0.0)
    pool_words = np.append(np.cumsum((size * x)[::-1])[::-1], 0.0)
    scale, shift = 1.0, 0.0
    for i in np.flatnonzero(~empty):
        own = min(max(scale * x[i] + shift, 0.0), 1.0)
        held = min(max(scale * pool_words[i + 1] + shift * pool_size[i + 1], 0.0), pool_size[i + 1])
        free = pool_size[i + 1] - held
        if 0.0 < own < 1.0 and (held > 0.0 or free > 0.0):
            need, give = (1 - own) * size[i], own * size[i]
            up, down = min(need, held), min(give, free)     # words from the pool, words to it
            if draw[i] * (up + down) < down:
                own = 1.0 if up == need else own + up / size[i]
                kept = 1 - up / held if up == need else 0.0
                scale, shift = scale * kept, shift * kept
            else:
                own = 0.0 if down == give else own - down / size[i]
                filled = down / free if down == give else 1.0
                scale, shift = scale * (1 - filled), shift * (1 - filled) + filled
        if own < 1e-9 or own > 1 - 1e-9:
            own = float(own > 0.5)
        elif last:
            own = float(second[i] < own)
        x[i] = own
    return x


def _rounded(last: bool, level: int):
    def of_chunk(table: pa.Table) -> pa.Table:
        words.make_room()
        # long documents first: the one that is left over at the end is then a short one
        table = table.sort_by([("size", "descending"), ("k1", "ascending"), ("k2", "ascending")])
        key = table["k1"].to_numpy().astype(np.int64).view(np.uint64) + np.uint64(7919 * (level + 1))
        x = _settle(table["x"].to_numpy(), table["size"].to_numpy().astype(np.float64), key, last)
        at = table.schema.get_field_index("x")
        return table.set_column(at, "x", pa.array(x, pa.float64()))

    return of_chunk


def with_copies(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies, and the row key k1, k2.

    A null text has size 0; a null source is a source of its own, the last. Every row
    is a document, so repeated rows are drawn each; a row of size 0 is drawn alone.
    An empty table gives an empty result. One row per source reaches the driver, since
    the weights are given per source.
    """
    k1, k2 = _row_key()
    sized = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        size_of(F.col("text")).alias("size"), k1.alias("k1"), k2.alias("k2")), "mix-sizes")
    spark = docs.sparkSession
    sources = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    target = targets({r["source"]: r["s"] for r in sources})
    rates = []
    for r in sources:
        rate = min(target[r["source"]] / r["s"], MOST_COPIES) if r["s"] else 0.0
        rates.append((r["source"], r["s"], target[r["source"]], int(rate), rate - int(rate), r["n"]))
    per_source = spark.createDataFrame(
        rates, "source string, source_size long, target double, base int, x double, n long")
    # Spark chooses the join by the size of this table, which has one row per source
    rows = sized.alias("d").join(per_source.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.doc_id", "d.source", "size", "k1", "k2", "source_size", "target", "base", "x", "n")
    columns, done = rows.columns, []
    left, level, most = rows, 0, max((r["n"] for r in sources), default=0)
    while True:
        chunks = F.ceil(F.col("n") / F.lit(CHUNK_ROWS))
        last = most <= CHUNK_ROWS
        chunked = left.withColumn("chunk", F.pmod(F.xxhash64("k1", "k2", F.lit(level)), chunks))
        settled = stage(chunked.groupBy("source", "chunk").applyInArrow(
            _rounded(last, level), chunked.schema), f"mix-level{level}")
        whole = F.col("x").isin(0.0, 1.0)
        done.append(settled.where(whole).select(*columns))
        if last:
            break
        # every chunk left one row at most; of so many the next level knows
        left = settled.where(~whole).select(*columns).withColumn("n", F.ceil(F.col("n") / F.lit(CHUNK_ROWS)))
        most, level = -(-most // CHUNK_ROWS), level + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select("doc_id", "source", "size", "source_size", "target",
                         (F.col("base") + F.col("x").cast("int")).alias("copies"), "k1", "k2")


def mixture(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target and the words taken."""
    return with_copies(docs).select("doc_id", "size", "source_size", "target",
                                    (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mixture: every row as often as it is taken.

    Rows that are equal in number, source and text are interchangeable: of so many
    such rows as the mixture takes once or twice, these are repeated.
    """
    counts = with_copies(docs).groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(
        *[F.count_if(F.col("copies") == c).alias(f"_n{c}") for c in range(MOST_COPIES)])
    nth = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1"))
    keyed = docs.withColumns(dict(zip(("_k1", "_k2"), _row_key())))
    copies = F.lit(MOST_COPIES)
    for c in reversed(range(MOST_COPIES)):
        fewer = sum((F.col(f"_n{i}") for i in range(c + 1)), F.lit(0))
        copies = F.when(F.col("_nth") <= fewer, c).otherwise(copies)
    return (keyed.join(counts, ["_k1", "_k2"])
            .withColumn("_nth", nth).withColumn("_copies", copies).where("_copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*docs.columns))
