"""Nearest neighbours by shifted space-filling curves.

Vectors are scaled to length 1 and projected, for each curve anew, by a random
rotation to ``DIMENSIONS`` axes, shifted at random and cut into a grid; a row's place
on the curve is the Hilbert index of its cell. The curve is cut into ``PARTS`` parts of
about equal row numbers, and a query is compared with all rows of its own part and of
the ``REACH`` parts that hold rows on either side of it, or of more parts, until these
are ``LEAST_ROWS`` or the whole curve. So up to ``LEAST_ROWS`` distinct vectors of a width
are searched in full. What all curves find is merged and reranked by the exact cosine.

Parts are a fixed share of the rows, not a fixed number: vectors without much
structure have their neighbours in no one place of any curve, and only a share keeps
the recall the same at every size. The work is queries x curves x share x rows, spread
over (curve, part, slice) groups; a part with many rows is cut into slices.

Equal vectors are one candidate with its ``TOP + 1`` smallest numbers: no further row
of them can be among the ``TOP`` nearest of any query, as ties go to smaller numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.session import stage

TOP = 5
EVERY = 50
CURVES, DIMENSIONS, BITS = 20, 8, 4
PARTS, REACH = 64, 2
#: Least number of distinct vectors that a query is compared with on each curve.
LEAST_ROWS = 500
#: Rows of a part that one group compares with the part's queries.
SLICE_ROWS = 4000
#: Curve places whose quantiles cut the curve, taken from a sample of about so many rows or all of a width.
SAMPLE_ROWS = 200_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below 2**bits.

    From the highest bit down, the sub-cube of a cell is turned so that the curve enters
    it where it left the last one; the bits read along the way, as a Gray code, are the
    place.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for axis in range(n):
            far = (x[axis] & q) != 0
            turned = (x[0] ^ x[axis]) & low
            x[0] = np.where(far, x[0] ^ low, x[0] ^ turned)
            if axis:
                x[axis] = np.where(far, x[axis], x[axis] ^ turned)
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    parity = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        parity ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= parity
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            place = (place << 1) | ((x[axis] >> level) & 1)
    return place


def places(vectors: np.ndarray) -> np.ndarray:
    """Place of every row (of length 1) on each of the curves."""
    width = vectors.shape[1]
    out = np.zeros((len(vectors), CURVES), np.int64)
    for curve in range(CURVES):
        rng = np.random.default_rng([25, curve, width])
        axes = np.linalg.qr(rng.standard_normal((width, width)))[0][:, :min(DIMENSIONS, width)]
        # a coordinate of a random unit vector has about this deviation
        at = vectors @ axes * np.sqrt(width) / 6 + 0.5 + rng.uniform(-0.1, 0.1, axes.shape[1])
        cells = np.clip((at * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        out[:, curve] = hilbert_index(cells, BITS)
    return out


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not all zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vector_id, width, vector -> vector_id, curve, place."""
    for batch in batches:
        widths = batch.column(1).to_numpy()
        for width in np.unique(widths):
            own = batch.filter(pa.array(widths == width))
            found = places(_unit(_matrix(own.column(2))))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(own.column(0).to_numpy(), CURVES)), pa.array(np.full(found.size, width, np.int32)),
                pa.array(np.tile(np.arange(CURVES, dtype=np.int32), len(found))), pa.array(found.ravel())],
                names=["v", "width", "curve", "place"])


def _windows(sizes: pa.Table) -> pa.Table:
    """Which parts each part of a curve looks at, from the rows and slices of those that hold any."""
    order = np.argsort(sizes["part"].to_numpy())
    parts, slices = (sizes[x].to_numpy()[order] for x in ("part", "slices"))
    below = np.append(0, np.cumsum(sizes["n"].to_numpy()[order]))
    out = [[], [], []]
    for at in range(len(parts)):
        reach = REACH
        while True:
            first, last = max(0, at - reach), min(len(parts), at + reach + 1)
            if below[last] - below[first] >= LEAST_ROWS or last - first == len(parts):
                break
            reach += 1
        out[0].append(np.full(last - first, parts[at]))
        out[1].append(parts[first:last])
        out[2].append(slices[first:last])
    near = [np.concatenate(x) for x in out]
    return pa.table([pa.array(np.full(len(near[0]), sizes[x][0].as_py(), np.int32)) for x in ("width", "curve")]
                    + [pa.array(x) for x in near], names=["width", "curve", "part", "near", "slices"])


def _nearest(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
    """The TOP + 1 nearest rows of a slice for each of the queries that look at it."""
    names = ["query", "v", "near"]
    if not len(rows) or not len(queries):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    candidates = _unit(_matrix(rows["vector"].combine_chunks()))
    v, query = rows["v"].to_numpy(), queries["query"].to_numpy()
    asked = _unit(_matrix(queries["vector"].combine_chunks()))
    # near ties are told apart by the exact score later, so some more are kept
    k = min(2 * (TOP + 1), len(v))
    out = [[], [], []]
    for first in range(0, len(asked), 500):
        near = np.round(asked[first:first + 500] @ candidates.T, 12)
        best = np.lexsort((np.broadcast_to(v, near.shape), -near), axis=1)[:, :k]
        out[0].append(np.repeat(query[first:first + 500], k))
        out[1].append(v[best].ravel())
        out[2].append(np.take_along_axis(near, best, axis=1).ravel())
    return pa.table([pa.array(np.concatenate(x)) for x in out], names=names)


def _scaled(vector: str) -> Column:
    """Components as doubles over the largest one's power of two, so no square under- or overflows.

    Such a division is exact: the cosine of ordinary vectors keeps its last bit.
    """
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return F.transform(vector, lambda x: x.cast("double") / F.pow(F.lit(2.0), F.floor(F.log2(largest))))


def _cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(table: DataFrame, every: int = EVERY) -> DataFrame:
    """Rows query_id, rank, vec_id and score: the TOP nearest of every query.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; a row is no
    candidate for itself. ``score`` is the cosine in double precision, ties go to the
    smaller ``vec_id``. Vectors that are null, empty or zero, or hold a null or
    non-finite component, take no part, nor do rows without a ``vec_id``; vectors are
    compared with others of their length only. Rows that share a ``vec_id`` and a
    vector count once; with several vectors such a number is a query for each. Other columns are ignored; an empty table gives an empty result.
    """
    vector = F.col("embedding")
    rows = table.where(usable(vector) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    # the hash takes 0.0 and -0.0 for the same
    keyed = rows.select("vec_id", "vector", F.xxhash64("vector").alias("h"),
                        F.xxhash64(F.lit("second"), "vector").alias("g"))
    # distinct vectors, named by their least number; numbers of equal vectors beyond TOP + 1 cannot count
    nth = F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))
    few = stage(keyed.groupBy("h", "g", "vec_id").agg(F.first("vector").alias("vector"))
                .withColumn("nth", nth).where(F.col("nth") <= TOP + 1), "ann-few")
    vectors = stage(few.where("nth = 1").select(F.col("vec_id").alias("v"), "h", "g",
                                                F.size("vector").alias("width"), "vector"), "ann-vectors")
    asked = stage(keyed.where(F.col("vec_id") % every == 0).select("vec_id", "h", "g").distinct()
                  .join(vectors.select("h", "g", "v"), ["h", "g"]).select("vec_id", "v"), "ann-asked")
    found = _search(vectors, asked.select("v").distinct())
    numbers = few.join(vectors.select("h", "g", "v"), ["h", "g"]).select("v", "vec_id")
    rank = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = (found.join(numbers, "v").withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= TOP + 1)
            .select("query", "vec_id", "score"))
    own = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return (asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("query")).join(best, "query")
            .where("query_id <> vec_id").withColumn("rank", F.row_number().over(own))
            .where(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score"))


def _search(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, v, score): for each query vector the TOP + 1 nearest distinct vectors found."""
    placed = stage(vectors.select("v", "width", "vector").mapInArrow(
        _place_rows, "v long, width int, curve int, place long"), "ann-places")
    # by width, so that one with few rows is not left without cuts
    every = vectors.groupBy("width").agg(F.greatest(F.lit(1), F.floor(F.count("*") / SAMPLE_ROWS)).alias("every"))
    sample = placed.join(every, "width").where(F.pmod(F.xxhash64("v"), F.col("every")) == 0)
    cuts = sample.groupBy("width", "curve").agg(
        F.percentile_approx("place", [i / PARTS for i in range(1, PARTS)], 10_000).alias("cuts"))
    parted = stage(placed.join(cuts, ["width", "curve"]).select(
        "v", "width", "curve", F.size(F.filter("cuts", lambda c: c < F.col("place"))).alias("part")), "ann-parts")
    sizes = stage(parted.groupBy("width", "curve", "part").agg(
        F.count("*").alias("n"), F.ceil(F.count("*") / SLICE_ROWS).alias("slices")), "ann-sizes")
    sliced = parted.join(sizes.drop("n"), ["width", "curve", "part"]).select(
        "v", "width", "curve", "part", F.pmod(F.xxhash64("v"), F.col("slices")).alias("slice"))
    windows = sizes.groupBy("width", "curve").applyInArrow(
        _windows, "width int, curve int, part int, near int, slices long")
    looks = (parted.join(asked, "v").join(windows, ["width", "curve", "part"])
             .select("v", "width", "curve", F.col("near").alias("part"), "slices")
             .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices"))
    keys = ["width", "curve", "part", "slice"]
    rows = sliced.join(vectors.select("v", "vector"), "v").select("v", "vector", *keys).toDF("v", "vector", *keys)
    queries = looks.join(vectors.select("v", "vector"), "v").select("v", "vector", *keys).toDF("query", "vector", *keys)
    pairs = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(
        _nearest, "query long, v long, near double")
    best = Window.partitionBy("query").orderBy(F.col("near").desc(), "v")
    few = (pairs.groupBy("query", "v").agg(F.max("near").alias("near"))
           .withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= 2 * (TOP + 1)))
    return (few.join(vectors.select("v", F.col("vector").alias("a")), "v")
            .join(vectors.select(F.col("v").alias("query"), F.col("vector").alias("b")), "query")
            .select("query", "v", _scaled("a").alias("a"), _scaled("b").alias("b"))
            .select("query", "v", _cosine("a", "b").alias("score")))
