import itertools
import math
import os

import numpy as np
import pytest

from sitegauge.llm import ann

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (6, 2), (1, 5)])
def test_neighbours_on_the_curve_are_neighbours_in_space(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    places = ann.hilbert_index(cells, bits)
    assert sorted(places) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1) == 1).all()


def good(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, every=50):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and good(v)}
    out = []
    for q, a in sorted(usable):
        if q % every:
            continue
        near = []
        for i, b in usable:
            if i != q and len(a) == len(b):
                dot = sum(x * y for x, y in zip(a, b))
                near.append((dot / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))), i))
        near.sort(key=lambda n: (-n[0], n[1]))
        out += [(q, r, i, s) for r, (s, i) in enumerate(near[:5], 1)]
    return sorted(out)


def found(table, **more):
    return sorted(map(tuple, ann.nearest(table, **more).collect()))


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))


def test_odd_rows(spark):
    """Few enough rows that every part is looked at, so all must be found."""
    rng = np.random.default_rng(7)
    base = [float(np.float32(x)) for x in rng.standard_normal(8)]
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(1, 60)]
    rows += [(100 + i, base) for i in range(25)] + [(150, None), (200, []), (250, [0.0] * 8), (300, [1.0, None] + [0.0] * 6),
             (350, [float("nan")] + [1.0] * 7), (400, [float("inf")] + [1.0] * 7), (None, base), (0, rows[3][1]),
             (50, rows[4][1]), (50, rows[4][1]), (450, [2.0 * x for x in base]), (500, [1.0, 2.0]), (501, [2.0, 1.0]),
             (502, [-0.0, 3.0]), (503, [0.0, 3.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, curve string")
    old = ann.PARTS, ann.REACH
    ann.REACH = ann.PARTS
    try:
        got = found(table.repartition(3))
    finally:
        ann.PARTS, ann.REACH = old
    want = brute(rows)
    # 450 is twice the base vector: its scores are equal but for the last bits
    same([g for g in got if g[0] != 450], [w for w in want if w[0] != 450])
    assert len(got) == len(want)
    assert found(table.where("false")) == []


def test_slices_of_a_large_part(spark, monkeypatch):
    monkeypatch.setattr(ann, "SLICE_ROWS", 7)
    monkeypatch.setattr(ann, "REACH", ann.PARTS)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(300)]
    same(found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=30), brute(rows, 30))


def test_small_and_tied_tables(spark):
    """Few distinct vectors of a width are all compared, with the production PARTS and REACH."""
    rng = np.random.default_rng(11)
    rows, first = [], 0
    for n, width in ((2, 3), (9, 5), (21, 8), (150, 6)):
        rows += [(first + i, [float(x) for x in rng.standard_normal(width)]) for i in range(n)]
        first += n
    # copies of few vectors, and many vectors of one cell among few others
    few = [[float(x) for x in rng.standard_normal(7)] for _ in range(6)]
    rows += [(1000 + i, few[i % 6]) for i in range(300)]
    rows += [(2000 + i, [1.0] * 9 + [float(x) for x in rng.uniform(0, 1e-6, 1)]) for i in range(60)]
    rows += [(3000 + i, [float(x) for x in rng.standard_normal(10)]) for i in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(table.repartition(3), every=5), brute(rows, 5)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))
    # scores of the one cell differ in their last bits only
    assert [g[2] for g in got if g[0] < 2000] == [w[2] for w in want if w[0] < 2000]


def test_windows_count_occupied_parts():
    part = np.array([40, 0, 63, 20, 41], np.int32)
    sizes = ann.pa.table({"width": ann.pa.array([8] * 5, ann.pa.int32()), "curve": ann.pa.array([3] * 5, ann.pa.int32()),
                          "part": part, "n": [300, 300, 10, 300, 300], "slices": [1, 2, 3, 4, 5]})
    pairs = ann._windows(sizes).to_pylist()
    near = {p: [x["near"] for x in pairs if x["part"] == p] for p in part}
    assert near == {0: [0, 20, 40], 20: [0, 20, 40, 41], 40: [0, 20, 40, 41, 63], 41: [20, 40, 41, 63],
                    63: [40, 41, 63]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")
def test_recall_on_given_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got, want = found(table, every=5), brute(rows, 5)
    assert len(got) == len(want)
    pairs = {(g[0], g[2]) for g in got}
    assert sum((w[0], w[2]) in pairs for w in want) >= 0.9 * len(want)


def test_extreme_components(spark):
    """Squares of tiny and huge doubles neither vanish nor overflow; ordinary scores keep every bit."""
    rows = [(0, [1e-200, 0.0]), (1, [1.0, 0.0]), (2, [1e200, 1e200]), (3, [5e-324, 0.0]), (4, [-1.7e308, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(g[0], g[2]): g[3] for g in found(table, every=1)}
    assert len(got) == 20 and got[0, 1] == got[1, 3] == got[3, 0] == 1.0 and got[1, 4] == got[0, 4] == -1.0
    assert abs(got[0, 2] - 0.5 ** 0.5) < 1e-15 and abs(got[2, 4] + 0.5 ** 0.5) < 1e-15
    plain = spark.createDataFrame([([0.3, -0.7, 1.9], [2.5, 0.1, 0.77])], "a array<double>, b array<double>")
    scaled = plain.select(ann._scaled("a").alias("a"), ann._scaled("b").alias("b"))
    assert plain.select(ann._cosine("a", "b")).first() == scaled.select(ann._cosine("a", "b")).first()
