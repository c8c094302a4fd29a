import os
from collections import defaultdict

import numpy as np
import pytest

from sitegauge.llm import mixing

SF = "/root/testdata/sf0.001"


def test_targets_share_the_excess():
    # 150 % of 400 words; weights 5, 2, 1: c is the last by code point, null comes after all
    assert mixing.targets({"b": 100, "a": 100, "c": 200}) == {"a": 200.0, "b": 200.0, "c": 200.0}
    got = mixing.targets({"a": 10, "b": 1000, None: 1000})
    assert got["a"] == 20.0 and abs(got["b"] - 2995 * 2 / 3) < 1e-9 or got["b"] == 2000.0
    assert abs(sum(got.values()) - 1.5 * 2010) < 1e-6
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_settling_keeps_sums_and_expectations():
    rng = np.random.default_rng(1)
    size = np.sort(np.round(rng.lognormal(4, 1.3, 40)))[::-1].copy()
    size[0], size[-1] = 1e5, 0
    total, runs = np.zeros(40), 3000
    for _ in range(runs):
        key = rng.integers(0, 2**63, 40, dtype=np.uint64)
        x = mixing._settle(np.full(40, 0.37), size, key, False)
        assert ((x > 0) & (x < 1)).sum() <= 1
        assert abs((x * size).sum() - 0.37 * size.sum()) < 1e-3
        total += mixing._settle(np.full(40, 0.37), size, key, True)
    assert np.abs(total / runs - 0.37).max() < 0.05


def by_source(rows):
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
    return taken, target, longest


def test_edge_cases(docs_of):
    docs = docs_of(*[(i, "word " * (i % 7), "en", "s%d" % (i % 3)) for i in range(300)], (1, None, "en", None),
                   (None, "a b c", "en", None), (5, "same row", "en", "s1"), (5, "same row", "en", "s1"),
                   (7, "long " * 50_000, "en", "s2"))
    first, again = mixing.with_copies(docs).collect(), mixing.with_copies(docs.repartition(5)).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    assert len(first) == 305 and all(0 <= r.copies <= 2 for r in first)
    taken, target, longest = by_source(first)
    for source in target:
        assert abs(taken[source] - target[source]) <= longest[source]
    assert mixing.mixture(docs.where("false")).collect() == []


def test_mixed_repeats_rows(docs_of, spark):
    docs = docs_of(*[(i // 2, f"text {i // 2}", "en", "s%d" % (i % 5)) for i in range(100)]).withColumnRenamed("lang", "k1")
    copies = defaultdict(int)
    for r in mixing.with_copies(docs).collect():
        copies[r.doc_id, r.source] += r.copies
    got = defaultdict(int)
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    for r in rows.collect():
        got[r.doc_id, r.source] += 1
    assert got == {k: v for k, v in copies.items() if v}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")
def test_many_levels_meet_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 4)
    rows = mixing.with_copies(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    taken, target, longest = by_source(rows)
    assert len(rows) == 200
    for source in target:
        assert abs(taken[source] - target[source]) <= longest[source]
