import os
import random
import re

import pytest

from sitegauge.llm import near_dedup
from sitegauge.llm.components import components

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same or (both and 100 * both >= 85 * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        known = [d for d in (least.get(root(i)), doc_id) if d is not None]
        least[root(i)] = min(known) if known else None
    return sorted(((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def found(docs):
    return sorted(map(tuple, near_dedup.near_duplicates(docs).collect()), key=repr)


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(n)]


def family(rng, n_copies, n_words, changes):
    base = words(rng, n_words)
    out = [" ".join(base)]
    for _ in range(n_copies):
        copy = list(base)
        for _ in range(changes):
            copy[rng.randrange(n_words)] = words(rng, 1)[0]
        out.append(" ".join(copy))
    return out


def test_against_brute_force(docs_of):
    rng = random.Random(5)
    texts = ["", None, " \n\t", "one", "ONE", "two words", "Two Words", "two  words", "a b c", "long " * 20_000,
             "long " * 20_001 + "x", *family(rng, 40, 100, 2), *family(rng, 25, 300, 12), *family(rng, 25, 60, 4),
             *[" ".join(words(rng, 50)) for _ in range(20)]]
    chain = words(rng, 120)
    for step in range(15):
        chain = chain[3:] + words(rng, 3)
        texts.append(" ".join(chain))
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    rows += [rows[12], rows[13], (rows[14][0], "another text of the same document number"), (None, rows[15][1]),
             (None, "alone without number"), (None, "alone without number"), (None, None)]
    docs = docs_of(*rows).withColumnRenamed("lang", "node").withColumnRenamed("source", "lo")
    got, want = found(docs.repartition(3)), brute(rows)
    # a null document without words stands alone, with a null component
    assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None]
    assert len(got) == len(want)
    assert [r[2:] for r in got if r[0] is None and r[1] == 1] == [(None, True)] * 2
    assert found(docs.where("false")) == []


def test_prefix_join_settles_what_leaders_leave(docs_of):
    """Groups whose leader is not linked to all: the prefix join must find the rest."""
    rng = random.Random(8)
    common = words(rng, 140)
    rows = []
    for group in range(12):
        own = common[:118] + words(rng, 22)
        for copy in range(4):
            text = list(own)
            text[-1 - copy] = "changed%d" % copy
            rows.append((100 * copy + group, " ".join(text)))
    assert found(docs_of(*rows)) == brute(rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 4999), (7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 80)} | {5000: 4999}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_five_words_and_a_similarity_of_four_fifths(docs_of):
    """A block of changed words leaves a five-word similarity of 0.806, but 0.825 on three words."""
    import corpus_pipeline

    rng = random.Random(14)
    rows = []
    for group in range(30):
        base = words(rng, 200)
        rows += [(2 * group, " ".join(base)), (2 * group + 1, " ".join(base[:90] + words(rng, 17) + base[107:]))]
    for first in range(2):
        base = words(rng, 200)
        rows += [(100 + 2 * first, " ".join(base)), (101 + 2 * first, " ".join(base[:90] + words(rng, 40) + base[130:]))]
    docs = docs_of(*rows)
    assert all(r[3] for r in found(docs))
    left = sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(docs.sparkSession, docs, "").collect())
    assert left == [2 * group for group in range(30)] + [100, 101, 102, 103]
