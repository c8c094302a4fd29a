import zlib
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from sitegauge.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(digests):
    """All levels of a tree, the given digests first."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def climb(tree, idx, own):
    """The siblings on the way up, and what ``own`` in place of a node leads to."""
    beside = []
    for level in tree[:-1]:
        start = idx - idx % 3
        left, right = level[start:idx], level[idx + 1:start + 3]
        beside += left + right
        own, idx = h(*left, own, *right), idx // 3
    return beside, own


def expected(rows):
    """Brute force over (doc_id, source, lang, n_chars, text)."""
    of_source = defaultdict(list)
    for row in rows:
        of_source[row[1]].append(row)
    order = sorted(of_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        held = sorted(of_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((held, levels([leaf(r) for r in held])))
    upper = levels([tree[-1][0] for _, tree in trees])
    out = []
    for k, (held, tree) in enumerate(trees):
        for i, row in enumerate(held):
            own = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                own = leaf((*row[:4], row[4].replace("\n", "")))
            beside, subroot = climb(tree, i, own)
            above, root = climb(upper, k, subroot)
            out.append((row[0], leaf(row), tree[-1][0], upper[-1][0], h(*beside, *above), root, root == upper[-1][0]))
    return sorted(out, key=repr)


def found(docs):
    return sorted(map(tuple, merkle.audited(docs).collect()), key=repr)


ROWS = [(i, f"line {i}\nline" if i % 3 else f"no line end {i}", "en", ["web", "books", "ärzte", "z"][min(i % 10, 3)])
        for i in range(100)] + [
    (200, None, None, None), (201, "x\ny", "de", None), (None, "no id\n", "en", "web"), (None, "no id\n", "en", "web"),
    (None, "another", "en", "web"), (300, "", "en", "lone"), (301, "\n\n", "en", ""), (5, "same id\n", "en", "web"),
    (5, "same id\n", "en", "web"), (400, "long\n" * 20000, "en", "books")]


def full(rows):
    return [(r[0], r[3], r[2], len(r[1] or ""), r[1]) for r in rows]


def test_against_brute_force(docs_of):
    docs = docs_of(*ROWS).withColumn("tree", F.lit("mine")).withColumn("idx", F.lit(3)).repartition(3)
    assert found(docs) == expected(full(ROWS))


def test_small_trees(docs_of):
    for n in (1, 2, 3, 4, 9, 10):
        rows = [(i, f"{i}\n{i}", "en", "s") for i in range(n)]
        assert found(docs_of(*rows)) == expected(full(rows))
    assert found(docs_of((1, "x", "en", "s")).where("false")) == []


def test_several_rounds_and_many_sources(spark):
    big, small = merkle.CHUNK * 2 + 5, 500
    docs = spark.range(big + small).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t\n"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") < big, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id"))).alias("source"),
        F.lit(4).cast("long").alias("n_chars"))
    rows = [(i, "hot" if i < big else f"s{i}", "en", 4, f"t\n{i}") for i in range(big + small)]
    assert found(docs.repartition(5)) == expected(rows)


def test_manifest_verifies_rows(docs_of):
    rows = [(i, f"text {i}", "en", f"s{i % 4}") for i in range(50)]
    manifest = merkle.proofs(docs_of(*rows))
    changed = docs_of(*[(i, "other" if i == 7 else t, lang, source) for i, t, lang, source in rows])
    assert {r.doc_id for r in merkle.verify(changed, manifest).collect() if not r.verified} == {7}
    assert all(r.verified for r in merkle.verify(docs_of(*rows), manifest).collect())
