import math
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sitegauge.llm import quality

SF = "/root/testdata/sf0.001"


def grams(text):
    data = b"\xff" * 3 + text.encode()
    return [data[i - 3:i + 1] for i in range(3, len(data))]


class Model:
    """Interpolated modified Kneser-Ney over byte 4-grams, with dictionaries."""

    def __init__(self, texts):
        counts = Counter(g for t in texts for g in grams(t))
        self.own, self.rest = {}, {}
        for order in range(4, 0, -1):
            f = [sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)]
            y = f[0] / max(f[0] + 2 * f[1], 1)
            d = [max(0.05, min(k - 0.05, k - (k + 1) * y * f[k] / max(f[k - 1], 1))) for k in (1, 2, 3)]
            total, left = defaultdict(float), defaultdict(float)
            for g, n in counts.items():
                total[g[:-1]] += n
                left[g[:-1]] += d[min(n, 3) - 1]
            for g, n in counts.items():
                self.own[g] = (n - d[min(n, 3) - 1]) / total[g[:-1]]
            for c in total:
                self.rest[order, c] = left[c] / total[c]
            counts = Counter(g[1:] for g in counts)

    def perplexity(self, text):
        logs = []
        for g in grams(text):
            p = 1 / 256
            for order in range(1, 5):
                s = g[4 - order:]
                p = self.own.get(s, 0.0) + self.rest.get((order, s[:-1]), 1.0) * p
            logs.append(math.log(p))
        return math.exp(-sum(logs) / len(logs))


ROWS = [(i, f"the cat {i} sat on the mat and the dog {i * 7} ran to the {'big' if i % 2 else 'small'} house", "en") for i in range(40)]
ROWS += [(100 + i, f"der hund {i} lief über die straße nach haus", "de") for i in range(20)]
ROWS += [(200, "XQ## ZZKW!! @@PPQ VVW## QQXZ", "en"), (201, "XQ## ZZKW!! @@PPQ VVW## QQXZ", "de"), (202, "", "en"),
         (203, None, "en"), (204, "no trusted text here", "xx"), (205, "no language", None), (206, ROWS[2][1] * 900, "en"),
         (3, ROWS[3][1], "en"), (None, "the cat sat on the mat", "en"), (None, "the cat sat on the mat", "en")]


@pytest.fixture
def labels(spark):
    rows = [(r[0], 1, 0) for r in ROWS[:60]] + [(200, 0, 0), (None, 1, 0), (3, 1, 0), (203, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_against_dictionaries(docs_of, labels, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_CHARS", 500)
    docs = docs_of(*ROWS).withColumnRenamed("source", "gram")
    scored = quality.perplexities(docs.repartition(3), labels).collect()
    held = {r.doc_id for r in scored if r.held_out}
    assert len(scored) == len(ROWS) and 0 < len(held) < 40
    text_of = {(r[0], r[2] or ""): r[1] for r in ROWS}
    models = {lang: Model([t for d, t, la in ROWS[:60] if la == lang and d not in held]) for lang in ("en", "de")}
    models["en"] = Model([t for d, t, la in ROWS[:60] + [ROWS[3]] * (3 not in held) if la == "en" and d not in held])
    for r in scored:
        text = text_of[r.doc_id, r.lang]
        if not text or r.lang not in models:
            assert r.perplexity is None
        else:
            assert r.perplexity == pytest.approx(models[r.lang].perplexity(text), rel=1e-5)


def test_rejects_junk_and_keeps_the_rest(docs_of, labels):
    docs = docs_of(*ROWS).withColumn("kept", F.lit("mine")).withColumn("threshold", F.lit(1))
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns
    gone = {r[0] for r in ROWS} - {r.doc_id for r in kept.collect()}
    assert gone == {200, 201}
    assert quality.judged(docs.where("false"), labels).collect() == []
    assert {r.kept for r in quality.judged(docs, labels.where("false")).collect()} == {True}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")
def test_given_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.judged(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    rows = judged.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] >= 0.98 and kept[0] <= 0.4


def test_repeated_words():
    texts = ["The the THE the", "a b a b a b", "a b c d", "", "one two one three one", "x y z x y z x", "x x"]
    data, offsets = quality.W.bytes_of(quality.pa.array(texts))
    n, repeats = quality._repeats(data, offsets)
    assert list(n) == [4, 6, 4, 0, 5, 7, 2] and list(repeats) == [3, 3, 0, 0, 0, 2, 1]


def test_rejects_repeated_ordinary_words(docs_of, labels):
    junk = [(300, "the " * 60, "en"), (301, "the cat sat on " * 20, "en"), (302, "hund " * 60, "de")]
    judged = quality.judged(docs_of(*ROWS[:60], *junk, (303, "the the cat sat on the mat", "en")), labels).collect()
    assert {r.doc_id for r in judged if not r.kept} == {300, 301, 302}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")
def test_repeated_word_junk_of_given_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    rows = quality.judged(docs, labels).join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] >= 0.98 and kept[0] <= 0.04


def test_a_language_of_few_trusted_documents_has_a_threshold(spark, docs_of):
    """No document is held out by hash: the one with the least hash is, but for a language of a single one."""
    drawn = spark.range(1000, 1100).selectExpr("id", f"pmod(xxhash64('held out', id), {quality.HELD_OUT}) = 0 as held")
    ids = [r.id for r in drawn.where("not held").limit(4).collect()]
    texts = ["der hund und die katze sind im haus", "die katze und der hund sind im garten", "das haus ist im garten"]
    rows = [(i, t, "de") for i, t in zip(ids, texts)] + [(ids[3], "le chat est dans la maison", "fr")]
    rows += [(1, "zzzz qqqq xxxx", "de"), (2, "der hund ist im haus", "de"), (3, "zzzz qqqq xxxx", "fr")]
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    judged = {r.doc_id: r for r in quality.judged(docs_of(*rows), labels).collect()}
    assert {i: r.kept for i, r in judged.items()} == {**dict.fromkeys(ids, True), 1: False, 2: True, 3: True}
    assert judged[1].threshold > 0 and judged[3].threshold is None
