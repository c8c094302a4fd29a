import hashlib
import random
import math
from collections import Counter

import duckdb
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge import schemas
from sitegauge.operators import clusters, forest
from sitegauge.operators import keywords as T
from sitegauge.operators.issues import enrich
from sitegauge.plans import oracle

# texts with the words that cleaning must leave, written out by hand
CLEANED = [
    ("Page 'https://a.test/x' has no <title> tag — impacts SEO.", ["title", "seo"]),
    ("Slow page loaded slow, LOADED again", ["slow", "loaded", "slow", "loaded", "again"]),
    ("https://only.url", ["issue"]),
    ("", ["issue"]),
    (None, ["issue"]),
    ("missing viewport meta — not mobile-responsive", ["missing", "viewport", "meta", "mobile", "responsive"]),
    ("Ünïcode wörds x1y2 abc", ["code", "rds", "abc"]),
    ("loaded slow again http://x after space", ["loaded", "slow", "again", "after", "space"]),
]
TEXTS = [text for text, _ in CLEANED]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([("all", f"d{i}", t) for i, t in enumerate(texts)],
                                 "corpus string, doc_id string, text string")


def test_tokens(spark):
    got = {r.doc_id: r.words for r in T.tokens(docs(spark)).collect()}
    assert got == {f"d{i}": words for i, (_, words) in enumerate(CLEANED)}


def brute_weights(word_lists, size):
    terms = []
    for w in word_lists:
        terms.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    totals, df = Counter(), Counter()
    for t in terms:
        totals.update(t)
        df.update(t.keys())
    vocabulary = sorted(totals, key=lambda t: (-totals[t], t))[:size]
    result = {}
    for i, t in enumerate(terms):
        raw = {v: t[v] * (math.log((1 + len(terms)) / (1 + df[v])) + 1) for v in vocabulary if t[v]}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        result.update({(f"d{i}", v): x / norm for v, x in raw.items()})
    return result


@pytest.mark.parametrize("single", [True, False])
def test_tfidf_matches_brute_force(spark, single):
    more = [[f"word{chr(97 + i)}", "shared", "text", f"number{chr(97 + i % 7)}"] for i in range(26) for _ in range(i % 3 + 1)]
    texts = TEXTS + [" ".join(words) for words in more]
    expected = brute_weights([words for _, words in CLEANED] + more, K.VOCABULARY_SIZE)
    weights = T.tfidf(T.tokens(docs(spark, texts)), single_corpus=single)
    got = {(r.doc_id, r.term): r.weight for r in weights.collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    sums = Counter()
    for (_, term), w in expected.items():
        sums[term] += w
    best = sorted(sums, key=lambda t: (-round(sums[t], 9), t))[:20]
    top = T.top_keywords(weights).orderBy("rank").collect()
    assert [r.keyword for r in top] == best
    assert top[0].score == round(sums[best[0]], 3)
    assert all(r.cloud_weight == max(r.score * 100, 1) for r in top)


def test_vocabulary_drops_no_frequent_pair(spark):
    lists = [[f"w{'abcdefghij'[(i * k) % 10]}x{'abc'[k % 3]}y" for k in range(1, i % 9 + 2)] for i in range(60)]
    found = T.vocabulary(T.tokens(docs(spark, [" ".join(words) for words in lists])), 7).collect()
    counted = Counter()
    for w in lists:
        counted.update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    assert sorted(r.term for r in found) == sorted(sorted(counted, key=lambda t: (-counted[t], t))[:7])


def test_text_guard(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("a", "2", "x"), ("b", "1", "x"), ("b", "2", "x"), ("b", "3", "x")],
                               "corpus string, doc_id string, text string")
    assert {r.corpus for r in T.enough_docs(df).collect()} == {"b"}
    assert {r.corpus: r.error for r in T.text_guard(df).collect()} == {"a": "Need ≥ 3 issues for NLP analysis.", "b": None}


def issue_table(spark, n, severity=lambda i: "High" if i % 3 == 0 else "Low", text=lambda i: f"kind {'slow load' if i % 2 else 'broken link'}"):
    rows = [("s", i, f"u{i}", f"mod {chr(97 + i % 26)}{i // 26}", f"type {i % 5}", severity(i), "Open", i % 4 + 1,
             float(i % 6), text(i), "crawl_seo") for i in range(n)]
    return enrich(spark.createDataFrame(rows, schemas.ISSUES))


def test_clusters(spark):
    assert [clusters.cluster_count(n) for n in (3, 8, 9, 18, 500)] == [2, 2, 3, 6, 6]
    assert clusters.issue_clusters(issue_table(spark, 2))[0].collect() == []
    found = issue_table(spark, 8).withColumn("first_seen", F.col("id"))
    clustered, weights = clusters.issue_clusters(found)
    groups = {}
    for r in clustered.collect():
        groups.setdefault(r.cluster, set()).add(r.description)
    assert sorted(map(len, groups.values())) == [1, 1]
    profile = clusters.cluster_profile(clustered, weights).collect()
    assert sum(r["count"] for r in profile) == 8 and abs(sum(r.share for r in profile) - 1) < 1e-9
    for r in profile:
        assert r.small_sample and len(r.examples) == 3 and r.label == f"Cluster {r.cluster + 1}: {r.keywords[0]}"
        assert sum(r.severities.values()) == r["count"]


def lloyd(vectors, starts):
    """Brute force: the best of the seeded starts in whole numbers, by the documents' dense vectors."""
    best = None
    k = clusters.cluster_count(len(vectors))
    for start in range(starts):
        drawn = sorted(vectors, key=lambda d: (hashlib.md5(f"{start}|{d}".encode()).hexdigest(), d))[:k]
        centers = [list(vectors[d]) for d in drawn]
        for _ in range(60):
            far = {d: [sum(a * a for a in c) - 2 * sum(a * b for a, b in zip(c, v)) for c in centers]
                   for d, v in vectors.items()}
            label = {d: f.index(min(f)) for d, f in far.items()}
            moved = []
            for i in range(k):
                held = [vectors[d] for d in vectors if label[d] == i]
                moved.append([sum(x) // len(held) for x in zip(*held)] if held else [0] * 100)
            if moved == centers:
                break
            centers = moved
        cost = sum(min(f) for f in far.values())
        if best is None or cost < best[0]:
            best = cost, label
    return best[1]


def test_all_corpora_are_clustered_in_one_loop(spark):
    """Random documents of a large, a small and a uniform corpus, and one that is too small."""
    rng = random.Random(5)
    docs = [("large", f"l{i:03d}", sorted(rng.sample(range(1, 101), rng.randint(0, 8)))) for i in range(80)]
    docs += [("small", f"s{i}", [1 + i % 2, 50]) for i in range(4)] + [("same", f"e{i}", [3, 4]) for i in range(9)]
    rows = [(c, d, [(t, rng.randint(1, clusters.SCALE) if c == "large" else 500_000) for t in terms]) for c, d, terms in docs]
    vectors = spark.createDataFrame(rows, "corpus string, doc_id string, terms array<struct<t:int,w:bigint>>")
    got = {(r.corpus, r.doc_id): r.cluster for r in clusters.fit(clusters.stage(vectors, "test")).collect()}
    for corpus in ("large", "small", "same"):
        dense = {d: [dict(terms).get(t, 0) for t in range(1, 101)] for c, d, terms in rows if c == corpus}
        assert {d: got[corpus, d] for d in dense} == lloyd(dense, clusters.STARTS), corpus
    assert {v for (c, _), v in got.items() if c == "same"} == {0}


def test_category_codes_are_alphabetical(spark):
    values = [f"{a}{b}" for a in "zéBa " for b in range(40)]
    df = spark.createDataFrame([(v,) for v in values * 2], "m string").repartition(7)
    got = {r.value: r.code for r in forest.category_codes(df, "m").collect()}
    assert got == {v: float(i) for i, v in enumerate(sorted(set(values)))}


def test_split_sizes():
    assert forest.test_sizes({0: 7, 1: 3}) == {0: 2, 1: 1}
    assert forest.test_sizes({0: 100, 1: 50}) == {0: 30, 1: 15}
    assert sum(forest.test_sizes({0: 8, 1: 3}).values()) == math.ceil(11 * 0.3)


def test_split_is_exact_and_order_free(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("label"), F.concat(F.lit("k"), "id").alias("row_key"))
    one = {r.row_key for r in forest.stratified_split(df.repartition(1)).where("is_test").collect()}
    assert one == {r.row_key for r in forest.stratified_split(df.repartition(7)).where("is_test").collect()}
    assert len(one) == 1500 and sum(int(k[1:]) % 3 == 0 for k in one) == 500


def test_split_of_equal_keys_is_exact(spark):
    """One key holds most rows; the hashes of their places still cut the class exactly."""
    df = spark.range(9000).select(F.lit(0).alias("label"), F.when(F.col("id") < 7000, "hot").otherwise(
        F.concat(F.lit("k"), "id")).alias("row_key"))
    both = df.unionByName(df.limit(11).withColumn("label", F.lit(1)))
    got = forest.stratified_split(both.repartition(5)).groupBy("label").agg(
        F.count_if("is_test").alias("n"), F.count("*").alias("rows")).collect()
    # 2704 of 9011 rows are test rows; the classes keep 6299.3 and 7.7 rows, so 6299 and 8
    assert {r.label: (r.n, r.rows) for r in got} == {0: (2701, 9000), 1: (3, 11)}
    empty = forest.stratified_split(both.where("false"))
    assert "is_test" in empty.columns and empty.count() == 0


def test_hash_cuts_select_by_digits(spark):
    hashes = sorted([f"abcabcabc{i:055x}" for i in range(500)] + [f"{i:03x}{i:061x}" for i in range(300)])
    hashed = spark.createDataFrame([(i % 2, h) for i, h in enumerate(hashes)], "label int, h string")
    for take in ({0: 0, 1: 400}, {0: 1, 1: 399}, {0: 217, 1: 151}):
        cuts = forest.hash_cuts(hashed, take)
        assert {c: sum(h < cuts[c] for i, h in enumerate(hashes) if i % 2 == c) for c in take} == take


def test_split_sorts_and_ranks_nothing(spark):
    df = spark.range(100).select((F.col("id") % 2).cast("int").alias("label"), F.col("id").cast("string").alias("row_key"))
    plan = forest.stratified_split(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Sort", "Window", "Exchange", "Join"))


def test_node_table_scores_as_the_model(spark):
    """The walk along the nodes, the library's own prediction and SQL over the same table agree."""
    model = forest.train(issue_table(spark, 400))
    rows = forest.prepare(issue_table(spark, 400))[0].drop("is_test")
    p = vector_to_array("probability")
    want = {r.row_key: (r.p0, r.p1, r.v) for r in model.model.transform(forest._assemble(rows)).select(
        "row_key", p[0].alias("p0"), p[1].alias("p1"), F.col("prediction").cast("int").alias("v")).collect()}
    got = {r.row_key: r for r in forest.with_probabilities(model.nodes, rows).collect()}
    assert set(got) == set(want) and len(got) == 400
    for key, (p0, p1, verdict) in want.items():
        assert got[key].proba_not_critical == pytest.approx(p0, abs=1e-12)
        assert got[key].proba_critical == pytest.approx(p1, abs=1e-12)
        assert abs(p0 - p1) < 1e-12 or got[key].predicted == verdict
    importances = forest.feature_importance(model.nodes).collect()
    assert [r.feature for r in importances] != [] and {r.feature: r.importance for r in importances} == pytest.approx(
        {label: v for (_, label), v in zip(K.FEATURE_LABELS, model.model.featureImportances.toArray())}, abs=1e-9)
    con = duckdb.connect()
    con.register("nodes", model.nodes.toArrow())
    con.register("rows", rows.toArrow())
    for key, p0, p1 in con.execute(oracle.walked(f"select row_key as key, {oracle._X} as x from rows", "nodes",
                                                 K.FOREST_TREES, K.FOREST_DEPTH)).fetchall():
        assert (got[key].proba_not_critical, got[key].proba_critical) == pytest.approx((p0, p1), abs=1e-12)
    assert {f: i for f, i, _ in con.execute(oracle.importance("nodes")).fetchall()} == pytest.approx(
        {r.feature: r.importance for r in importances}, abs=1e-12)


def test_walk_of_a_small_forest(spark):
    """Two trees by hand: a tie is not critical, a missing number counts as 0, unsplit trees vote too."""
    nodes = spark.createDataFrame(
        [(0, 0, 2, 1.5, 1, 2, 0.5, 10.0, 0.5, 0.5), (0, 1, -1, None, -1, -1, -1.0, 6.0, 1.0, 0.0),
         (0, 2, -1, None, -1, -1, -1.0, 4.0, 0.0, 1.0), (1, 0, -1, None, -1, -1, -1.0, 10.0, 0.0, 1.0)],
        "tree int, node int, feature int, threshold double, below int, above int, gain double, weight double,"
        " share_0 double, share_1 double")
    rows = spark.createDataFrame([(k, 0.0, 0.0, o, 0.0, 0.0) for k, o in (("a", 1.0), ("b", 2.0), ("c", float("nan")))],
                                 "k string, " + ", ".join(f"{f} double" for f in forest.FEATURES))
    got = {r.k: (r.proba_critical, r.predicted) for r in forest.with_probabilities(nodes, rows, 2, 2).collect()}
    assert got == {"a": (0.5, 0), "b": (1.0, 1), "c": (1.0, 1)}
    assert {r.feature: r.importance for r in forest.feature_importance(nodes).collect()} == {
        label: float(i == 2) for i, (_, label) in enumerate(K.FEATURE_LABELS)}


def test_forest_guard_and_one_class_repair(spark):
    with pytest.raises(ValueError, match="8 issues"):
        forest.train(issue_table(spark, 7))
    rows, _, _ = forest.prepare(issue_table(spark, 8, severity=lambda i: "Low"))
    labels = Counter((r.label, r.augmented) for r in rows.collect())
    assert labels == {(0, False): 8, (0, True): 7, (1, True): 1}


def test_forest_end_to_end(spark):
    table = issue_table(spark, 120)
    model = forest.train(table)
    matrix = forest.confusion(model.scored_test)
    cells = [(r.predicted_0, r.predicted_1) for r in matrix.orderBy("actual").collect()]
    assert sum(map(sum, cells)) == math.ceil(120 * 0.3)
    cards = forest.model_cards(model.scored_test).first()
    assert cards.test_rows == 36 and cards.accuracy == round((cells[0][0] + cells[1][1]) / 36, 4)
    assert abs(sum(r.importance for r in forest.feature_importance(model.nodes).collect()) - 1) < 1e-9
    report = {r["class"]: r for r in forest.classification_report(matrix).collect()}
    assert set(report) == {"0", "1", "macro avg", "weighted avg"} and report["macro avg"].support == 36
    inputs = spark.createDataFrame([("mod a0", "type 0", 1, 2.0, "High"), ("never seen", "new", 1, 2.0, "High"),
                                    ("mod a0", "type 0", 1, 2.0, "Odd")], schemas.SCORING_INPUT)
    # 'mod a0' and 'type 0' have code 0, as unseen values do
    got = {(r.module, r.severity): r for r in forest.score(model, inputs).collect()}
    assert got["mod a0", "High"].proba_critical == got["never seen", "High"].proba_critical
    assert got["mod a0", "High"].prediction == "Critical" and got["mod a0", "Odd"].prediction == "Not Critical"


def test_report_on_known_matrix(spark):
    matrix = spark.createDataFrame([(0, 5, 1), (1, 0, 0)], "actual int, predicted_0 long, predicted_1 long")
    got = {r["class"]: (r.precision, r.recall, r.support) for r in forest.classification_report(matrix).collect()}
    assert got["0"] == (1.0, 5 / 6, 6) and got["1"] == (0.0, 0.0, 0)
    assert got["weighted avg"][2] == 6
