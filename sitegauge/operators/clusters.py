"""Topic clusters of issue descriptions: k-means of all corpora and all starts in one loop.

Weights are taken as whole numbers of 1 / ``SCALE`` and centres are rounded down to
them, so sums, distances and ties are exact and do not depend on partitions. A step is
one join of the documents with the centres of their corpus and two sums; several steps
make one job, and corpora and starts whose centres stay are done.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge.functions.numbers import ratio, round_even
from sitegauge.functions.skew import top_per_group
from sitegauge.operators import keywords as T
from sitegauge.session import stage, stage_steps

STARTS = 10
SCALE = 1 << 20
MOST_CLUSTERS = 6
STEPS_A_JOB = 4
#: Steps after which a corpus that still moves is left as it is; a multiple of ``STEPS_A_JOB``.
MOST_STEPS = 60


def cluster_count(n_docs: int) -> int:
    return min(max(2, n_docs // 3), MOST_CLUSTERS)


def _cluster_count(n_docs: Column) -> Column:
    return F.least(F.greatest(F.lit(2), F.floor(n_docs / 3)), F.lit(MOST_CLUSTERS)).cast("int")


def doc_vectors(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(corpus, doc_id, terms): per document its weighted vocabulary terms, none without a known term."""
    weighted = F.struct(F.col("term_no").alias("t"), F.rint(F.col("weight") * SCALE).cast("long").alias("w"))
    by_doc = weights.groupBy("corpus", "doc_id").agg(F.sort_array(F.collect_list(weighted)).alias("terms"))
    return docs.select("corpus", "doc_id").join(by_doc, ["corpus", "doc_id"], "left").select(
        "corpus", "doc_id", F.coalesce("terms", F.array().cast("array<struct<t:int,w:bigint>>")).alias("terms"))


def _seeds(vectors: DataFrame) -> DataFrame:
    """(corpus, start, centers): per start the k documents of least hash."""
    sizes = vectors.groupBy("corpus").agg(_cluster_count(F.count("*")).alias("k"))
    drawn = vectors.select("corpus", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))).alias("start")).withColumn(
        "draw", F.md5(F.concat_ws("|", "start", "doc_id")))
    first = top_per_group(drawn, ["corpus", "start"], [F.col("draw"), F.col("doc_id")], MOST_CLUSTERS, "nth")
    dense = ("transform(sequence(1, {0}), i -> coalesce(try_element_at(map_from_entries(terms), i), 0L))"
             .format(K.VOCABULARY_SIZE))
    return (first.join(sizes, "corpus").where(F.col("nth") <= F.col("k")).join(vectors, ["corpus", "doc_id"])
            .groupBy("corpus", "start").agg(F.sort_array(F.collect_list(F.struct("nth", F.expr(dense).alias("at")))).alias("c"))
            .select("corpus", "start", F.col("c.at").alias("centers")))


def _placed(vectors: DataFrame, state: DataFrame) -> DataFrame:
    """Every document with its nearest centre of every start, the first of equal ones, and its cost.

    The cost is the squared distance without the document's own length, which is the
    same for all centres.
    """
    far = ("transform(centers, c -> aggregate(c, 0L, (s, v) -> s + v * v)"
           " - 2 * aggregate(terms, 0L, (s, x) -> s + x.w * c[x.t - 1]))")
    return (vectors.join(state, "corpus")
            .select("corpus", "start", "doc_id", "terms", F.size("centers").alias("k"), F.expr(far).alias("far"))
            .select("corpus", "start", "doc_id", "terms", "k", F.array_min("far").alias("cost"),
                    (F.array_position("far", F.array_min("far")) - 1).cast("int").alias("cluster")))


def _step(vectors: DataFrame, state: DataFrame) -> DataFrame:
    """Centres moved to the mean of their documents; one without documents goes to the origin.

    Term 0 counts the documents of a cluster, so one sum serves both.
    """
    cell = "explode(concat(array(named_struct('t', 0, 'w', 1L)), terms)) as x"
    sums = (_placed(vectors, state).selectExpr("corpus", "start", "k", "cluster", cell)
            .groupBy("corpus", "start", "k", "cluster", "x.t").agg(F.sum("x.w").alias("w")))
    width = K.VOCABULARY_SIZE + 1
    cells = sums.groupBy("corpus", "start", "k").agg(F.map_from_entries(F.collect_list(
        F.struct((F.col("cluster") * width + F.col("t")).alias("at"), "w"))).alias("m"))
    mean = (f"transform(sequence(0, k - 1), c -> transform(sequence(1, {width - 1}), t -> "
            f"coalesce(try_element_at(m, c * {width} + t) div try_element_at(m, c * {width}), 0L)))")
    return cells.selectExpr("corpus", "start", f"{mean} as centers")


def fit(vectors: DataFrame) -> DataFrame:
    """(corpus, doc_id, cluster): the best of ``STARTS`` seeded starts by cost, of equal ones the first.

    Documents that are all alike are all in cluster 0.
    """
    state, done, steps = stage(_seeds(vectors), "centers"), [], 0
    while steps < MOST_STEPS and not state.isEmpty():
        moved = state
        for _ in range(STEPS_A_JOB):
            moved = _step(vectors, moved)
        steps += STEPS_A_JOB
        both = stage_steps(moved.join(state.withColumnRenamed("centers", "before"), ["corpus", "start"]), "centers")
        stays = F.col("centers") == F.col("before")
        done.append(both.where(stays).drop("before"))
        state = both.where(~stays).drop("before")
    final = reduce(DataFrame.unionByName, [*done, state])
    placed = stage(_placed(vectors, final).drop("terms", "k"), "placed")
    costs = placed.groupBy("corpus", "start").agg(F.sum("cost").alias("cost"))
    best = costs.groupBy("corpus").agg(F.min(F.struct("cost", "start")).alias("b")).select("corpus", F.col("b.start").alias("start"))
    return placed.join(best, ["corpus", "start"]).select("corpus", "doc_id", "cluster")


def issue_clusters(issues: DataFrame, corpus: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues with ``corpus`` and ``cluster``, term weights).

    The given table is one corpus, or has one per value of the column ``corpus`` (the
    site), all of which are clustered together. Corpora with fewer than three issues have
    no clusters; ``keywords.text_guard`` lists them with a message.
    """
    docs = T.enough_docs(T.issue_docs(issues, corpus))
    weights = stage(T.tfidf(T.tokens(docs), single_corpus=corpus is None), "weights")
    labels = stage(fit(stage(doc_vectors(docs, weights), "vectors")), "clusters")
    keyed = issues.withColumn("doc_id", F.concat_ws("|", "site", "module", "issue_type"))
    return keyed.join(labels, "doc_id"), weights


def cluster_counts(clustered: DataFrame, column: str) -> DataFrame:
    """Issues per cluster and value of ``column`` (module, severity)."""
    return clustered.groupBy("cluster", column).agg(F.count("*").alias("count"))


def cluster_profile(clustered: DataFrame, weights: DataFrame) -> DataFrame:
    """Label, terms, size, share, examples, modules and severities per cluster."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("count"))
    total = sizes.groupBy().agg(F.sum("count").alias("all_issues"))
    sums = (weights.join(clustered.select("doc_id", "cluster"), "doc_id")
            .groupBy("cluster", "term").agg(round_even(F.sum("weight"), 9).alias("score"))
            .where(F.col("score") > 0))
    terms = _joined(top_per_group(
        sums, ["cluster"], [F.desc("score"), F.asc("term")], 5), "term", "keywords")
    examples = _joined(top_per_group(
        clustered.select("cluster", "site", "first_seen", "doc_id", "description"), ["cluster"],
        [F.col("site"), F.col("first_seen"), F.col("doc_id")], 3), "description", "examples")
    modules = _joined(top_per_group(
        cluster_counts(clustered, "module"), ["cluster"], [F.desc("count"), F.asc("module")], 3)
        .withColumn("text", F.concat("module", F.lit(": "), F.col("count").cast("string"))),
        "text", "top_modules")
    severities = cluster_counts(clustered, "severity").groupBy("cluster").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "count"))))
        .alias("severities"))
    head = F.coalesce(F.try_element_at("keywords", F.lit(1)), F.lit("issues"))
    all_issues = total.first()["all_issues"]
    return (sizes.join(terms, "cluster", "left").join(examples, "cluster")
            .join(modules, "cluster").join(severities, "cluster")
            .select("cluster",
                    F.concat(F.lit("Cluster "), (F.col("cluster") + 1).cast("string"), F.lit(": "), head)
                    .alias("label"),
                    "keywords", "count", ratio(F.col("count"), F.lit(all_issues)).alias("share"),
                    (F.col("count") < K.SMALL_SAMPLE_BELOW).alias("small_sample"),
                    "examples", "top_modules", "severities"))


def _joined(ranked: DataFrame, column: str, name: str) -> DataFrame:
    """Array of a column's ranked values per cluster (a handful of rows each)."""
    return ranked.groupBy("cluster").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", column))), lambda x: x[column]).alias(name))
