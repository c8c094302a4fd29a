"""Issue-criticality classifier with Spark ML."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge.functions.numbers import ratio, round_even
from sitegauge.session import checkpoint_root, stage

FEATURES = [name for name, _ in K.FEATURE_LABELS]
_BUCKET_DIGITS = 3  # 16**3 hash buckets


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): alphabetical index of the distinct values, from 0.

    Values are range-sorted over all tasks and written with their task-local
    position; only the row count per task is gathered. Any number of values works.
    """
    spark = df.sparkSession
    ordered = df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value")
    placed = stage(ordered.select(
        "value", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), "codes")
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    offsets, start = [], 0
    for part, count in sizes:
        offsets.append((part, start))
        start += count
    starts = spark.createDataFrame(offsets, "part int, start long")
    return placed.join(F.broadcast(starts), "part").select(
        "value", (F.col("start") + F.col("pos")).cast("double").alias("code"))


def encode(df: DataFrame, modules: DataFrame, types: DataFrame) -> DataFrame:
    """Add the five numeric features; an unseen module or type gets code 0."""
    number = lambda c: F.coalesce(
        F.col(c).try_cast("double") if c in df.columns else F.lit(0.0), F.lit(0.0))
    coded = (df
             .join(modules.select(F.col("value").alias("module"), F.col("code").alias("module_enc")),
                   "module", "left")
             .join(types.select(F.col("value").alias("issue_type"), F.col("code").alias("type_enc")),
                   "issue_type", "left"))
    return coded.withColumns({
        "module_enc": F.coalesce("module_enc", F.lit(0.0)),
        "type_enc": F.coalesce("type_enc", F.lit(0.0)),
        **{c: number(c) for c in ("occurrences", "fix_time_hours", "severity_weight")}})


def two_classes(df: DataFrame) -> DataFrame:
    """Add ``augmented``; with one class only, append a copy whose first label is flipped."""
    known = df.agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                   F.min("row_key").alias("first")).first()
    marked = df.withColumn("augmented", F.lit(False))
    if known["lo"] != known["hi"]:
        return marked
    flipped = F.when(F.col("row_key") == known["first"], 1 - F.col("label")).otherwise(F.col("label"))
    copy = df.withColumns({"label": flipped, "augmented": F.lit(True),
                           "row_key": F.concat(F.col("row_key"), F.lit("|copy"))})
    return marked.unionByName(copy)


def test_sizes(counts: dict[int, int]) -> dict[int, int]:
    """Test rows per class: 30 % rounded up in total, shared out by largest remainder."""
    total = sum(counts.values())
    train = total - math.ceil(total * 0.3)
    quota = {c: n * train / total for c, n in counts.items()}
    kept = {c: math.floor(q) for c, q in quota.items()}
    for c in sorted(quota, key=lambda c: (kept[c] - quota[c], c))[:train - sum(kept.values())]:
        kept[c] += 1
    return {c: counts[c] - kept[c] for c in counts}


def split_hash(key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{K.SEED}|"), F.coalesce(key, F.lit(""))))


def stratified_split(df: DataFrame) -> DataFrame:
    """Add boolean ``is_test``: exactly the class shares of a 70/30 split, by hash order.

    Rows are staged with a hash of their key, followed by one of their place, which tells
    rows of equal keys apart. The hash that cuts a class is selected by its digits, so no
    row is ranked or sorted, and the split itself is a comparison in the row.
    """
    place = F.md5(F.monotonically_increasing_id().cast("string"))
    hashed = stage(df.withColumn("h", F.concat(split_hash(F.col("row_key")), place)), "split")
    counts = {r["label"]: r["count"] for r in hashed.groupBy("label").count().collect()}
    cuts = hash_cuts(hashed, test_sizes(counts)) if counts else {0: ""}
    cut = F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv])
    return hashed.withColumn("is_test", F.col("h") < cut[F.col("label")]).drop("h")


def hash_cuts(hashed: DataFrame, take: dict[int, int]) -> dict[int, str]:
    """Per label a text that is above the first ``take`` hashes and below all others.

    Radix selection: the rows that share the cut's known digits are counted by the next
    three, at most 4096 counts per label, until the cut falls between two counts. The
    rows to count shrink 4096-fold each time; distinct hashes end it.
    """
    cuts = {label: "" for label in take}
    left = {label: n for label, n in take.items() if n > 0}
    digits = 0
    while left:
        digits += _BUCKET_DIGITS
        known = F.create_map(*[F.lit(x) for label in left for x in (label, cuts[label])])
        counts = (hashed.where(F.col("h").startswith(known[F.col("label")]))
                  .groupBy("label", F.substring("h", 1, digits).alias("bucket")).agg(F.count("*").alias("n")))
        buckets = sorted((r["label"], r["bucket"], r["n"]) for r in counts.collect())
        for label in list(left):
            for bucket, n in [(bucket, n) for of, bucket, n in buckets if of == label]:
                if n < left[label]:
                    left[label] -= n
                    continue
                cuts[label] = bucket
                if n == left[label]:
                    cuts[label] += "g"  # above every hexadecimal digit
                    del left[label]
                break
    return cuts


@dataclass
class Forest:
    """Fitted trees as a table of nodes, the category codes and the scored test rows."""

    model: RandomForestClassificationModel
    nodes: DataFrame
    modules: DataFrame
    types: DataFrame
    scored_test: DataFrame


def prepare(issues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(encoded and split rows, module codes, type codes) of an issue table."""
    if issues.limit(K.MIN_ISSUES_FOR_MODEL).count() < K.MIN_ISSUES_FOR_MODEL:
        raise ValueError(K.MODEL_GUARD_MESSAGE)  # ``model_guard`` tells it as a row
    modules, types = category_codes(issues, "module"), category_codes(issues, "issue_type")
    key = F.concat_ws("|", "site", "module", "issue_type")
    rows = encode(issues.select(
        "site", "module", "issue_type", "occurrences", "fix_time_hours", "severity_weight",
        F.col("is_critical").alias("label"), key.alias("row_key")), modules, types)
    return stratified_split(two_classes(rows)), modules, types


def model_guard(issues: DataFrame) -> DataFrame:
    """Number of issues and the message for a table that is too small for a model."""
    return issues.agg(F.count("*").alias("n_issues")).withColumn(
        "error", F.when(F.col("n_issues") < K.MIN_ISSUES_FOR_MODEL, F.lit(K.MODEL_GUARD_MESSAGE)))


def _assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def train(issues: DataFrame) -> Forest:
    """Balanced random forest on 70 % of the issues, with the scored other 30 %."""
    rows, modules, types = prepare(issues)
    training = rows.where(~F.col("is_test"))
    counts = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.create_map(*[F.lit(x) for c, n in counts.items()
                            for x in (c, total / (len(counts) * n))])
    forest = RandomForestClassifier(
        numTrees=K.FOREST_TREES, maxDepth=K.FOREST_DEPTH, seed=K.SEED, weightCol="class_weight",
        featureSubsetStrategy="sqrt")
    model = forest.fit(_assemble(training).withColumn("class_weight", weight[F.col("label")]))
    nodes = node_table(issues.sparkSession, model)
    scored = with_probabilities(nodes, rows.where("is_test"))
    return Forest(model, nodes, modules, types, stage(scored, "scored"))


def node_table(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    """One row per node: its test or, with ``feature`` -1, its class shares.

    The model is saved to the shared folder, where its nodes are a table already.
    """
    path = f"{checkpoint_root(spark).rstrip('/')}/sitegauge/forest-{uuid.uuid4().hex}"
    model.write().session(spark).save(path)
    share = lambda i: F.coalesce(F.get("nodeData.impurityStats", F.lit(i)), F.lit(0.0)) / F.col("weight")
    return (spark.read.parquet(f"{path}/data")
            .withColumn("weight", F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda s, x: s + x))
            .select(F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"),
                    F.col("nodeData.split.featureIndex").alias("feature"),
                    F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
                    F.col("nodeData.leftChild").alias("below"), F.col("nodeData.rightChild").alias("above"),
                    F.col("nodeData.gain").alias("gain"), "weight",
                    share(0).alias("share_0"), share(1).alias("share_1")))


def with_probabilities(nodes: DataFrame, rows: DataFrame, trees: int = K.FOREST_TREES,
                       depth: int = K.FOREST_DEPTH) -> DataFrame:
    """Add the forest's class probabilities, confidence and verdict (0 where both are equal).

    Equal feature values are scored once. They walk all trees at the same time, one
    join with the nodes per level; a forest has at most ``trees`` times
    ``2 ** (depth + 1) - 1`` nodes, 6,300 by default, so these are broadcast. Shares
    are added up as decimals, so their order does not matter.
    """
    small = F.broadcast(nodes)
    value = F.get(F.array(*FEATURES), F.col("feature"))
    following = F.when(F.col("feature") < 0, F.col("node")).when(
        value <= F.col("threshold"), F.col("below")).otherwise(F.col("above"))
    at = rows.select(*FEATURES).distinct().select(
        *FEATURES, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).alias("node"))
    for _ in range(depth):
        at = at.join(small.select("tree", "node", "feature", "threshold", "below", "above"),
                     ["tree", "node"]).select(*FEATURES, "tree", following.alias("node"))
    mean = lambda c: F.sum(F.col(c).cast("decimal(18,15)")).cast("double") / trees
    votes = (at.join(small.select("tree", "node", "share_0", "share_1"), ["tree", "node"])
             .groupBy(*FEATURES)
             .agg(mean("share_0").alias("proba_not_critical"), mean("share_1").alias("proba_critical")))
    return rows.join(votes, FEATURES).withColumns({
        "confidence": F.greatest("proba_not_critical", "proba_critical"),
        "predicted": (F.col("proba_critical") > F.col("proba_not_critical")).cast("int")})


def predictions(scored: DataFrame) -> DataFrame:
    """Verdict and confidence of every test row."""
    return scored.select(F.col("row_key").alias("issue"), F.col("label").alias("actual"), "predicted", "confidence")


def confusion(scored: DataFrame) -> DataFrame:
    """Rows actual, columns predicted, both in the order 0, 1."""
    labels = scored.sparkSession.createDataFrame([(0,), (1,)], "actual int")
    counts = scored.groupBy(F.col("label").alias("actual")).agg(
        F.count_if(F.col("predicted") == 0).alias("predicted_0"),
        F.count_if(F.col("predicted") == 1).alias("predicted_1"))
    return labels.join(counts, "actual", "left").na.fill(0)


def model_cards(scored: DataFrame) -> DataFrame:
    """Accuracy, test size and mean confidence."""
    return scored.agg(
        round_even(ratio(F.count_if(F.col("label") == F.col("predicted")), F.count("*")), 4)
        .alias("accuracy"),
        F.count("*").alias("test_rows"), F.avg("confidence").alias("avg_confidence"))


def classification_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted average."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per_class = F.array(*[_class_counts(i) for i in (0, 1)])
    one_row = matrix.agg(*[
        F.sum(F.when(F.col("actual") == a, F.col(f"predicted_{p}"))).alias(f"m{a}{p}")
        for a in (0, 1) for p in (0, 1)])
    classes = one_row.select(F.inline(per_class)).withColumns({
        "precision": zero(ratio(F.col("hit"), F.col("claimed"))),
        "recall": zero(ratio(F.col("hit"), F.col("support")))})
    classes = classes.withColumn("f1_score", zero(F.try_divide(
        2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    measures = ["precision", "recall", "f1_score"]
    macro = classes.agg(F.lit("macro avg").alias("class"),
                        *[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = classes.agg(
        F.lit("weighted avg").alias("class"),
        *[zero(F.try_divide(F.sum(F.col(m) * F.col("support")),
                            F.sum("support").cast("double"))).alias(m) for m in measures],
        F.sum("support").alias("support"))
    return classes.select("class", *measures, "support").unionByName(macro).unionByName(weighted)


def _class_counts(label: int) -> Column:
    return F.struct(
        F.lit(str(label)).alias("class"), F.col(f"m{label}{label}").alias("hit"),
        (F.col(f"m0{label}") + F.col(f"m1{label}")).alias("claimed"),
        (F.col(f"m{label}0") + F.col(f"m{label}1")).alias("support"))


def feature_importance(nodes: DataFrame) -> DataFrame:
    """Impurity importance per feature, also as percent with one decimal.

    A feature's share of the weighted gains of a tree, averaged over the trees that
    split at all; 0 where none does.
    """
    names = nodes.sparkSession.createDataFrame(
        [(i, label) for i, (_, label) in enumerate(K.FEATURE_LABELS)], "feature_no int, feature string")
    gains = nodes.where("feature >= 0").groupBy("tree", F.col("feature").alias("feature_no")).agg(
        F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    shares = gains.withColumn("share", F.try_divide(
        "gain", F.sum("gain").over(Window.partitionBy("tree"))))  # one row per feature and tree
    sums = shares.groupBy("feature_no").agg(
        F.sum(F.col("share").cast("decimal(18,15)")).cast("double").alias("share"))
    total = sums.agg(F.sum("share").alias("total"))
    importance = F.coalesce(F.try_divide("share", "total"), F.lit(0.0))
    return (names.join(sums, "feature_no", "left").join(F.broadcast(total))  # one row
            .select("feature", importance.alias("importance"),
                    round_even(importance * 100, 1).alias("importance_pct")))


def score(forest: Forest, inputs: DataFrame) -> DataFrame:
    """Verdict and probabilities in percent for a table of issue descriptions."""
    return verdicts(forest.nodes, scoring_rows(inputs, forest.modules, forest.types), inputs.columns)


def scoring_rows(inputs: DataFrame, modules: DataFrame, types: DataFrame) -> DataFrame:
    """Issue descriptions with the five numeric features."""
    weights = F.create_map(*[F.lit(x) for kv in K.SEVERITY_WEIGHTS.items() for x in kv])
    return encode(inputs.withColumns({
        "fix_time_hours": F.col("fix_time"),
        "severity_weight": F.coalesce(F.try_element_at(weights, F.col("severity")), F.lit(1.0))}),
        modules, types)


def verdicts(nodes: DataFrame, rows: DataFrame, shown: list[str], **size: int) -> DataFrame:
    """The columns ``shown`` with verdict and probabilities in percent."""
    percent = lambda c: round_even(F.col(c) * 100, 1).alias(c)
    return with_probabilities(nodes, rows, **size).select(
        *shown,
        F.when(F.col("predicted") == 1, K.LABEL_NAMES[1]).otherwise(K.LABEL_NAMES[0]).alias("prediction"),
        percent("confidence"), percent("proba_critical"), percent("proba_not_critical"))
