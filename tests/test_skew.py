import pytest
from pyspark.sql import functions as F

from sitegauge.operators import keywords as T

#: Not a literal, which Spark would take out of the joins.
ONE_CORPUS = "if(id >= 0, 'en', null) as corpus"


@pytest.fixture
def unsized_joins(spark):
    """No table is small enough to be broadcast, and tasks stay as they are dealt."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]


def test_texts_of_one_corpus_are_dealt_to_all_tasks(spark, unsized_joins):
    docs = spark.range(2000).select(F.expr(ONE_CORPUS), "id", F.col("id").alias("doc_id"),
                                    F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    few = spark.createDataFrame([("xx", 1, 1, "a"), ("xx", 2, 2, "b"), (None, 1, 1, "c"), (None, 2, 2, "d"), (None, 3, 3, "e")],
                                "corpus string, id long, doc_id long, text string")
    left = T.enough_docs(docs.union(few))
    assert left.count() == 2000 and left.columns == docs.columns
    assert largest_task(left) < 1000


def test_words_of_one_corpus_are_dealt_to_all_tasks(spark, unsized_joins):
    words = F.array(F.lit("common"), F.concat(F.lit("w"), F.col("id").cast("string")))
    rows = spark.range(2000).select(F.expr(ONE_CORPUS), F.col("id").alias("doc_id"), words.alias("words"))
    assert [r.word for r in T.frequent_words(rows, 1).collect()] == ["common"]
    every = T.frequent_words(rows, 5000)
    assert every.count() == 2001 and largest_task(every) < 1000
