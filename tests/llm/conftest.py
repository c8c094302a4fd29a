import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) tuples."""

    def build(*rows):
        full = [(r[0], r[1], *(list(r[2:]) + ["en", "web"][len(r) - 2:]), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build
