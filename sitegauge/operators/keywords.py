"""TF-IDF keywords over issue descriptions (or any text), per corpus.

Input is a table ``docs`` of (corpus, doc_id, text); with one corpus per site each
site gets its own vocabulary. Everything is grouping and joins on long tables; only
a corpus vocabulary, at most 100 terms, is ever ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge import constants as K
from sitegauge.functions.numbers import round_even
from sitegauge.functions.skew import top_per_group, with_group_row
from sitegauge.session import stage

_URL = rf"https?[^\s{K.OTHER_SPACE}]+"


def issue_docs(issues: DataFrame, corpus: str | None = "site") -> DataFrame:
    """Issue descriptions as docs; ``corpus=None`` makes the whole table one corpus."""
    group = F.lit("all") if corpus is None else F.col(corpus)
    return issues.select(
        group.alias("corpus"), F.concat_ws("|", "site", "module", "issue_type").alias("doc_id"),
        F.col("description").alias("text"))


def token_array(text: Column) -> Column:
    """Cleaned words of a text; the single word "issue" when none is left."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    letters = F.regexp_replace(F.regexp_replace(lowered, _URL, ""), r"[^a-z\s]", " ")
    words = F.filter(F.split(letters, r"\s+"),
                     lambda w: (F.length(w) > 2) & ~w.isin(sorted(set(K.STOPWORDS))))
    return F.when(F.size(words) == 0, F.array(F.lit(K.EMPTY_TEXT_TOKEN))).otherwise(words)


def tokens(docs: DataFrame) -> DataFrame:
    return docs.select("corpus", "doc_id", token_array(F.col("text")).alias("words"))


def ngram_array(words: Column) -> Column:
    """Words followed by all pairs of neighbours."""
    size = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), size - 1), F.slice(words, F.lit(2), size - 1),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def term_counts(token_rows: DataFrame) -> DataFrame:
    """Occurrences of every word and word pair per document.

    A document is one row, so its terms are counted in the row: sorted, then the
    length of every run of equal terms. Nothing is shuffled.
    """
    ordered = token_rows.select(
        "corpus", "doc_id", F.sort_array(ngram_array(F.col("words"))).alias("terms"))
    starts = ordered.withColumn("starts", F.expr(
        "filter(transform(terms, (t, i) -> if(i = 0 or get(terms, i - 1) <> t, i, null)),"
        " i -> i is not null)"))
    runs = ("transform(starts, (start, k) -> named_struct('term', get(terms, start), 'tf',"
            " cast(coalesce(get(starts, k + 1), size(terms)) - start as bigint)))")
    return starts.select("corpus", "doc_id", F.inline(F.expr(runs)))


def frequent_words(token_rows: DataFrame, size: int) -> DataFrame:
    """Words at least as frequent as the ``size``-th most frequent word of their corpus."""
    # never empty; the plain explode would add a size filter that cleans the text again
    totals = (token_rows.select("corpus", F.explode_outer("words").alias("word"))
              .groupBy("corpus", "word").agg(F.count("*").alias("total")))
    floors = (top_per_group(totals, ["corpus"], [F.desc("total"), F.asc("word")], size, "nth")
              .where(F.col("nth") == size).select("corpus", F.col("total").alias("floor")))
    return (with_group_row(totals, floors, "corpus", F.xxhash64("word"), "left")
            .where(F.col("total") >= F.coalesce("floor", F.lit(0))).select("corpus", "word"))


def vocabulary(token_rows: DataFrame, size: int = K.VOCABULARY_SIZE) -> DataFrame:
    """The most frequent terms of every corpus with document frequency; ties by term.

    A pair occurs at most as often as either of its words, so a term made of a word
    below the ``size``-th word cannot be among the first ``size`` terms. Such terms are
    dropped before they are counted, by semi joins whose kind Spark chooses by the size
    of the staged list of frequent words.
    """
    words = stage(frequent_words(token_rows, size), "words")
    counts = term_counts(token_rows)
    for nth in (1, -1):
        counts = counts.withColumn("word", F.substring_index("term", " ", nth)).join(
            words, ["corpus", "word"], "left_semi").drop("word")
    terms = counts.groupBy("corpus", "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    return top_per_group(terms, ["corpus"], [F.desc("total"), F.asc("term")], size, "term_no")


def tfidf(token_rows: DataFrame, single_corpus: bool = False) -> DataFrame:
    """L2-normalised weight per document and vocabulary term, smoothed idf.

    With a single corpus the vocabulary has at most 100 rows and is broadcast;
    otherwise it is staged, so that Spark knows its size before it shuffles the terms
    of all documents. Only vocabulary terms are shuffled by document.
    """
    counts = term_counts(token_rows)
    sizes = token_rows.groupBy("corpus").agg(F.count("*").alias("n_docs"))
    terms = vocabulary(token_rows).join(sizes, "corpus").select(
        "corpus", "term", "term_no",
        (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    terms = F.broadcast(terms) if single_corpus else stage(terms, "vocabulary")
    by_doc = Window.partitionBy("corpus", "doc_id")
    return (counts.join(terms, ["corpus", "term"])
            .withColumn("raw", F.col("tf") * F.col("idf"))
            .withColumn("weight", F.col("raw") / F.sqrt(F.sum(F.col("raw") ** 2).over(by_doc)))
            .select("corpus", "doc_id", "term", "term_no", "weight"))


def enough_docs(docs: DataFrame) -> DataFrame:
    """Docs of corpora that have at least three documents; no text is shuffled by its corpus alone."""
    ok = docs.groupBy("corpus").agg(F.count("*").alias("n")).where(
        F.col("n") >= K.MIN_ISSUES_FOR_TEXT).select("corpus")
    return with_group_row(docs, ok, "corpus", F.xxhash64("doc_id", "text"), "left_semi")


def text_guard(docs: DataFrame) -> DataFrame:
    """Number of documents per corpus and the message for those with too few."""
    return docs.groupBy("corpus").agg(F.count("*").alias("n_docs")).withColumn(
        "error", F.when(F.col("n_docs") < K.MIN_ISSUES_FOR_TEXT, F.lit(K.TEXT_GUARD_MESSAGE)))


def top_keywords(weights: DataFrame, n: int = K.TOP_KEYWORDS) -> DataFrame:
    """Terms with the highest summed weight per corpus, with word-cloud weights."""
    sums = weights.groupBy("corpus", "term").agg(round_even(F.sum("weight"), 9).alias("total"))
    top = top_per_group(sums, ["corpus"], [F.desc("total"), F.asc("term")], n)
    score = round_even(F.col("total"), 3)
    return top.select(
        "corpus", "rank", F.col("term").alias("keyword"), score.alias("score"),
        F.greatest(score * 100, F.lit(1.0)).alias("cloud_weight"))
