"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model predicts each UTF-8 byte from the three before it, one model per language,
trained on the documents that ``labels`` marks as good, but for one in ``HELD_OUT``,
or one at least of several, which set the thresholds. Counts of byte 4-grams are
summed up over the corpus; lower orders count the distinct continuations, and every
order has its own three discounts. The probabilities of each order are tables sharded
by language and n-gram.

To score, documents are dealt into blocks of about ``BLOCK_CHARS``. A block asks for
its distinct 4-grams only; these are made distinct again over all blocks, joined with
the count tables from the highest order down to the first that knows them, and sent
back to the blocks, where they meet the texts. So neither the model nor the corpus
passes through the driver or any one task, and what is gathered grows with the input.

A document is rejected if its perplexity per byte is above the ``QUANTILE`` of its
language's held-out trusted documents by the factor ``SLACK``.

Such a model cannot see a word said over and over, as the word itself may be ordinary;
more context does not change that. So a document is rejected as well if the share of
its words that only repeat the words just before is above the ``QUANTILE`` of all
trusted documents of its language, which have no part in training that share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm import words as W
from sitegauge.session import stage

ORDER = 4
HELD_OUT = 4
QUANTILE, SLACK = 0.998, 1.25
BLOCK_CHARS = 16_000_000
#: Texts of a block that are scored at a time.
SCORED_ROWS = 200
#: Parts that the rows of a language are dealt into where they meet its one row.
PARTS = 64
#: Longest run of words that counts as repeated when it follows itself.
LOOP_WORDS = 8
#: Byte that stands before the first of a text; UTF-8 has no such byte.
_START = 0xFF


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each byte, as one number, and the text each byte is of."""
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)
    padded = np.full(len(data) + (ORDER - 1) * len(lengths), _START, np.uint8)
    at = np.arange(len(data)) + (ORDER - 1) * (text + 1)
    padded[at] = data
    grams = np.zeros(len(data), np.uint32)
    for back in range(ORDER - 1, -1, -1):
        grams = (grams << np.uint32(8)) | padded[at - back]
    return grams, text


def _by_language(langs: pa.Array, texts: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of bounded size of the texts of one language: language, rows, bytes and offsets."""
    names = np.array(langs.to_pylist(), dtype=object)
    for lang in sorted(set(names)):
        rows = np.flatnonzero(names == lang)
        data, offsets = W.bytes_of(texts.take(pa.array(rows)))
        for first, last in W.pieces(offsets):
            part = offsets[first:last + 1]
            yield lang, rows[first:last], data[part[0]:part[-1]], part - part[0]


def _summed(total: tuple[np.ndarray, np.ndarray] | None, grams: np.ndarray, counts: np.ndarray):
    """Counts of two lists of distinct 4-grams in one."""
    if total is None:
        return grams, counts
    every, inverse = np.unique(np.concatenate([total[0], grams]), return_inverse=True)
    return every, np.bincount(inverse, np.concatenate([total[1], counts]), len(every)).astype(np.int64)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns lang, text -> lang, gram, n, summed up within a batch."""
    W.make_room()
    for batch in batches:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang, _, data, offsets in _by_language(batch.column(0), batch.column(1)):
            total[lang] = _summed(total.get(lang), *np.unique(_grams(data, offsets)[0], return_counts=True))
        for lang, (grams, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)),
                                              pa.array(counts)], names=["lang", "gram", "n"])


def _context(gram: Column) -> Column:
    return F.shiftright(gram, 8)


def _shorter(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (8 * order)) - 1).cast("long"))


def _with_language(rows: DataFrame, of_language: DataFrame, dealt_by: Column, how: str = "inner") -> DataFrame:
    """Rows with the columns of their language's row, each language dealt into PARTS."""
    spread = of_language.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = F.pmod(dealt_by, F.lit(PARTS)).cast("int")
    return rows.withColumn("_part", part).join(spread, ["lang", "_part"], how).drop("_part")


def _discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of counts (lang, gram, n): (lang, gram, own) and (lang, context, rest).

    ``own`` is the share that stays with the n-gram after discounting and ``rest`` what
    the context leaves to the next lower order.
    """
    of = lambda k: F.sum((F.col("n") == k).cast("double"))
    freq = counts.groupBy("lang").agg(*[of(k).alias(f"f{k}") for k in (1, 2, 3, 4)])
    f = [F.col(f"f{k}") for k in (1, 2, 3, 4)]
    y = f[0] / F.greatest(f[0] + 2 * f[1], F.lit(1.0))
    # small corpora can give useless discounts: they stay between 0.05 and the count
    discounts = freq.select("lang", *[
        F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * f[k] / F.greatest(f[k - 1], F.lit(1.0))))
        .alias(f"d{k}") for k in (1, 2, 3)])
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = _with_language(counts, discounts, F.col("gram")).select(
        "lang", "gram", "n", _context(F.col("gram")).alias("context"), taken.alias("taken"))
    contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("all"), F.sum("taken").alias("left"))
    own = rows.join(contexts, ["lang", "context"]).select(
        "lang", "gram", ((F.col("n") - F.col("taken")) / F.col("all")).alias("own"))
    return own, contexts.select("lang", "context", (F.col("left") / F.col("all")).alias("rest"))


def train(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """From texts (lang, text): per order 1 to ORDER the tables (lang, gram, own) and (lang, context, rest)."""
    counts = stage(trusted.mapInArrow(_count_rows, "lang string, gram long, n long")
                   .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "quality-counts")
    orders = []
    for order in range(ORDER, 0, -1):
        own, rest = _discounted(counts)
        orders.append((stage(own, f"quality-own{order}"), stage(rest, f"quality-rest{order}")))
        # a lower order counts the distinct bytes before its n-gram
        counts = counts.groupBy("lang", _shorter(F.col("gram"), order - 1).alias("gram")).agg(
            F.count("*").alias("n"))
    return orders[::-1]


def _probabilities(asked: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Adds ``logp`` to distinct (lang, gram) rows; a language without a model is left out."""
    # of a language all 256 bytes, seen or not: this join leaves out languages without a model
    own, rest = model[0]
    every = rest.select("lang", "rest", F.explode(F.sequence(F.lit(0), F.lit(255)).cast("array<long>")).alias("_g"))
    bytes_ = every.join(own.withColumnRenamed("gram", "_g"), ["lang", "_g"], "left").select(
        "lang", "_g", (F.coalesce("own", F.lit(0.0)) + F.col("rest") / 256).alias("_p"))
    known = asked.withColumn("_g", _shorter(F.col("gram"), 1)).join(bytes_, ["lang", "_g"]).drop("_g")
    p = F.col("_p")
    for order, (own, rest) in enumerate(model[1:], 2):
        gram = _shorter(F.col("gram"), order)
        known = known.withColumns({"_g": gram, "_c": _context(gram)})
        known = (known.join(own.select("lang", F.col("gram").alias("_g"), F.col("own").alias(f"_own{order}")),
                            ["lang", "_g"], "left")
                 .join(rest.select("lang", F.col("context").alias("_c"), F.col("rest").alias(f"_rest{order}")),
                       ["lang", "_c"], "left").drop("_g", "_c"))
        p = F.coalesce(F.col(f"_own{order}"), F.lit(0.0)) + F.coalesce(F.col(f"_rest{order}"), F.lit(1.0)) * p
    return known.select("lang", "gram", F.log(p).cast("float").alias("logp"))


def _ask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (block, lang, gram) of sorted blocks; rows are block, lang, key columns, text."""
    W.make_room()
    held: dict[tuple[int, str], np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (block, lang), grams in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(grams), block, np.int32)), pa.array([lang] * len(grams), pa.string()),
                pa.array(grams.astype(np.int64))], names=["block", "lang", "gram"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        for block in np.unique(blocks):
            if held and next(iter(held))[0] != block:
                yield from rows()
                held = {}
            own = batch.filter(pa.array(blocks == block))
            for lang, _, data, offsets in _by_language(own.column(1), own.column(own.num_columns - 1)):
                grams = np.unique(_grams(data, offsets)[0])
                seen = held.get((block, lang))
                held[block, lang] = grams if seen is None else np.union1d(seen, grams)
    yield from rows()


def _repeats(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of every text, and how many of them end a run of words that follows itself."""
    words, counts = W.word_hashes(data, offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    repeated = np.zeros(len(words), bool)
    for size in range(1, min(LOOP_WORDS, len(words) // 2) + 1):
        same = np.zeros(len(words) + 1, np.int64)
        np.cumsum(words[size:] == words[:-size], out=same[size + 1:])
        repeated[size:] |= (same[size + 1:] - same[1:-size] == size) & (place[size:] >= 2 * size - 1)
    return counts, np.bincount(text, repeated, len(counts)).astype(np.int64)


SCORED = ("doc_id long, text_hash long, lang string, n_bytes long, perplexity double, "
          "n_words long, n_repeats long")


def _score_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Perplexity of every text of a block, from the log-probabilities of its 4-grams, and its repeated words."""
    W.make_room()
    answer_langs = np.array(answers["lang"].to_pylist(), dtype=object)
    grams, logs = answers["gram"].to_numpy().astype(np.uint32), answers["logp"].to_numpy().astype(np.float64)
    tables = {}
    for lang in set(answer_langs):
        own = answer_langs == lang
        order = np.argsort(grams[own])
        tables[lang] = grams[own][order], logs[own][order]
    total, n = np.full(len(texts), np.nan), np.zeros(len(texts), np.int64)
    n_words, n_repeats = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    first = 0
    # the arrays made from a text are many times its size: few texts at a time, and no copy of them all
    for batch in W.slices(texts.select(["lang", "text"]).to_batches(), SCORED_ROWS):
        for lang, rows, data, offsets in _by_language(batch.column(0), batch.column(1)):
            rows = rows + first
            n[rows] = np.diff(offsets)
            n_words[rows], n_repeats[rows] = _repeats(data, offsets)
            if lang in tables:
                table, values = tables[lang]
                found, text = _grams(data, offsets)
                # sorted look-ups walk the table once, instead of jumping through it
                distinct, inverse = np.unique(found, return_inverse=True)
                total[rows] = np.bincount(text, values[np.searchsorted(table, distinct)][inverse], len(rows))
        first += batch.num_rows
    scored = ~np.isnan(total) & (n > 0)
    perplexity = np.exp(-np.where(scored, total, 0.0) / np.maximum(n, 1))
    return pa.table([texts["doc_id"], texts["text_hash"], texts["lang"], pa.array(n),
                     pa.array(perplexity, mask=~scored), pa.array(n_words), pa.array(n_repeats)],
                    names=["doc_id", "text_hash", "lang", "n_bytes", "perplexity", "n_words", "n_repeats"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"))


def _with_held_out(rows: DataFrame, good: DataFrame) -> DataFrame:
    """Adds ``held_out`` to the distinct trusted doc_ids: one in HELD_OUT by hash, and where that leaves a
    language of several trusted documents without one, its document with the least hash."""
    draw = F.xxhash64(F.lit("held out"), "doc_id")
    good = good.withColumn("held_out", F.pmod(draw, F.lit(HELD_OUT)) == 0)
    place = F.struct(draw.alias("draw"), "doc_id")
    more = (rows.select("lang", "doc_id").join(good, "doc_id").groupBy("lang")
            .agg(F.max("held_out").alias("some"), F.min(place).alias("first"), F.max(place).alias("last"))
            .where("not some and first < last").select("first.doc_id", F.lit(True).alias("more")).distinct())
    return good.join(more, "doc_id", "left").select(
        "doc_id", (F.col("held_out") | F.coalesce("more", F.lit(False))).alias("held_out"))


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row the columns of SCORED, trusted and held_out; perplexity is null for empty texts and languages without trusted text."""
    spark, rows = docs.sparkSession, _keyed(docs)
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    good = _with_held_out(rows, good)
    model = train(rows.join(good.where("not held_out"), "doc_id", "left_semi").select("lang", "text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(partitions, chars // BLOCK_CHARS + 1)
    # a long document or a repeated one goes where its hash says, so blocks are even
    block = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(blocks)).cast("int").alias("block")
    dealt = rows.select(block, "lang", "doc_id", "text_hash", "text")
    asked = stage(dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block").mapInArrow(
        _ask_rows, "block int, lang string, gram long"), "quality-asked")
    known = stage(_probabilities(asked.select("lang", "gram").distinct(), model), "quality-known")
    answers = asked.join(known, ["lang", "gram"])
    scored = stage(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block, SCORED),
                   "quality-scored")
    return scored.join(good, "doc_id", "left").withColumns(
        {"trusted": F.col("held_out").isNotNull(), "held_out": F.coalesce("held_out", F.lit(False))})


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, lang, perplexity, threshold, repetition, most_repetition and kept.

    Documents: ``doc_id``, ``text`` and ``lang``; labels: ``doc_id`` and ``quality``. A
    null language is one of its own, named ''. A document is kept if nothing speaks
    against it: an empty or null text, or one in a language without trusted documents,
    has no perplexity and stays; with one trusted document there is nothing to hold out, and no threshold. Rows are judged each, so repeated rows agree; a null
    doc_id is never trusted. An empty table gives an empty result. ``repetition`` is the
    share of words that end a run of words following itself, but for the first such
    word, which may be chance.
    """
    repetition = F.greatest(F.col("n_repeats") - 1, F.lit(0)) / F.greatest("n_words", F.lit(1))
    scored = perplexities(docs, labels).withColumn("repetition", repetition)
    held_out = F.when(F.col("held_out"), F.col("perplexity"))
    limits = scored.where("trusted and perplexity is not null").groupBy("lang").agg(
        (SLACK * F.percentile_approx(held_out, QUANTILE, 100_000)).alias("threshold"),
        F.percentile_approx("repetition", QUANTILE, 100_000).alias("most_repetition"))
    return _with_language(scored, limits, F.col("text_hash"), "left").select(
        "doc_id", "text_hash", "lang", "perplexity", "threshold", "repetition", "most_repetition",
        (F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
         & F.coalesce(F.col("repetition") <= F.col("most_repetition"), F.lit(True))).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents without those that the classifier rejects."""
    rejected = judged(docs, labels).where("not kept").select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text")).distinct()
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return (docs.withColumns({"_d": F.col("doc_id").cast("long"), "_t": text_hash})
            .join(rejected, F.col("_d").eqNullSafe(F.col("_doc")) & (F.col("_t") == F.col("_text")), "left_anti")
            .select(*docs.columns))
