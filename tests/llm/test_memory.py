import tracemalloc

import numpy as np
import pyarrow as pa

from sitegauge.llm import bpe, near_dedup, quality
from sitegauge.llm import words as W


def scored_block(n_rows, n_chars):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, n_chars))) for _ in range(n_rows)]
    table = pa.table({"block": pa.array([0] * n_rows, pa.int32()), "lang": ["en", "fr"] * (n_rows // 2),
                      "doc_id": list(range(n_rows)), "text_hash": list(range(n_rows)), "text": texts})
    answers = {"lang": [], "gram": [], "logp": []}
    for lang, _, data, offsets in quality._by_language(table["lang"].chunk(0), table["text"].chunk(0)):
        grams = np.unique(quality._grams(data, offsets)[0])
        answers["lang"] += [lang] * len(grams)
        answers["gram"] += grams.tolist()
        answers["logp"] += [-1.0] * len(grams)
    return table, pa.table(answers)


def test_a_block_is_scored_in_little_memory_and_in_any_batches():
    table, answers = scored_block(4000, 400)
    answers = answers.group_by(["lang", "gram"]).aggregate([("logp", "max")]).rename_columns(["lang", "gram", "logp"])
    small = answers.slice(0, 0), table.slice(0, 0)
    tracemalloc.start()
    whole = quality._score_block(table, answers)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # with the arrays of 2 MB of text at a time it was 106 MB
    assert held < 80_000_000
    assert whole["perplexity"].to_pylist() == [np.e] * 4000 and whole["n_bytes"].to_pylist() == [400] * 4000
    pieces = pa.concat_tables([table.slice(0, 1), table.slice(1, 1001), table.slice(1002)])
    assert quality._score_block(pieces, answers).to_pylist() == whole.to_pylist()
    assert quality._score_block(table, small[0])["perplexity"].to_pylist() == [None] * 4000
    assert len(quality._score_block(small[1], answers)) == 0


def test_other_operators_free_the_remembered_words():
    forgotten = {"path": bpe.Tokenizer.__new__(bpe.Tokenizer)}
    W.hold(forgotten.clear)
    assert list(near_dedup._sketch_rows(iter([]), 3)) == [] and forgotten == {}
    W.make_room()
