import os
from collections import Counter

import pytest

import corpus_pipeline
from sitegauge.llm import mixing, near_dedup, quality
from sitegauge.llm.queries import tokenizer_file
from tests.llm.test_bpe import digest_rows
from tests.llm.test_line_dedup import lines_left
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")


def test_stages_over_the_given_documents(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {None: docs.collect()}
    before = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        old, new = rows[before], rows[name]
        if name == "quality":
            kept = {r.doc_id for r in quality.judged(spark.createDataFrame(old), labels).collect() if r.kept}
            assert sorted(new) == sorted(r for r in old if r.doc_id in kept) and 0 < len(new) < len(old)
        elif name == "line_dedup":
            left = lines_left([(r.doc_id, r.text) for r in old])
            want = {r.doc_id: "\n".join(x) for r, x in zip(old, left)}
            assert {r.doc_id: r.text for r in new} == want and len(new) == len(old)
            assert all(r.n_chars == len(r.text) for r in new)
        elif name == "near_dedup":
            kept = {d for d, _, _, k in brute([(r.doc_id, r.text) for r in old]) if k}
            assert sorted(new) == sorted(r for r in old if r.doc_id in kept)
        elif name == "mixing":
            times = {r.doc_id: r.copies for r in mixing.with_copies(spark.createDataFrame(old)).collect()}
            assert Counter(new) == Counter(r for r in old for _ in range(times[r.doc_id]))
        else:
            library = tokenizers.Tokenizer.from_file(tokenizer_file())
            assert sorted(map(tuple, new), key=repr) == digest_rows(library, [(r.doc_id, r.text) for r in old])
        before = name


def test_odd_rows_and_empty_table(spark, docs_of):
    odd = docs_of((1, None), (2, ""), (3, "same words here", "en", None), (3, "same words here", "en", None),
                  (None, "no number here", None, "web"), (None, None), (4, "long " * 20_000, "xx", "a"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if name in ("quality", "line_dedup"):
            assert out.count() == 7
        elif name == "near_dedup":
            # 3 stays once; the two null texts of 1 and None, and 2, are linked with nothing
            assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 1, 2, 3, 4]
        assert stage(spark, odd.where("false"), SF).collect() == []


def test_one_row_of_each_component(spark, docs_of):
    docs = docs_of((7, "a b c d e f"), (3, "A b c d  e f"), (3, "A b c d  e f"), (9, "other words than these"),
                   (3, "another text under the same number"), (None, "a b c d e f"), (None, "quite alone here"))
    kept = sorted((r.doc_id or 0, r.text) for r in near_dedup.one_of_each(docs).collect())
    assert [k[0] for k in kept] == [0, 3, 9] and kept[0][1] == "quite alone here"
