import hashlib
import os
import random

import pytest

from sitegauge.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(3)
    fixed = ["", "  ", "don't 'sad I'LL we've", "<|endoftext|>x<|startoftext|> Y", "ΑΣ ΣΑΣ. İstanbul ǅ", "é ẛ̣ </w>",
             "日本語テキスト 한국어 العربية", "a\x1cb\x1fc\x00d\x85e᠎f​g﻿", "😀😃 👨‍👩‍👧", "½²³१२३ Ⅷ",
             "x" * 5000, "ab" * 3000, "!?" * 2000, "a\nb\r\n\tc", "word " * 30_000]
    return fixed + ["".join(rng.choice("aeiothnsr lyck'.,!") for _ in range(300)) for _ in range(300)]


def test_equals_the_library(library):
    ours = bpe.Tokenizer(PATH, remembered=500)
    texts = odd_texts()
    for at in range(0, len(texts), 40):
        part = texts[at:at + 40]
        for (ids, decoded), text in zip(ours.encode_batch(part), part):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids == " ".join(map(str, want))
            assert decoded == library.decode(want, skip_special_tokens=False) == ours.decode(want)


def test_every_token_is_its_own_encoding():
    ours = bpe.Tokenizer(PATH)
    assert all(ours.is_whole(t) for t in ours.tokens)


def digest_rows(library, rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


def test_digests_of_odd_rows(docs_of, library):
    rows = [(1, None), (None, "no id"), (2, "Twice"), (2, "Twice"), (3, " \n "), *enumerate(odd_texts()[:20], 10)]
    docs = docs_of(*rows).withColumnRenamed("lang", "ids")
    assert sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=repr) == digest_rows(library, rows)
    assert bpe.digests(docs.where("false"), PATH).collect() == []
    encoded = {r.doc_id: r.ids for r in bpe.encode(docs.where("doc_id = 3 or doc_id = 12"), PATH).collect()}
    assert encoded[3] == "" and bpe.Tokenizer(PATH).decode([int(i) for i in encoded[12].split()]) == library.decode(
        library.encode(odd_texts()[2], add_special_tokens=False).ids, skip_special_tokens=False)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")
def test_given_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=repr) == digest_rows(library, rows)
