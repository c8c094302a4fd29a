import hashlib
import os
import re

import pytest

from sitegauge.llm import fingerprints

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """(doc_id, text) -> edited text, for rows in descending order."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out.append((doc_id, text, text[:len(text) - half] + following[:half], following))
    return out


def check(result, rows, tolerance):
    got = sorted(result.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.edited_sha256))
    want = sorted(expected(rows), key=lambda w: (w[0] is None, w[0] or 0, hashlib.sha256(w[2].encode()).hexdigest()))
    assert len(got) == len(want)
    for row, (doc_id, text, edited, following) in zip(got, want):
        assert row.doc_id == doc_id and row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(row.near_edited - jaccard(text, edited)) <= tolerance
        assert abs(row.near_next - jaccard(text, following)) <= tolerance
    by_text = {}
    for row, (_, text, _, _) in zip(got, want):
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint


def test_edge_cases(docs_of):
    rows = [(9, None), (8, ""), (7, "a"), (6, "A  b\tc d e f g"), (5, "a b c d e f g"), (5, "repeated row"),
            (5, "repeated row"), (None, "no id"), (None, "no id too"), (3, " \t\n"), (2, "é ü 日本 words here and more"),
            (1, "long " * 30_000 + "end")]
    check(fingerprints.fingerprints(docs_of(*rows)), rows, 0.1)


def test_single_row_and_empty_table(docs_of):
    check(fingerprints.fingerprints(docs_of((4, "one two three four five six"))), [(4, "one two three four five six")], 0.1)
    assert fingerprints.fingerprints(docs_of((1, "x")).where("false")).collect() == []


def test_case_of_ascii_letters_does_not_matter(docs_of):
    upper, lower = fingerprints.fingerprints(docs_of((2, "ONE two"), (1, "one TWO"))).collect()
    assert upper.fingerprint == lower.fingerprint and upper.near_next == 1.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")
@pytest.mark.parametrize("partitions", [1, 7])
def test_given_documents(spark, partitions):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(fingerprints.fingerprints(docs.repartition(partitions)), rows, 0.13)
