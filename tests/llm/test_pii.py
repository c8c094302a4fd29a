import hashlib
import os
import random
import re
import time

import pytest

from sitegauge.llm import pii

SF = "/root/testdata/sf0.001"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(number):
    total = 0
    for i, c in enumerate(number[::-1]):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    keep = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
            "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)),
            "phone": lambda s: 9 <= len(digits(s)) <= 15}
    return [(k, m.start(), m.end()) for (k, ok), p in zip(keep.items(), (EMAIL, IP, CARD, PHONE))
            for m in re.finditer(p, text) if ok(m.group())]


def shown(found):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def odd_texts():
    rng = random.Random(4)
    fixed = ["", "a@b.c@d.e x@y", "a@b.c.d@e.f", "@x.y z@.q", "1.2.3.4.5.6.7.8", "1.2.3.256 0001.0.0.000255", "1..2.3.4.5",
             "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (988) 555-2485 +1", "+12 34567890123456 +49-30-1234567-",
             "é😀 mail.é@x.y ü@a.b", "++1 23456789", "0 0 0 0 0 0 0 0 0 0 0 0 0"]
    return fixed + ["".join(rng.choice("ab1459@@..+- ()é\n") for _ in range(rng.randrange(5, 120))) for _ in range(3000)]


def test_base_spans_equal_the_patterns():
    for text in odd_texts():
        got = [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)]
        assert got == spans(text), text


def test_long_runs_are_linear():
    for piece in ("a", "1", "@", "a@", "1.", "+", "+1", "+1 ", "a.", "-", "1 ", "[at]", "x@y"):
        began = time.process_time()
        pii.base_spans(piece * 100_000)
        list(pii._candidates(piece * 100_000, []))
        assert time.process_time() - began < 5


def result(docs):
    return {(r.doc_id, r.base_sha256): r for r in pii.personal_data(docs).collect()}


def test_edge_cases(docs_of):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:200])] + [(900, None), (None, "x@y.zz"), (5, "x@y.zz"), (5, "x@y.zz")]
    got = pii.personal_data(docs_of(*rows).withColumnRenamed("lang", "base")).collect()
    want = sorted((d, *[sum(s[0] == k for s in spans(t or "")) for k in pii.KINDS],
                   hashlib.sha256(shown(spans(t or "")).encode()).hexdigest()) for d, t in
                  ((-1 if d is None else d, t) for d, t in rows))
    assert sorted((-1 if r[0] is None else r[0], *r[1:6]) for r in got) == want
    assert pii.personal_data(docs_of((1, "x")).where("false")).collect() == []


def test_contexts_find_unseen_identifiers(docs_of):
    seeds = [(i, f"Please write to user{i}@mail.example.com today. Call us at +49 30 55501{i:02d} now. "
                 f"The total was 10{i}34{i} items.") for i in range(8)]
    unseen = "Please write to root@localhost today. Call us at 030-5550-199 now. The total was 7734521 items."
    got = {r.doc_id: r.spans for r in pii.personal_data(docs_of(*seeds, (50, unseen))).collect()}
    found = [s.split(":") for s in got[50].split(",")]
    assert [(k, unseen[int(s):int(e)]) for k, s, e in found] == [("email", "root@localhost"), ("phone", "030-5550-199")]
    assert all(got[i] == shown(spans(seeds[i][1])) for i in range(8))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for r in docs.collect():
        base = spans(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        assert set(shown(base).split(",")) <= set(got[r.doc_id].spans.split(","))
