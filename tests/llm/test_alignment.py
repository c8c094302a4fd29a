from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegauge.llm import alignment
from sitegauge.llm.queries import alignment_files

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def letters():
    """Byte of every letter of the byte-level alphabet."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(c): c for c in shown}
    for i, c in enumerate(c for c in range(256) if c not in shown):
        table[chr(256 + i)] = c
    return table


LETTERS = letters()


def tokens(text, libraries):
    """(id, bytes) of the tokens of A and of B, or nothing."""
    a, b = libraries
    if not text:
        return [], []
    found = a.encode(" " + text, add_special_tokens=False)
    of_a = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
    of_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        byte = len(piece) == 6 and piece.startswith("<0x")
        of_b.append((i, bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(t for _, t in of_a) != whole or b"".join(t for _, t in of_b) != whole:
        return [], []
    return of_a, of_b


def spans(found):
    out, at = [], 0
    for i, t in found:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def expected(rows, libraries):
    """Brute force over (doc_id, text), byte by byte."""
    counts, found = Counter(), []
    for doc_id, text in rows:
        a, b = map(spans, tokens(text, libraries))
        of_byte = [set(), set()]
        at = {}
        for n, (_, start, end) in enumerate(a):
            at.update(dict.fromkeys(range(start, end), n))
        links = {(at[x], m) for m, (_, start, end) in enumerate(b) for x in range(start, end)}
        pairs = [(a[n][0], b[m][0]) for n, m in links]
        counts.update(pairs)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, last = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if last <= s and e <= end) for side in (a, b)))
            last = end
        found.append((doc_id, len(a), len(b), len(ends), pairs, ";".join(groups)))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return sorted(((d, na, nb, ng, len(p), sum(counts[x] == highest[x[1]] for x in p), sum(counts[x] for x in p),
                    sha256(g.encode()).hexdigest() if g else "") for d, na, nb, ng, p, g in found), key=repr)


TEXTS = [None, "", " ", "a", "plain words of English prose, plain words", "  two  spaces \t tab\n\nlines\r\n",
         "Größe, naïve café — “quoted” 日本語のテキスト 🙂🙂 اَلْعَرَبِيَّةُ", "<|endoftext|> and <s> </s> <unk> <0x41>",
         "▁ is lost", "zero \x00 byte", "a" * 3000, "word " * 3000, "don't we'll I'M 12345 $%&", " \u0085 x",
         "plain words of English prose, plain words"]


def result(docs):
    return sorted(map(tuple, alignment.measures(docs, alignment_files()).select(*COLUMNS).collect()), key=repr)


def test_against_brute_force(docs_of, libraries):
    rows = [*enumerate(TEXTS), (None, "plain words of English prose, plain words"), (3, "other words"), (None, None)]
    docs = docs_of(*rows).withColumn("n", F.lit(1)).withColumn("block", F.lit("mine")).withColumn("count", F.lit(2))
    assert result(docs.repartition(4)) == expected(rows, libraries)
    assert result(docs.where("false")) == []
    assert result(docs.where("text = ''")) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_whole_table_against_brute_force(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(docs) == expected(rows, libraries)


def test_blocks_do_not_change_results(libraries, monkeypatch):
    """Texts in blocks of one or two give the same pairs and weights as one block."""
    import pyarrow as pa

    def pairs(size):
        monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
        texts = [t for t in dict.fromkeys(TEXTS) if t]
        batch = pa.RecordBatch.from_arrays(
            [pa.array([sha256(t.encode()).hexdigest() for t in texts]), pa.array(range(1, len(texts) + 1), pa.int64()),
             pa.array(texts)], names=["digest", "n", "text"])
        rows = [r for out in alignment._align_rows(iter([batch]), alignment_files()) for r in out.to_pylist()]
        total, blocks = Counter(), {r["block"]: r for r in rows if r["digest"] is None}
        for r in blocks.values():
            total.update(dict(zip(r["codes"], r["weights"])))
        links = {r["digest"]: Counter({blocks[r["block"]]["codes"][p]: t for p, t in zip(r["pairs"], r["times"])})
                 for r in rows if r["digest"]}
        return len(blocks), total, links

    one, few = pairs(1 << 30), pairs(60)
    assert one[0] == 1 and few[0] > 5 and one[1:] == few[1:]


def test_pair_counts(docs_of, libraries):
    rows = [(1, "plain words"), (2, "plain words"), (3, "plains")]
    got = {(r.a_id, r.b_id): (r["count"], r.best) for r in alignment.pair_counts(docs_of(*rows), alignment_files()).collect()}
    counts = Counter()
    for _, text in rows:
        a, b = map(spans, tokens(text, libraries))
        counts.update((x, y) for x, s, e in a for y, t, f in b if s < f and t < e)
    assert {k: v[0] for k, v in got.items()} == counts
    assert all(v[1] == (v[0] == max(n for (_, y), n in counts.items() if y == k[1])) for k, v in got.items())


def test_both_byte_level_libraries_agree_on_every_code_point(libraries):
    byte_level = alignment.Aligner(alignment_files()).byte_level
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f" a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 !{chr(c)}? {chr(c)}\n{chr(c)}  x'{chr(c)}s" for c in points[i:i + 64])
             for i in range(0, len(points), 64)]
    found = libraries[0].encode_batch_fast(texts, add_special_tokens=False)
    assert all(f.ids == byte_level.encode_ordinary(t) for f, t in zip(found, texts))
