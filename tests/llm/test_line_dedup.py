import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sitegauge.llm import line_dedup


def lines_left(rows):
    """Brute force: the kept lines of every (doc_id, text) row, in the order given."""
    number = lambda d: 2**63 - 1 if d is None else d
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(number(doc_id))
    out = []
    for doc_id, text in rows:
        out.append([line for line in (text or "").split("\n")
                    if len(key(line)) < 10 or len(holders[key(line)]) < 2 or min(holders[key(line)]) == number(doc_id)])
    return out


ROWS = [(1, "alpha line number one\nshort\nbeta line number two\nlast"),
        (2, "x\n\t Alpha LINE number one \nshort\nbeta line number two\nÀ line with àccents\n"),
        (3, "beta line number two\nalpha line number one\n\nÀ line with ÀCCENTS\nà line with àccents"),
        (4, None), (5, ""), (6, "\n\n"), (7, "alpha line number one"),
        (8, "repeated inside one\nrepeated inside one"), (9, "row that repeats"), (9, "row that repeats"),
        (10, "row that repeats\nand one more line"), (None, "row that repeats\nno id here at all"),
        (None, "no id here at all\nrow that repeats"), (11, "0123456789"), (12, "0123456789\n123456789"),
        (13, "123456789"), (14, "a line ending in nbsp "), (15, "a line ending in nbsp"),
        (16, "beta line number two\n" * 5000 + "end of a long one"), (17, "end of a long one\r\nbeta line number two\r\n")]


def test_against_brute_force(docs_of):
    got = sorted(map(tuple, line_dedup.digests(docs_of(*ROWS).repartition(3)).collect()), key=repr)
    want = sorted(((doc_id, len((text or "").split("\n")), len((text or "").split("\n")) - len(left),
                    hashlib.sha256("\n".join(left).encode()).hexdigest())
                   for (doc_id, text), left in zip(ROWS, lines_left(ROWS))), key=repr)
    assert got == want


def test_bitmaps_are_run_lengths(docs_of):
    rows = [(1, "keep this first line\nand that second line"),
            (2, "own line number one\nkeep this first line\nand that second line\nown line number two\nkeep this first line")]
    (row,) = line_dedup.keep_bitmaps(docs_of(*rows)).collect()
    assert [tuple(r) for r in row.keep_runs] == [(1, 2), (1, 1)] and row.n_dropped == 3


def test_columns_stay(docs_of):
    docs = docs_of(*ROWS).withColumn("n_dropped", F.lit("mine")).withColumn("h", F.lit(1))
    kept = line_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted(
        (d or -1, "\n".join(left)) for (d, _), left in zip(ROWS, lines_left(ROWS)))
    assert line_dedup.digests(docs.where("false")).collect() == []


def test_plan_has_no_python(docs_of):
    plan = line_dedup.digests(docs_of((1, "x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
