"""Personal data: base patterns as seeds, and contexts learned from them.

Base spans (e-mail, IP, card and phone numbers) come from fixed patterns. Each of them
is a seed instance, and the words around it are lexical patterns. Whatever else looks
like an identifier is an instance too, not yet of any kind. Patterns and instances form
a bipartite graph, which is scored in rounds: a pattern is worth the mean score of its
instances for a kind, if enough of them have one; an instance without kind gets the
score of its best pattern. Instances of the right shape in the context of a pattern
that is good enough in the end are added as spans.

Texts are read once, by ``_found``; the graph is built of hashed contexts and counted
before it is shuffled, so a context as common as "the" is one row per task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm import words as W
from sitegauge.session import stage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern counts from so many scored instances on, and is good from this score on.
LEAST_SUPPORT, GOOD = 3, 0.8
#: Least share of digits' kinds: an unseen number has so many digits at least.
LEAST_DIGITS = 5
#: Code points of context that are looked at on either side.
CONTEXT = 200

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOTTED = re.compile(r"[0-9](?:[0-9]|\.(?=[0-9]))*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9][0-9().\-/]*[0-9]")
_AT = re.compile(r"@|\[at\]|\(at\)")
_SPACE = re.compile(r"\s")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The part before each "@" is the longest run of allowed characters after the last span."""
    end = before = 0
    for m in _AT_DOMAIN.finditer(text):
        at = m.start()
        # no "@" is allowed before one, so a run begins after the last of them at the earliest
        floor = max(end, text.rfind("@", before, at) + 1)
        before = at
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        if start < at:
            end = m.end()
            yield start, end


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of a dotted run; those above 255 are dropped."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        start, numbers = m.start(), m.group().split(".")
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i:i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n[-3:]) <= 255 for n in four):
                yield start, end
            start = end + 1


def _luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = [int(c) for c in m.group() if c not in " -"]
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    return [(k, *span) for k, find in enumerate((emails, ips, cards, phones)) for span in find(text)]


def _candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What looks like an identifier and touches no base span, in order of its start."""
    spans = sorted((s, e) for _, s, e in taken)
    found = [m.span() for m in _NUMBER.finditer(text) if sum(c.isdigit() for c in m.group()) >= LEAST_DIGITS]
    last = -1
    for m in _AT.finditer(text):
        if m.start() <= last:
            continue
        start, end = m.span()
        while start > 0 and not _SPACE.match(text[start - 1]):
            start -= 1
        space = _SPACE.search(text, end)
        end = last = space.start() if space else len(text)
        token = text[start:end].rstrip(".,;:!?")
        if start < m.start() and len(token) > m.end() - start:
            found.append((start, start + len(token)))
    i, before = 0, 0
    for start, end in sorted(found):
        while i < len(spans) and spans[i][1] <= start:
            i += 1
        if start >= before and not (i < len(spans) and spans[i][0] < end):
            before = end
            yield start, end


def _shape(token: str) -> int:
    """1 for what holds an at sign, 0 for a number."""
    return int(_AT.search(token) is not None)


def _contexts(text: str, start: int, end: int) -> list[str]:
    """Two words to the left; one to the left and one to the right."""
    left = text[max(0, start - CONTEXT):start].lower().split()[-2:]
    right = text[end:end + CONTEXT].lower().split()[:1]
    out = []
    if len(left) == 2:
        out.append("\x1f".join(["L", *left]))
    if left and right:
        out.append("\x1f".join(["B", left[-1], *right]))
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("shape", pa.int32()),
                      ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
FOUND = ("doc_id long, text_hash long, base array<struct<kind:int,start:long,end:long>>, mentions array<struct<"
         "kind:int,start:long,end:long,shape:int,instance:long,patterns:array<long>>>")


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches):
        bases, mentions = [], []
        for text in batch.column(2).to_pylist():
            text = text or ""
            base = base_spans(text)
            own = [(*b, k) for b in base for k in [b[0]]]
            own += [(-1, s, e, -1) for s, e in _candidates(text, base)]
            bases.append([dict(zip(("kind", "start", "end"), b)) for b in base])
            mentions.append([{"kind": kind, "start": s, "end": e, "shape": _shape(text[s:e]),
                              "instance": _hash(text[s:e].lower()),
                              "patterns": [_hash(c) for c in _contexts(text, s, e)]} for kind, s, e, _ in own])
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1),
            pa.array(bases, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
            pa.array(mentions, pa.list_(_MENTION))], names=["doc_id", "text_hash", "base", "mentions"])


def good_patterns(mentions: DataFrame) -> DataFrame:
    """Columns pattern, kind and shape, with score >= GOOD after ROUNDS of scoring.

    ``mentions`` has one row per mention: kind (-1: none), shape, instance, patterns.
    """
    graph = stage(mentions.select("kind", "shape", "instance", F.explode("patterns").alias("pattern"))
                  .groupBy("pattern", "shape", "instance").agg(F.max("kind").alias("kind")), "pii-graph")
    seeds = graph.where("kind >= 0").select("pattern", "shape", "instance", "kind", F.lit(1.0).alias("score"))
    unknown = graph.where("kind < 0").select("pattern", "shape", "instance")
    size = graph.groupBy("pattern", "shape").agg(F.count("*").alias("n"))
    scored = seeds
    for turn in range(ROUNDS):
        patterns = (scored.groupBy("pattern", "shape", "kind")
                    .agg(F.count("*").alias("hits"), F.sum("score").alias("total")).join(size, ["pattern", "shape"])
                    .where(F.col("hits") >= LEAST_SUPPORT)
                    .select("pattern", "shape", "kind", (F.col("total") / F.col("n")).alias("score")))
        patterns = stage(patterns, "pii-patterns")
        if turn + 1 < ROUNDS:
            spread = (unknown.join(patterns, ["pattern", "shape"]).groupBy("instance", "shape", "kind")
                      .agg(F.max("score").alias("score")))
            scored = seeds.union(unknown.join(spread, ["instance", "shape"]).select(
                "pattern", "shape", "instance", "kind", "score"))
    return patterns.where(F.col("score") >= GOOD)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base counts n_email, n_ip, n_card and n_phone, base_sha256 and spans.

    ``base_sha256`` is the hash of the base spans, ``spans`` lists these and the learned
    ones, as kind:start:end in code points, by kind and start. A null text counts as
    empty. Rows are told apart by doc_id and text, so repeated rows agree and null ids
    do no harm; other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                             text.alias("text")).mapInArrow(_found, FOUND), "pii-found")
    mentions = rows.select("doc_id", "text_hash", F.inline("mentions"))
    good = good_patterns(mentions)
    learned = (mentions.where("kind < 0").select("doc_id", "text_hash", "start", "end", "shape",
                                                 F.explode("patterns").alias("pattern"))
               .join(good.select("pattern", "shape", F.col("kind"), "score"), ["pattern", "shape"])
               .groupBy("doc_id", "text_hash", "start", "end")
               .agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
               .groupBy("doc_id", "text_hash")
               .agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
               .select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "more"))
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")))
    return rows.drop("mentions").join(
        learned, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(every).alias("spans"))
