"""BPE encoding and decoding by a depth-first walk over the trie of distinct words.

BPE encodes a prefix of a word as the encoding of a shorter prefix followed by one
token, the prefix's last token. So one state per trie node is enough: the last token
and where it begins. It is the one vocabulary entry that ends the prefix and may follow
the last token before it, and words that share a prefix share these states. Sorted
words come in the depth-first order of their trie, and a stack holds the states of the
path to the current word.

Two tokens may stand side by side if no merge across their border comes first. The
tokens next to the border are, over time, the right ends of the left token's merge
tree and the left ends of the right one's; a merge of two of these wins if its rank is
lower than those of the merges that would use either up.

Tokenizer files are those of the ``tokenizers`` library: a BPE model with an end-of-word
suffix, a lower-casing normaliser and a splitting pattern. Letters are what the
``regex`` module knows as letters; a code point that a newer Unicode version than the
tokenizer's own made a letter is one here.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sitegauge.llm import words as W

#: Encoded words that a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000


def _byte_letters() -> list[str]:
    """Letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Tokenizer:
    """Encodes words of one tokenizer file and remembers them."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = regex.compile(
            "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.letters = _byte_letters()
        self.tokens = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair = self.ids[left], self.ids[right]
            self.rank[pair] = rank
            self.parts.setdefault(self.ids[left + right], (*pair, rank))
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        self.remembered = remembered
        self.memo: dict[str, tuple[str, str]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.ends: dict[tuple[int, int], list[tuple[int, float]]] = {}

    # -- pairs -----------------------------------------------------------------------

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at one end of a token's merge tree, each with the rank that uses it up."""
        found = self.ends.get((token, side))
        if found is None:
            found, used = [], float("inf")
            at: int | None = token
            while at is not None:
                found.append((at, used))
                left_right_rank = self.parts.get(at)
                if left_right_rank is None:
                    at = None
                else:
                    at, used = left_right_rank[side], left_right_rank[2]
            self.ends[token, side] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b as they are, side by side."""
        known = self.fits.get((a, b))
        if known is None:
            rank = self.rank
            known = True
            for u, used_u in self._spine(a, 1):
                for v, used_v in self._spine(b, 0):
                    across = rank.get((u, v))
                    # of two equal pairs the left one is merged first
                    if across is not None and across < used_u and across <= used_v:
                        known = False
            self.fits[a, b] = known
        return known

    def is_whole(self, token: int) -> bool:
        """Whether BPE makes this token of its own letters."""
        known = self.whole.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = parts is None or (
                self.is_whole(parts[0]) and self.is_whole(parts[1]) and self._first_across(*parts))
            self.whole[token] = known
        return known

    def _first_across(self, a: int, b: int, rank: int) -> bool:
        """Whether the first merge across the border of a and b is that of a and b."""
        return not any(
            (across := self.rank.get((u, v))) is not None and (u, v) != (a, b)
            and across < used_u and across <= used_v
            for u, used_u in self._spine(a, 1) for v, used_v in self._spine(b, 0))

    # -- words -----------------------------------------------------------------------

    def _last_token(self, word: str, k: int, tail: str, states: list[tuple[int, int]]) -> tuple[int, int]:
        """State of the prefix of length k: its last token and where that begins."""
        ids = self.ids
        for j in range(max(0, k - self.longest), k):
            token = ids.get(word[j:k] + tail)
            if token is not None and self.is_whole(token) and (
                    j == 0 or self.may_follow(states[j][0], token)):
                return token, j
        raise ValueError(f"no token of this vocabulary ends {word[:k]!r}")

    def _learn(self, new: list[str]) -> None:
        """Encode words that are not remembered yet, in one walk over their trie."""
        spelled = sorted(("".join([self.letters[b] for b in w.encode()]) if not w.isascii() or not w.isprintable()
                          else w, w) for w in new)
        states: list[tuple[int, int]] = [(-1, 0)]
        before = ""
        for word, original in spelled:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            # the states of whole words are not of the path: their last letter is another
            del states[min(shared, len(word) - 1) + 1:]
            for k in range(len(states), len(word)):
                states.append(self._last_token(word, k, "", states))
            token, j = self._last_token(word, len(word), self.end, states)
            found = [token]
            while j:
                token, j = states[j]
                found.append(token)
            found.reverse()
            self.memo[original] = (" ".join(map(str, found)), " ".join([self.tokens[t] for t in found]))
            before = word

    def words_of(self, text: str) -> list[str]:
        """Words of a text; an added token stands as one word of its own."""
        if not self.added_pattern.search(text):
            return self._plain_words(text)
        out: list[str] = []
        at = 0
        for m in self.added_pattern.finditer(text):
            out += self._plain_words(text[at:m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._plain_words(text[at:])

    def _plain_words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids and its tokens, each joined by one space."""
        split = [self.words_of(t) for t in texts]
        if len(self.memo) > self.remembered:
            self.memo.clear()
            self.fits.clear()
        for content, token in self.added.items():
            self.memo.setdefault(content, (str(token), content))
        memo = self.memo
        self._learn([w for w in set().union(*split) if w not in memo])
        for own in split:
            pairs = [memo[w] for w in own]
            yield " ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])

    def decode(self, ids: list[int]) -> str:
        """Tokens of the ids, joined by one space: these files name no decoder."""
        added = {i: t for t, i in self.added.items()}
        return " ".join(self.tokens[i] if i in self.tokens else added[i] for i in ids)


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(path: str) -> Tokenizer:
    """One per worker process and file, so that its words are remembered between tasks, until another operator's."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
        W.hold(_loaded.clear)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, and the whole text's ``ids`` and ``decoded`` tokens, space-joined."""

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in W.slices(batches, 500):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, decoded = zip(*tokenizer.encode_batch(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.large_string()),
                                              pa.array(decoded, pa.large_string())], names=["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(
        encode_rows, "doc_id long, ids string, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens and SHA-256 of the ids and of the decoded text.

    A null or empty text, or one of white space alone, has no tokens and decodes to
    the empty text. Rows are encoded one by one, so repeated rows and null ids stay as
    they are; other columns are ignored; an empty table gives an empty result. The
    tokenizer file must be at ``path`` on every executor.
    """

    def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in W.slices(batches, 500):
            found = list(tokenizer.encode_batch([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in found], pa.int64()),
                pa.array([sha(ids) for ids, _ in found]), pa.array([sha(decoded) for _, decoded in found])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(
        digest_rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
