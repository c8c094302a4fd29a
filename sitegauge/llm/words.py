"""Words and word shingles of whole Arrow batches, hashed with numpy.

A word is a run of bytes other than ``\\x20`` and ``\\x09`` to ``\\x0D``, with A-Z
lower-cased. All of these are ASCII, so the work is done on UTF-8 bytes, for many
texts at a time and without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in pieces of about so many bytes; a longer text is a piece of its own.
PIECE_BYTES = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A"):ord("Z") + 1] += 32
_CODES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.random.default_rng(21).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


_held: list[Callable[[], None]] = []


def hold(forget: Callable[[], None]) -> None:
    """Say how to give up what this worker process remembers between the tasks of one operator."""
    _held.append(forget)


def make_room() -> None:
    """Give up what another operator's tasks left in this worker; Spark uses workers again for later stages."""
    while _held:
        _held.pop()()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the len + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about PIECE_BYTES each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is made from one at a time stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the number of words of every text."""
    n = len(offsets) - 1
    inside = ~_SPACE[data]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = inside[edges]
    at = np.flatnonzero(starts)
    counts = np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=n)
    kept = np.flatnonzero(inside)
    first = np.searchsorted(kept, at)
    lengths = np.diff(np.append(first, len(kept)))
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    sums = np.add.reduceat(_CODES[data[kept]] * powers[place], first)
    return mix(sums + lengths.astype(np.uint64)), counts


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``size`` words, repeats included, and their number per text.

    A text of fewer words, but at least one, has its whole word sequence as its one
    shingle. A text without words has none.
    """
    words, counts = word_hashes(data, offsets)
    if not len(words):
        return words, counts
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    inside = np.arange(len(words)) - np.repeat(first, counts)
    in_text = np.repeat(counts, counts)
    rolled = np.zeros(len(words), np.uint64)
    for i in range(size):
        # in a short text the missing words add nothing
        there = inside + i < in_text
        rolled[there] += np.roll(words, -i)[there] * _PLACES[i]
    kept = inside < np.repeat(per_text, counts)
    length = np.minimum(in_text, size)
    return mix(rolled + length.astype(np.uint64))[kept], per_text
