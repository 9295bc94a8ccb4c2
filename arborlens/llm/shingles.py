"""Hashed word shingles of whole texts, vectorised over the bytes of a batch.

Words are maximal runs of bytes other than blank and 0x09-0x0D, with A-Z lower-cased. A word and a run of five words
become 64-bit hashes; a document's set is the sorted distinct hashes. Texts with one to four words give one hash of the
whole sequence, texts without words (or null) an empty set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WIDTH = 5
PIECE = 1 << 20  # bytes of text worked on at once; the arrays of a piece take some 40 times as much
_MASK = (1 << 64) - 1


def _random(count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, size=count, dtype=np.uint64)


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _random(256, 11)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_STEP = _random(1, 12)[0] | np.uint64(1)
_PLACE = _random(WIDTH, 13) | np.uint64(1)
_SHORT = _random(WIDTH, 14)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SEPARATOR[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    length = np.diff(np.r_[first, len(at)])
    place = np.arange(len(at)) - np.repeat(first, length)
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(length.max() - 1, _STEP, np.uint64)])
    total = np.add.reduceat(_BYTE[data[at]] * power[place], first)
    return mix(total + length.astype(np.uint64))


def words_of(raw: bytes) -> np.ndarray:
    """Hash of each word, in order; long texts go piece by piece, cut between words."""
    if len(raw) <= PIECE:
        return _word_hashes(raw)
    parts, start = [], 0
    while start < len(raw):
        end = min(start + PIECE, len(raw))
        while end < len(raw) and not _SEPARATOR[raw[end]]:
            end += 1
        parts.append(_word_hashes(raw[start:end]))
        start = end
    return np.concatenate(parts)


def shingles_of(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the five-word runs."""
    if not len(words):
        return words
    if len(words) < WIDTH:
        return mix((words * _PLACE[:len(words)]).sum(dtype=np.uint64, keepdims=True) + _SHORT[len(words)])
    count = len(words) - WIDTH + 1
    total = words[:count] * _PLACE[0]
    for i in range(1, WIDTH):
        total += words[i:i + count] * _PLACE[i]
    return np.unique(mix(total))


def sets_of(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The set of each text."""
    block: list[bytes] = []
    size = 0

    def solve() -> Iterator[np.ndarray]:
        if len(block) == 1:
            yield shingles_of(words_of(block[0]))
            return
        words = _word_hashes(b" ".join(block))
        ends = np.cumsum([_count(b) for b in block])
        for start, end in zip(np.r_[0, ends[:-1]], ends):
            yield shingles_of(words[start:end])

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if block and size + len(raw) > PIECE // 4:
            yield from solve()
            block, size = [], 0
        block.append(raw)
        size += len(raw)
    if block:
        yield from solve()


def _count(raw: bytes) -> int:
    inside = ~_SEPARATOR[np.frombuffer(raw, np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]) + inside[:1].sum())
