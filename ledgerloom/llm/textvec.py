"""Words and character n-grams of many texts at once, as numpy arrays.

Tasks call this on one Arrow batch in slices of bounded size, so memory follows the slice (or the one
longest text), not the partition.  A word is a maximal run of digits, letters a-z and bytes from 0x80 on,
after lower-casing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SLICE_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    n = 1 << bits
    return (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE)]), dtype=np.uint64),
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]), dtype=np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: Sequence[str | None], limit: int = SLICE_BYTES) -> Iterator[slice]:
    """Cut a batch so that each piece has about ``limit`` characters at most, or one text."""
    start = held = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > start and held + n > limit:
            yield slice(start, k)
            start, held = k, 0
        held += n
    if len(texts) > start:
        yield slice(start, len(texts))


@dataclass
class Words:
    n_docs: int
    doc: np.ndarray  # the text of each word
    hash: np.ndarray  # uint64
    start: np.ndarray  # byte places in data
    end: np.ndarray
    data: np.ndarray
    prefix: np.ndarray  # running sums of bytes times powers, for hashes of any stretch
    word_byte: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def stretch(self, start: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the ``length`` bytes from each start."""
        _, inverse = _powers(max(len(self.data) + 1, 2).bit_length())
        return mixed((self.prefix[start + length] - self.prefix[start]) * inverse[start] + np.uint64(length))


def read(texts: Sequence[str | None]) -> Words:
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8)
    is_word = _IS_WORD[data]
    edge = np.diff(is_word.astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    powers, inverse = _powers(max(len(data) + 1, 2).bit_length())
    clean = np.where(is_word, data, 32).astype(np.uint64)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(clean * powers[: len(data)], dtype=np.uint64)])
    hashes = mixed((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    begins = np.cumsum([1] + [len(r) + 1 for r in raw])
    doc = np.searchsorted(begins, start, side="right") - 1
    return Words(len(texts), doc.astype(np.int64), hashes, start, end, data, prefix, is_word)


def grams(words: Words, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: (start, hash) of the n-grams inside words, where a bounding blank counts as a character."""
    breaks = np.concatenate([[0], np.cumsum(~words.word_byte)])
    n = len(words.data)
    for size in sizes:
        at = np.arange(0, max(n - size, 0))
        at = at[(breaks[at + size - 1] - breaks[at + 1]) == 0] if size > 2 else at
        both = (breaks[at + size] - breaks[at]) < size  # not blanks alone
        at = at[both]
        yield at, words.stretch(at, size)


def shingle_sets(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every text's distinct shingles of ``size`` words, sorted; shorter texts have one shingle of all their words."""
    n, h, doc = len(words.hash), words.hash, words.doc
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    counts = words.counts
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    length = np.minimum(counts[doc], size)
    place = np.arange(n) - first[doc]
    good = np.flatnonzero(place + length <= counts[doc])
    total = np.zeros(len(good), np.uint64)
    for k in range(size):
        part = good + k
        inside = k < length[good]
        total = np.where(inside, mixed(total + h[np.minimum(part, n - 1)] + np.uint64(k + 1)), total)
    order = np.lexsort((total, doc[good]))
    d, t = doc[good][order], total[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    return d[keep], t[keep]
