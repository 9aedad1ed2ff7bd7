"""Word and shingle hashes of many texts at once, computed over their UTF-8 bytes with numpy.

A word's 64-bit hash is a polynomial over random byte values; a shingle's hash combines the hashes of
its words. Texts run together in chunks of bounded size, so memory does not follow the batch.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text that are hashed together.
CHUNK = 1 << 20

_M64 = (1 << 64) - 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_FOLDED = _BYTE[_LOWER]

#: Bytes that part words: blank, tab and the line ends.
BLANKS = np.zeros(256, bool)
BLANKS[[32, *range(9, 14)]] = True
#: Every ASCII byte but digits and letters. Upper case counts as a letter, as it is folded.
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of the hashes over all bits."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def encoded(texts) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def spans(texts: Sequence[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that hold about ``limit`` bytes together, one text at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo = i
            size = 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def word_hashes(
    texts: Sequence[bytes], apart: np.ndarray = BLANKS, heads: Sequence[int] = ()
) -> tuple[np.ndarray, ...]:
    """Hashes of all words of the texts in order, A-Z folded, and the bounds of each text among them.

    ``heads``: also the hashes of each word's first so many bytes, one array for each number.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = apart[joined]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, end = edge[::2], edge[1::2]
    total = _BYTE_FOLDED[joined]
    total *= powers(_BASE, len(joined))
    np.cumsum(total, out=total)
    # the byte before a word is a gap, so its own term lies in neither bound's difference
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    back = powers(_INVERSE, len(joined))[start]
    words = mix((total[end - 1] - before) * back)
    begun = [mix((total[np.minimum(start + k, end) - 1] - before) * back + np.uint64(k)) for k in heads]
    stops = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return words, np.concatenate([[0], np.searchsorted(start, stops)]), *begun


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, runs across texts included: one per start."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _PLACE[0]
    for j in range(1, width):
        h += words[j : j + n] * _PLACE[j]
    return mix(h + np.uint64(width))


def shingle_sets(texts: Sequence[bytes], width: int = 5, apart: np.ndarray = BLANKS, whole: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    With fewer words than ``width`` the whole sequence is the one shingle (``whole``), without words
    the set is empty.
    """
    for lo, hi in spans(texts):
        words, bound = word_hashes(texts[lo:hi], apart)
        every = shingle_hashes(words, width)
        for i in range(hi - lo):
            a, b = bound[i], bound[i + 1]
            if b - a >= width:
                yield np.unique(every[a : b - width + 1])
            elif b > a and whole:
                yield shingle_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)
