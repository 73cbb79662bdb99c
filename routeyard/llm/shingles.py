"""Words and word windows of many texts at once, as 64-bit hashes computed over whole byte buffers."""

from __future__ import annotations

import numpy as np

from routeyard.llm import pieces

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Bytes of words that run between the blanks 0x20 and 0x09 to 0x0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def factors(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return pieces.mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def word_spans(data: np.ndarray, bounds: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of every text (with the total last)."""
    inside = letters[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    left = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    right = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(inside & ~left)
    return starts, np.flatnonzero(inside & ~right) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, bounds: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word after lower-casing A to Z, and the index of the first word of every text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    data = LOWER[data]
    starts, ends, first = word_spans(data, bounds, letters)
    return pieces.span_hashes(data, starts, ends), first


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from every word on, regardless of where texts end."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j, f in enumerate(factors(size, 1)):
        out += words[j:j + n] * f
    return pieces.mix(out)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of every text; a shorter text has its whole sequence as one, or none without words."""
    words, first = word_hashes(data, bounds, NOT_BLANK)
    rolled = windows(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a:b - size + 1]))
        elif b > a:
            short = (words[a:b] * factors(b - a, 1)).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(pieces.mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
