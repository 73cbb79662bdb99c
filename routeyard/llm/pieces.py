"""Vectorised pre-tokenisation: texts of one step are cut into pieces by character class.

The byte-level rule is the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``; the word rule drops white space and takes
numbers one by one.  Cuts come from comparing the classes of neighbouring
characters, so no expression engine runs over the text.  Pieces repeat a lot:
each step reduces them to the distinct ones, and only these reach an encoder.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
# White space as Unicode's property lists it.  Fixed values.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
               0x3000)
BASE = np.uint64(0x9E3779B97F4A7C15)
LONG_PIECE = 64


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point; those that this Unicode version doesn't assign are UNKNOWN."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER)
                       for i in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = SPACE
    return out


@functools.cache
def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of BASE modulo 2**64."""
    return _powers(1 << max(16, int(n).bit_length()))[:n]


def inverse_powers(n: int) -> np.ndarray:
    return _inverse(1 << max(16, int(n).bit_length()))[:n]


@functools.cache
def _inverse(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, the same for equal spans wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse_powers(len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte at which each begins, with the total length last."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    return points, np.append(begins, len(data))


def _contractions(points: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of apostrophes that begin a piece: those followed by s t m d re ve ll, and the length of that piece."""
    padded = np.concatenate([points, np.zeros(3, np.uint32)])
    one, two = padded[at + 1], padded[at + 2]
    inside1, inside2 = at + 1 < last, at + 2 < last
    short = inside1 & np.isin(one, [ord(c) for c in "stmd"])
    long = inside2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
                      | ((one == ord("l")) & (two == ord("l"))))
    return at[short | long], np.where(short, 2, 3)[short | long]


def cuts(points: np.ndarray, kind: np.ndarray, doc_starts: np.ndarray, spaces: bool) -> np.ndarray:
    """Indices at which a piece begins.

    ``spaces`` selects the byte-level rule, where a blank belongs to the piece
    behind it; otherwise white space is left to the caller to drop and every
    number is a piece of its own.
    """
    n = len(points)
    begin = np.zeros(n + 1, bool)
    begin[doc_starts] = True
    first = begin[:n].copy()
    before = np.concatenate([[np.uint8(SPACE)], kind[:-1]])
    begin[:n] |= kind != before
    is_space = kind == SPACE
    if spaces:
        follows = np.concatenate([kind[1:] != SPACE, [False]])
        ends_doc = np.concatenate([first[1:], [True]])
        last_space = is_space & follows & ~ends_doc
        # the last white space before other characters stands alone, or joins them if it is a blank
        begin[:n] |= last_space
        joined = np.flatnonzero(last_space & (points == 32))
        begin[joined + 1] = False
    else:
        begin[:n] |= kind == NUMBER
    quote = np.flatnonzero(begin[:n] & (points == 39))
    if len(quote):
        bounds = np.append(doc_starts, n)
        last = bounds[np.searchsorted(bounds, quote, side="right")]
        at, length = _contractions(points, quote, last)
        begin[at + 1] = False
        begin[np.minimum(at + length, n)] = True
    return np.flatnonzero(begin[:n])


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte spans and, for every span, the index of its own."""
    raw = data.tobytes()
    h = span_hashes(data, starts, ends)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    out = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    if (wide := np.flatnonzero(ends - starts > LONG_PIECE)).size:   # long spans are told apart by their bytes
        known: dict[bytes, int] = {}
        for i in wide.tolist():
            piece = raw[starts[i]:ends[i]]
            if piece not in known:
                known[piece] = len(out)
                out.append(piece)
            inverse[i] = known[piece]
    return out, inverse


class PieceCache:
    """Ids of pieces seen before (as little-endian 32-bit bytes), at most ``limit`` of them; ``encode`` gets the rest."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], limit: int = 1 << 18):
        self.encode, self.limit, self.known = encode, limit, {}

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        missing = [p for p in pieces if p not in known]
        if missing:
            if len(known) + len(missing) > self.limit:
                known.clear()
                missing = pieces
            known.update(zip(missing, self.encode(missing)))
        out = [known[p] for p in pieces]
        if len(known) > self.limit:
            known.clear()
        return out


def spread_ids(lists: list[bytes], inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in order, and how many each piece has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) >> 2
    flat = np.frombuffer(b"".join(lists), "<u4")
    begins = np.cumsum(sizes) - sizes
    counts = sizes[inverse]
    shift = np.repeat(begins[inverse] - (np.cumsum(counts) - counts), counts)
    return flat[np.arange(len(shift)) + shift], counts


def per_document(counts: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of counts over the spans of each document; ``bounds`` are the documents' byte offsets."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    at = np.searchsorted(starts, bounds, side="left")
    return sums[at[1:]] - sums[at[:-1]]
