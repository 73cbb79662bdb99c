"""Ids of a tokenizers file for many texts.

``tokenizers`` opens the file and decides what a text gives.  Its own encoder keeps offsets and alignments that
nobody reads here and takes 850 CPU seconds per GB of Parquet, so covered texts go through tiktoken's merge engine,
which is given the vocabulary and merge order that the library read from the same file.  Both merge the lowest-ranked
neighbours first; they agree whenever every vocabulary entry, encoded by itself, gives itself (``same_merges``, asked
by the tests).  Texts that hold special strings, code points this Unicode version doesn't assign, or, for the
lower-casing rule, characters outside Latin, go to the library as a whole.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from routeyard.llm import pieces
from routeyard.llm.common import utf8

BYTE_LEVEL, WORDS = "byte_level", "words"
# Below this every lower-case code point is its own NFC form and no neighbour joins it.
LATIN_END = 0x250
# Stands behind every word in the merge engine, in place of the vocabulary's end-of-word suffix.
MARK = b"\0"
BYTE_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = r"[^\x00]+\x00"


def open_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs one task per core already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, as byte by character."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def lower_case() -> np.ndarray:
    """Lower case of every code point that the fast path of ``WORDS`` takes, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(1, LATIN_END):
        low = chr(i).lower()
        if len(low) == 1 and unicodedata.is_normalized("NFC", low):
            out[i] = ord(low)
    return out


def ranks_of(library) -> tuple[dict[bytes, int], np.ndarray]:
    """Merge ranks by token bytes, and the vocabulary's id of every rank."""
    model = json.loads(library.to_str())["model"]
    vocab, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()

    def raw(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix)
        return bytes(letters[c] for c in (token[:-len(suffix)] if ends else token)) + MARK * ends

    order = [*letters, *([c + suffix for c in letters] if suffix else [])]
    order += ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return {raw(t): i for i, t in enumerate(order)}, np.array([vocab[t] for t in order], np.uint32)


def same_merges(library, rule: str) -> bool:
    """Whether every vocabulary entry gives itself under the file's own merges.

    If so, whatever two neighbours the engine may join by their bytes are also joined by the file: inside the span of
    a token that no merge has crossed, merging goes as it does for the token alone, which ends in the token.
    """
    engine = Engine(library, rule)
    from tokenizers import Tokenizer

    spec = json.loads(library.to_str())
    spec |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
    suffix = spec["model"].get("end_of_word_suffix") or ""
    spec["model"]["end_of_word_suffix"] = None         # entries spelt out: the suffix is part of their last symbol
    if not suffix:
        bare = Tokenizer.from_str(json.dumps(spec))
        return all(e.ids == [i] for i, e in zip(engine.ids.tolist(), bare.encode_batch(
            [bare.id_to_token(i) for i in engine.ids.tolist()], add_special_tokens=False)))
    spec["model"]["end_of_word_suffix"] = suffix
    bare, good = Tokenizer.from_str(json.dumps(spec)), True
    for i in engine.ids.tolist():
        token = bare.id_to_token(i)
        if token.endswith(suffix):
            good &= bare.encode(token[:-len(suffix)], add_special_tokens=False).ids == [i]
    return good


class Engine:
    """tiktoken's merge engine over the vocabulary of a tokenizers file."""

    def __init__(self, library, rule: str):
        import tiktoken

        ranks, self.ids = ranks_of(library)
        self.plain = bool((self.ids == np.arange(len(self.ids))).all())
        self.encoding = tiktoken.Encoding("file", pat_str=BYTE_PATTERN if rule == BYTE_LEVEL else WORD_PATTERN,
                                          mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        found = self.encoding.encode_to_numpy(text, disallowed_special=())
        return found if self.plain else self.ids[found]


@functools.lru_cache(maxsize=4)
def encoder(path: str, rule: str) -> "Encoder":
    """One encoder per worker process."""
    return Encoder(path, rule)


class Encoder:
    def __init__(self, path: str, rule: str):
        self.library, self.rule = open_tokenizer(path), rule
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.engine = Engine(self.library, rule)

    def _covered(self, data: np.ndarray, bounds: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """Which documents the fast path covers; ``bad`` holds bytes at which others have something it doesn't."""
        ok = np.ones(len(bounds) - 1, bool)
        at, raw = [bad], data.tobytes()
        for s in self.special:
            i = raw.find(s)
            while i >= 0:
                at.append(np.array([i]))
                i = raw.find(s, i + 1)
        ok[np.searchsorted(bounds, np.concatenate(at), side="right") - 1] = False
        return ok

    def _one(self, text: str, fast: bool, original: str | None = None) -> np.ndarray:
        if fast:
            try:
                return self.engine.encode(text)
            except ValueError:          # the engine's pattern gives up on very long runs of white space
                pass
        whole = self.library.encode(text if original is None else original, add_special_tokens=False)
        return np.array(whole.ids, np.uint32)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of every text."""
        data, bounds = utf8(column)
        if self.rule == BYTE_LEVEL:
            texts = [t or "" for t in column.to_pylist()]
            rare = data >= 0xCD                             # from U+0340 on; all below are assigned
            if rare.any():
                points, begins = pieces.code_points(data)
                rare = begins[np.flatnonzero(pieces.classes()[points] == pieces.UNKNOWN)]
            else:
                rare = np.zeros(0, np.int64)
            return [self._one(t, fast) for t, fast in zip(texts, self._covered(data, bounds, rare).tolist())]
        points, begins = pieces.code_points(data)
        docs = np.searchsorted(begins, bounds)
        low = lower_case()[points]
        ok = self._covered(data, bounds, begins[np.flatnonzero(low == 0)])
        low, docs = self._marked(low, docs)
        raw = low.tobytes()
        return [self._one(raw[4 * a:4 * b].decode("utf-32-le"), fast, None if fast else column[i].as_py())
                for i, (a, b, fast) in enumerate(zip(docs[:-1].tolist(), docs[1:].tolist(), ok.tolist()))]

    def _marked(self, points: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words without white space, a mark behind each, and where each text now begins."""
        kind = pieces.classes()[points]
        first = pieces.cuts(points, kind, docs[:-1], spaces=False)
        last = np.append(first[1:], len(points))[kind[first] != pieces.SPACE]
        keep = kind != pieces.SPACE
        kept = np.concatenate([[0], np.cumsum(keep)])
        ends = kept[last]
        return np.insert(points[keep], ends, 0), kept[docs] + np.searchsorted(last, docs, side="right")
