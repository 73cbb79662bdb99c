"""Byte-level BPE by two tiers: a minimal perfect hash for whole pieces, a heap for the rest.

Texts are cut into pieces by ``pieces.cuts``.  The distinct pieces of a step are looked up in a minimal perfect hash of
the vocabulary, which gives every entry its own slot among as many slots as there are entries; the entry in the slot is
compared byte by byte.  A piece that isn't an entry is merged: its bytes form a linked list, a heap holds the ranks of
neighbours that can join, and the lowest rank, leftmost first, is joined until none is left.  Merged pieces stay in a
bounded cache of the worker.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from routeyard.llm import pieces
from routeyard.llm.common import register, steps, table, utf8

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
STEP = np.uint64(0x9E3779B97F4A7C15)


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all parts and the offsets between them."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def hashes(parts: list[bytes]) -> np.ndarray:
    data, ends = joined(parts)
    return pieces.span_hashes(data, ends[:-1], ends[1:])


class PerfectHash:
    """A minimal perfect hash by displacement: keys fall into small groups, and each group has the number that sends
    its keys to free slots.  Groups are placed largest first; a group of one key names its slot directly."""

    def __init__(self, keys: list[bytes], group: int = 4):
        h = hashes(keys)
        if len(np.unique(h)) != len(keys):
            raise ValueError("two keys share a 64-bit hash")
        n, groups = len(keys), len(keys) // group + 1
        self.n, self.groups = np.uint64(n), np.uint64(groups)
        self.shift = np.zeros(groups, np.int64)
        where = (h % self.groups).astype(np.int64)
        sizes = np.bincount(where, minlength=groups)
        members = np.split(np.argsort(where, kind="stable"), np.cumsum(sizes)[:-1])
        free = np.ones(n, bool)
        slots = np.zeros(n, np.int64)
        trials = np.arange(1, 513, dtype=np.uint64)
        for g in np.argsort(-sizes, kind="stable").tolist():
            keys_here = members[g]
            if sizes[g] <= 1:
                break
            base = np.uint64(0)
            while True:
                tried = self._slots(h[keys_here][None, :], (base + trials)[:, None])
                good = free[tried].all(axis=1)
                ordered = np.sort(tried, axis=1)
                good &= (np.diff(ordered, axis=1) != 0).all(axis=1)
                if good.any():
                    i = int(np.argmax(good))
                    break
                base += np.uint64(len(trials))
            self.shift[g] = int(base) + i + 1
            slots[keys_here] = tried[i]
            free[tried[i]] = False
        left = iter(np.flatnonzero(free).tolist())
        for g in np.flatnonzero(sizes == 1).tolist():
            slots[members[g]] = slot = next(left)
            self.shift[g] = -slot - 1
        self.order = np.empty(n, np.int64)
        self.order[slots] = np.arange(n)

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (pieces.mix(h + shift * STEP) % self.n).astype(np.int64)

    def index(self, h: np.ndarray) -> np.ndarray:
        """The only key that may have the hash, as its index."""
        shift = self.shift[(h % self.groups).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, self._slots(h, np.abs(shift).astype(np.uint64)))
        return self.order[slot]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: join the neighbours of lowest rank, leftmost first, until no two can join."""
    n = len(piece)
    end = list(range(1, n + 1))            # of the symbol that begins at i
    before = list(range(-1, n - 1))        # beginning of the symbol in front
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue                       # one of the two has grown meanwhile
        end[i], alive[j] = stop, False
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = pattern
        self.entries = list(self.ranks)
        self.ids = np.array(list(self.ranks.values()), "<u4")
        self.hash = PerfectHash(self.entries)
        by_id = [b""] * (int(self.ids.max()) + 1)
        for entry, i in self.ranks.items():
            by_id[i] = entry
        self.bytes, ends = joined(by_id)
        self.begins, self.sizes = ends[:-1], np.diff(ends)
        self.cache = pieces.PieceCache(self._merged)

    def _merged(self, found: list[bytes]) -> list[bytes]:
        return [np.array(merge(p, self.ranks), "<u4").tobytes() for p in found]

    def lookup(self, found: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, from the hash or else by merging."""
        index = self.hash.index(hashes(found))
        entries, raw, at = self.entries, self.ids[index].tobytes(), index.tolist()
        out = [raw[4 * i:4 * i + 4] if entries[k] == p else None for i, (k, p) in enumerate(zip(at, found))]
        missed = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(missed, self.cache.ids([found[i] for i in missed])):
            out[i] = ids
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each text has."""
        data, bounds = utf8(column)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(column), np.int64)
        points, begins = pieces.code_points(data)
        kind = pieces.classes()[points]
        unknown = begins[np.flatnonzero(kind == pieces.UNKNOWN)]
        first = pieces.cuts(points, kind, np.searchsorted(begins, bounds[:-1]), spaces=True)
        starts = begins[first]
        if len(unknown):
            starts = self._recut(data, bounds, starts, unknown)
        ends = np.append(starts[1:], len(data))
        found, inverse = pieces.distinct(data, starts, ends)
        ids, counts = pieces.spread_ids(self.lookup(found), inverse)
        return ids, pieces.per_document(counts, starts, bounds)

    def _recut(self, data, bounds, starts, unknown) -> np.ndarray:
        """Cut the texts that hold unassigned code points by the pattern itself."""
        import regex

        pattern, keep, more = regex.compile(self.pattern), np.ones(len(starts), bool), []
        for d in np.unique(np.searchsorted(bounds, unknown, side="right") - 1).tolist():
            a, b = int(bounds[d]), int(bounds[d + 1])
            keep[np.searchsorted(starts, a):np.searchsorted(starts, b)] = False
            sizes = [len(p.encode()) for p in pattern.findall(data[a:b].tobytes().decode())]
            more.append(a + np.cumsum([0, *sizes[:-1]]))
        return np.sort(np.concatenate([starts[keep], *more]))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all ids in order, and how many each text has."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.begins[ids] - (ends - sizes), sizes)
        out = self.bytes[np.arange(len(shift)) + shift].tobytes()
        sums = np.concatenate([[0], ends])
        at = np.concatenate([[0], np.cumsum(counts)])
        return out, sums[at]


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One vocabulary, with its hash and cache, per worker process."""
    return ByteBpe(path, pattern)


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode and decode every text; (doc_id, n_tokens, ids_sha256, decoded_sha256) per row.

    A null text counts as empty: no ids, no bytes.  Null and repeated doc_ids are kept as they are, one row each; an
    empty table gives no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in batches:
            for part in steps(batch):
                ids, counts = bpe.encode(part.column("text"))
                text, at = bpe.decode(ids, counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.concatenate([[0], np.cumsum(counts)]) * 4
                spans, decoded = list(zip(ends[:-1].tolist(), ends[1:].tolist())), memoryview(text)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in spans],
                    "decoded_sha256": [hashlib.sha256(decoded[a:b]).hexdigest()
                                       for a, b in zip(at[:-1].tolist(), at[1:].tolist())]})

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


@register("op7_byte_bpe")
def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                   public_tokenizers.PATTERN)
