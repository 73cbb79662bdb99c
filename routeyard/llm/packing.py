"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents, tokenised and closed by an end id, form one stream in doc_id order.  The stream is cut into windows of at
most ``window`` tokens.  A cut may stand behind a document (free), behind a sentence (``sentence_penalty``) or, where a
sentence is long, at every 64th token (``token_penalty``); a window shorter than ``window`` costs its padding, unless its
length is a power of two, which is never padded.  With f(j) the least cost of a prefix ending at cut j,

    f(j) = penalty(j) + min over cuts i within the window of f(i) + window - (p(j) - p(i)),

so the best i is the least f(i) + p(i) in a sliding window, which a monotone queue holds in constant time per cut;
lengths that are powers of two add at most eleven more candidates.

Every Spark partition packs its own range of doc_ids in blocks of bounded size: when a block is full its windows are
settled and what follows the last cut opens the next block.  Memory is bounded by one block and one document.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeyard.llm import library
from routeyard.llm.common import register, steps, table

WINDOW, END_ID = 2048, 1
SENTENCE_PENALTY, TOKEN_PENALTY = 8.0, 64.0
BLOCK = 1 << 19
GRID = 64
# A partition has fewer windows than this.
WINDOWS_PER_PARTITION = 1 << 40
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int, final: bool) -> list[int]:
    """Indices of the cheapest chain of cuts over increasing ``places`` (the first is 0).

    With ``final`` the chain ends at the last place; otherwise at the cheapest place of the last window, and what
    follows it is left to the caller.  Neighbouring places are at most ``window`` apart.
    """
    n = len(places)
    powers: dict[int, list[int]] = {}
    index = np.full(int(places[-1]) + 1, -1, np.int64)
    index[places] = np.arange(n)
    k = 1
    while k < window:
        back = places - k
        found = np.where(back >= 0, index[np.maximum(back, 0)], -1)
        for j in np.flatnonzero(found >= 0).tolist():
            powers.setdefault(j, []).append(int(found[j]))
        k *= 2
    at, fee = places.tolist(), penalties.tolist()
    cost, came, key = [0.0] * n, [0] * n, [0.0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        here = at[j]
        while at[queue[0]] < here - window:
            queue.popleft()
        i = queue[0]
        best = key[i] + window - here
        for other in powers.get(j, ()):
            if cost[other] < best:
                best, i = cost[other], other
        cost[j], came[j] = best + fee[j], i
        key[j] = mine = cost[j] + here
        while queue and key[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not final:
        first = int(np.searchsorted(places, places[-1] - window + 1))
        j = min(range(max(first, 1), n), key=lambda x: (cost[x], -x))
    chain = [j]
    while j:
        j = came[j]
        chain.append(j)
    return chain[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, sentence_penalty: float,
               token_penalty: float, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a stream may be cut, less than a window apart, and what a cut costs there."""
    spacing = max(1, min(GRID, window // 4))
    sentences = np.flatnonzero(ends_sentence[ids]) + 1
    near = np.unique(np.concatenate([[0], sentences, doc_ends, [len(ids)]]))
    gaps = np.diff(near)
    wide = np.flatnonzero(gaps > 2 * spacing)
    grid = [np.arange(near[i] + spacing, near[i + 1] - spacing // 2, spacing) for i in wide.tolist()]
    places = np.unique(np.concatenate([near, *grid]))
    fee = np.full(int(places[-1]) + 1, token_penalty)
    fee[sentences] = sentence_penalty
    fee[doc_ends] = 0.0
    return places, fee[places]


class Packer:
    """Packs one partition's documents as they arrive."""

    def __init__(self, ends_sentence: np.ndarray, partition: int, window: int, sentence_penalty: float,
                 token_penalty: float, block: int):
        self.ends_sentence, self.window, self.block = ends_sentence, window, block
        self.fees = (sentence_penalty, token_penalty)
        self.next = partition * WINDOWS_PER_PARTITION
        self.docs: list[tuple] = []         # (doc_id, ids not packed yet, how many are packed)
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[dict]:
        self.docs.append((doc_id, ids, 0))
        self.size += len(ids)
        if self.size >= self.block:
            yield self.settle(final=False)

    def settle(self, final: bool) -> dict:
        ids = np.concatenate([d[1] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) for d in self.docs])
        places, fees = cut_places(ids, doc_ends, self.ends_sentence, *self.fees, self.window)
        cuts = places[best_cuts(places, fees, self.window, final)]
        done = int(cuts[-1])
        bounds = np.unique(np.concatenate([cuts, doc_ends[doc_ends < done]]))
        starts, ends = bounds[:-1], bounds[1:]
        doc = np.searchsorted(doc_ends, starts, side="right")
        window = np.searchsorted(cuts, starts, side="right") - 1
        doc_starts = np.concatenate([[0], doc_ends[:-1]])
        packed = np.array([d[2] for d in self.docs])
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        out = {"doc_id": [self.docs[i][0] for i in doc.tolist()], "start": starts - doc_starts[doc] + packed[doc],
               "length": ends - starts,
               "ids_crc32": [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())],
               "doc_tokens": np.diff(np.concatenate([[0], doc_ends]))[doc] + packed[doc],
               "sequence_id": self.next + window, "offset": starts - cuts[window]}
        self.next += len(cuts) - 1
        i = int(np.searchsorted(doc_ends, done, side="right"))
        rest = self.docs[i:]
        if rest and (used := done - int(doc_starts[i])) > 0:
            rest[0] = (rest[0][0], rest[0][1][used:], rest[0][2] + used)
        self.docs, self.size = rest, int(len(ids)) - done
        return out


def sentence_ends(encoder: library.Encoder, end_id: int) -> np.ndarray:
    """For every id, whether a sentence or a line ends behind it."""
    tokens = encoder.library.get_vocab()
    out = np.zeros(max(max(tokens.values()), end_id) + 1, bool)
    letters = library.byte_letters()
    for token, i in tokens.items():
        raw = bytes(letters[c] for c in token if c in letters)
        out[i] = raw.endswith((b".", b"!", b"?")) or b"\n" in raw
    return out


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of doc_id, ordered inside each; repeated ids are spread by their text."""
    tie = F.xxhash64("text")
    return (docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), tie)
            .sortWithinPartitions(F.col("doc_id"), tie))


def pack(docs: DataFrame, tokenizer: str, rule: str = library.BYTE_LEVEL, window: int = WINDOW, end_id: int = END_ID,
         sentence_penalty: float = SENTENCE_PENALTY, token_penalty: float = TOKEN_PENALTY,
         block: int = BLOCK) -> DataFrame:
    """One row per piece of a document in a sequence.

    A null or empty text packs as the end id alone; a null doc_id stays null; rows that repeat a doc_id are packed as
    documents of their own; an empty table gives no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library.encoder(tokenizer, rule)
        packer = Packer(sentence_ends(encoder, end_id), TaskContext.get().partitionId(), window, sentence_penalty,
                        token_penalty, block)
        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
        for batch in batches:
            for part in steps(batch):
                doc_ids = part.column("doc_id").to_pylist()
                for doc_id, ids in zip(doc_ids, encoder.encode(part.column("text"))):
                    for rows in packer.add(doc_id, np.append(ids, np.uint32(end_id))):
                        yield pa.RecordBatch.from_pydict(rows, schema=schema)
        if packer.docs:
            yield pa.RecordBatch.from_pydict(packer.settle(final=True), schema=schema)

    return in_order(docs).mapInArrow(run, SCHEMA)


@register("op3_packing")
def op3_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
