"""Token counts of whole texts, huge documents in overlapping chunks.

A document of more than ``chunk`` characters is encoded chunk by chunk, each running ``overlap`` characters into the next
one, with the character at which every token begins.  Two neighbouring chunks are spliced at a boundary that both of them
have and that is proven stable: a blank behind another character, where no vocabulary entry continues across, so what
stands left of it can't change the tokens right of it.  If an overlap has no such place, it is doubled until one is
found or the text ends.  ``crosses_blanks`` checks the vocabulary; with one that has pieces across blanks, no place is
stable and documents are encoded whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeyard.llm.common import register, steps, table

CHUNK, OVERLAP = 1 << 15, 256
LIMIT = 4096
BLANK = "▁"


def crosses_blanks(model) -> bool:
    """Whether an entry holds a blank behind another character, or the model treats blanks as word ends."""
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return any(BLANK in p.lstrip(BLANK) for p in found)


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk = None if crosses_blanks(self.model) else chunk
        self.overlap = overlap

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        short = [i for i, t in enumerate(texts) if self.chunk is None or len(t) <= self.chunk]
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1, return_type="numpy")):
            out[i] = len(ids)
        for i in set(range(len(texts))).difference(short):
            out[i] = self.spliced(texts[i])
        return out

    def _begins(self, text: str, start: int, end: int) -> np.ndarray:
        """Characters of the whole text at which the tokens of text[start:end] begin."""
        found = self.model.encode(text[start:end], return_type="offset_mapping")["offsets"]
        return np.fromiter((begin for begin, _ in found), np.int64, len(found)) + start

    def spliced(self, text: str) -> int:
        total, start, settled = 0, 0, 0           # tokens before the character `settled` are counted
        here = self._begins(text, 0, min(len(text), self.chunk + self.overlap))
        while True:
            following, overlap = start + self.chunk, self.overlap
            end = min(len(text), following + overlap)
            while end < len(text):
                right = self._begins(text, following, min(len(text), following + self.chunk + overlap))
                common = np.intersect1d(here, right)
                common = common[(common > max(following, settled)) & (common < end)]
                place = next((int(p) for p in common if text[p] == " " and not text[p - 1].isspace()), None)
                if place is not None:
                    break
                overlap *= 2
                end = min(len(text), following + overlap)
                here = self._begins(text, start, end)
            else:
                return total + int((here >= settled).sum())
            total += int(((here >= settled) & (here < place)).sum())
            start, settled, here = following, place, right


@functools.lru_cache(maxsize=4)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row.

    A null text counts as empty: no bytes, no tokens.  Null and repeated doc_ids are kept as they are, one row each; an
    empty table gives no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model, chunk, overlap)
        for batch in batches:
            for part in steps(batch):
                texts = pc.fill_null(part.column("text"), "")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                    "n_tokens": pa.array(tokens.counts(texts.to_pylist()), pa.int64())})

    counted = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@register("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
