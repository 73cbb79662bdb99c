"""Token ids in files of independent zstandard frames with a seek table.

A file is a run of zstandard frames, each holding the little-endian 32-bit ids of some consecutive documents (a large
document fills several frames), then two skippable frames.  The first holds the document table: doc_id and number of ids
per document (a null doc_id is written as the least 64-bit number).  The second is the seek table of the public "seekable" layout: per
frame the compressed size, the decompressed size and the low 32 bits of XXH64 of its content, then the number of frames,
a flag byte and a magic number.  A reader takes the tail, finds the frames of the documents it wants, and decompresses
only those; plain zstandard readers see one stream of ids, since they pass over skippable frames.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeyard.llm import library
from routeyard.llm.common import open_folder, publish, register, shared_path, steps, stored, table
from routeyard.llm.packing import in_order

# Fixed values of the public layouts.
SKIPPABLE_DOCS, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
FRAME_IDS = 1 << 16
NULL_ID = -(1 << 63)                # what stands where a document has no id; the bits of the document table tell it from the id


class FrameWriter:
    """Writes documents into one file; holds at most one frame of ids."""

    def __init__(self, out, level: int = 1, frame_ids: int = FRAME_IDS):
        self.out, self.frame_ids = out, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []
        self.present: list[bool] = []
        self.counts: list[int] = []
        self.held: list[np.ndarray] = []
        self.size, self.opened = 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self.present.append(doc_id is not None)
        self.counts.append(len(ids))
        at = 0
        while at < len(ids):
            part = ids[at:at + self.frame_ids - self.size]
            self.held.append(part)
            self.size += len(part)
            at += len(part)
            if self.size == self.frame_ids:
                self.flush()

    def flush(self) -> None:
        if not self.size:
            return
        raw = np.concatenate(self.held).astype("<u4").tobytes()
        frame = self.packer.compress(raw)
        self.out.write(frame)
        self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        docs = struct.pack("<Q", len(self.doc_ids)) + np.array(self.doc_ids, "<i8").tobytes()
        docs += np.array(self.counts, "<u8").tobytes() + np.packbits(self.present, bitorder="little").tobytes()
        docs = self.packer.compress(docs)
        self.out.write(struct.pack("<II", SKIPPABLE_DOCS, len(docs)) + docs)
        table_ = b"".join(struct.pack("<III", *f) for f in self.frames)
        table_ += struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table_)) + table_)


class FrameReader:
    """Reads the tables of a file, and the frames that hold the documents asked for."""

    def __init__(self, source, size: int):
        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        tail = self._read(size - 9, 9)
        n, flags, magic = struct.unpack("<IBI", tail)
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table")
        begin = size - 9 - 12 * n
        rows = np.frombuffer(self._read(begin, 12 * n), "<u4").reshape(-1, 3)
        self.sizes, self.raw_sizes, self.sums = rows[:, 0], rows[:, 1].astype(np.int64), rows[:, 2]
        self.begins = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        docs_at = int(self.begins[-1])
        magic, length = struct.unpack("<II", self._read(docs_at, 8))
        if magic != SKIPPABLE_DOCS or docs_at + 8 + length + 8 != begin:
            raise ValueError("no document table")
        docs = self.unpacker.decompress(self._read(docs_at + 8, length))
        count = struct.unpack_from("<Q", docs)[0]
        self.doc_ids = np.frombuffer(docs, "<i8", count, 8)
        self.counts = np.frombuffer(docs, "<u8", count, 8 + 8 * count).astype(np.int64)
        bits = np.frombuffer(docs, np.uint8, -(-count // 8), 8 + 16 * count)
        self.present = np.unpackbits(bits, count=count, bitorder="little").astype(bool)
        self.ends = np.cumsum(self.counts)
        self.id_begins = np.concatenate([[0], np.cumsum(self.raw_sizes)]) // 4

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        out = self.source.read(n)
        if len(out) != n:
            raise ValueError("file is cut short")
        return out

    def frame(self, k: int) -> np.ndarray:
        raw = self.unpacker.decompress(self._read(int(self.begins[k]), int(self.sizes[k])),
                                       max_output_size=int(self.raw_sizes[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"checksum of frame {k}")
        return np.frombuffer(raw, "<u4")

    def parts(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(index of document, ids) for indices in ascending order; a document comes in one part per frame."""
        have, ids = -1, None
        for d in wanted:
            at, end = int(self.ends[d] - self.counts[d]), int(self.ends[d])
            while at < end:
                k = int(np.searchsorted(self.id_begins, at, side="right")) - 1
                if k != have:
                    have, ids = k, self.frame(k)
                low = int(self.id_begins[k])
                to = min(end, int(self.id_begins[k + 1]))
                yield d, ids[at - low:to - low]
                at = to


def write_files(docs: DataFrame, folder: str, tokenizer: str, rule: str, end_id: int, level: int = 1) -> DataFrame:
    """Write one file per range of doc_id; returns (part, path, bytes, n_docs, n_ids), one row per file, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), []
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder = library.encoder(tokenizer, rule)
        files, root = open_folder(folder)
        path = f"{root}/ids-{part:06d}-{TaskContext.get().taskAttemptId()}.zst"

        def write(out) -> None:
            writer = FrameWriter(out, level)
            for batch in _chain(first, batches):
                for step in steps(batch):
                    ids = step.column("doc_id").to_pylist()
                    for doc_id, found_ids in zip(ids, encoder.encode(step.column("text"))):
                        writer.add(doc_id, np.append(found_ids, np.uint32(end_id)))
            writer.close()
            found.append((len(writer.doc_ids), sum(writer.counts)))

        publish(files, path, write)
        size = files.get_file_info(path).size
        (n_docs, n_ids), = found
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path.rpartition("/")[2]], "bytes": [size],
                                          "n_docs": [n_docs], "n_ids": [n_ids]})

    return stored(in_order(docs).mapInArrow(run, "part long, path string, bytes long, n_docs long, n_ids long"),
                  "token-files")


def _chain(first, rest):
    yield first
    yield from rest


def read_digests(files_: DataFrame, folder: str) -> DataFrame:
    """Per document: where its ids begin among all, how many there are, and their crc32, read frame by frame."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row per file
    based = files_.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        for batch in batches:
            for path, size, base in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "base"))):
                with files.open_input_file(f"{root}/{path}") as source:
                    reader = FrameReader(source, size)
                    sums = [0] * len(reader.counts)
                    for d, ids in reader.parts(range(len(sums))):
                        sums[d] = zlib.crc32(ids.tobytes(), sums[d])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(reader.doc_ids, pa.int64(), mask=~reader.present),
                    "start": base + reader.ends - reader.counts, "n_tokens": reader.counts,
                    "ids_crc32": pa.array(sums, pa.int64())})

    return (based.repartition(max(1, files_.count()))
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_digests(docs: DataFrame, tokenizer: str, rule: str = library.WORDS, end_id: int = 1) -> DataFrame:
    """Write the ids of all documents and read them back.

    A null or empty text holds the end id alone; null doc_ids come first and stay null, every other
    one is kept, the least long too; rows that repeat a doc_id are
    documents of their own, in the order of their texts' hashes; an empty table gives no file and no rows; further
    columns are ignored.
    """
    folder = shared_path(docs.sparkSession, "ids")
    return read_digests(write_files(docs, folder, tokenizer, rule, end_id), folder)


@register("op4_token_files")
def op4_token_files(spark, sf_dir):
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
