"""Quoted CSV and TSV whose values hold line breaks, many tasks per file.

A line starts a record exactly if the quotes before it in its file are even in
number.  One scan counts the quotes of every piece of a file; with the sums of
the pieces before, each piece finds its own records as it is read, and only
what a piece's border cuts is shuffled and joined across pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ("__file", "__piece", "__record")
# files that Spark reads in one piece
UNCUT = r"\.(deflate|gz|lz4|snappy|zst)$"

FOUND = "__file string, __piece long, __record long, open boolean, head boolean, blank boolean, text string"


def _lines(spark: SparkSession, path: str, uncut: bool) -> DataFrame:
    compressed = F.col("_metadata.file_path").rlike(UNCUT)
    text = spark.read.option("lineSep", "\n").text(path).filter(compressed if uncut else ~compressed)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return text.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__piece"),
                       quotes.alias("__quotes"), "value")


def _joined(parts: str) -> F.Column:
    """Texts of (order, text) pairs as one, in order, with the line breaks that stood between them."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "\n")


class _Piece:
    """The records of one piece, whose lines come in order; the last record waits for more lines."""

    def __init__(self, file: str, piece: int, before: int):
        self.file, self.piece, self.odd = file, piece, before % 2
        self.record, self.waiting, self.headed = 0, [], piece != 0

    def rows(self, values: pa.Array, records: np.ndarray, odd: np.ndarray) -> pa.RecordBatch:
        """Lines whose records end with them, one row per record."""
        first = np.flatnonzero(np.diff(records, prepend=-1))
        cuts = pa.array(np.append(first, len(records)), pa.int64())
        text = pc.binary_join(pa.LargeListArray.from_arrays(cuts, values), pa.scalar("\n", pa.large_string()))
        blank = pc.equal(pc.utf8_trim(text, " \r\n"), "").to_numpy(zero_copy_only=False)
        head = np.zeros(len(first), bool)
        if not self.headed and not blank.all():
            head[blank.argmin()] = self.headed = True
        last = np.append(first[1:], len(records)) - 1
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file] * len(first), pa.string()), pa.array([self.piece] * len(first), pa.int64()), pa.array(records[first]),
             pa.array(odd[last]), pa.array(head), pa.array(blank), text.cast(pa.string())],
            names=["__file", "__piece", "__record", "open", "head", "blank", "text"])

    def add(self, values: pa.Array, quotes: np.ndarray) -> Iterator[pa.RecordBatch]:
        after = (self.odd + np.cumsum(quotes)) % 2
        records = self.record + np.cumsum(np.append(self.odd, after[:-1]) == 0)
        new = np.flatnonzero(np.diff(records, prepend=self.record))
        if len(new):
            done, last = int(new[0]), int(new[-1])
            before = self.ended(values[:done], after[:done])
            if before is not None:
                yield before
            if last > done:
                yield self.rows(values[done:last], records[done:last], after[done:last] == 1)
            values, after = values[last:], after[last:]
        if len(values):
            self.waiting.append(values)
            self.odd, self.record = int(after[-1]), int(records[-1])

    def ended(self, values: pa.Array | None = None, after: np.ndarray = np.zeros(0, np.int64)) -> pa.RecordBatch | None:
        """The waiting record with its last lines."""
        parts = self.waiting + ([values] if values is not None and len(values) else [])
        self.waiting = []
        if not parts:
            return None
        odd = bool(after[-1]) if len(after) else self.odd == 1
        lines = pa.concat_arrays(parts)
        return self.rows(lines, np.full(len(lines), self.record), np.full(len(lines), odd))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__file, __piece, __before, __quotes, value) in the order of a scan as the columns of ``FOUND``."""
    piece = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts, before, quotes, values = (batch.column(i) for i in range(5))
        files = files.dictionary_encode()
        at, begins = files.indices.to_numpy(), starts.to_numpy()
        cuts = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(begins, prepend=-1) != 0))
        values = values.cast(pa.large_string())
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
            name = files.dictionary[int(at[a])].as_py()
            if piece is None or (piece.file, piece.piece) != (name, int(begins[a])):
                if piece is not None and (last := piece.ended()) is not None:
                    yield last
                piece = _Piece(name, int(begins[a]), before[a].as_py())
            yield from piece.add(values[a:b], quotes[a:b].to_numpy())
    if piece is not None and (last := piece.ended()) is not None:
        yield last


def records(spark: SparkSession, path: str) -> DataFrame:
    """(__file, __piece, __record, head, text): every record that isn't blank, where it begins, and if it is its file's first.

    Quotes stand around whole values and are doubled inside them.  A record
    may span any number of pieces; a quote that never closes takes the rest of
    its file.  A line break at the very end of a record is not part of it.
    Compressed files come in one piece, whose records need no other: they are
    scanned once.
    """
    alone = _lines(spark, path, True).select("__file", "__piece", F.lit(0).cast("bigint").alias("__before"), "__quotes", "value")
    alone = alone.mapInArrow(_found, FOUND).filter(~F.col("blank")).select(*PLACE, "head", "text")

    lines = _lines(spark, path, False)
    before = Window.partitionBy("__file").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("__file", "__piece").agg(F.sum("__quotes").alias("n")).select(
        "__file", "__piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))     # a row per piece

    # a row per piece is broadcast, so the lines stay in the order of the scan; record 0 belongs to the last record of the pieces before
    seen = lines.join(F.broadcast(counts), ["__file", "__piece"])
    found = seen.select("__file", "__piece", "__before", "__quotes", "value").mapInArrow(_found, FOUND)

    torn = (F.col("__record") == 0) | F.col("open")
    across = Window.partitionBy("__file").orderBy("__piece", "__record").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.max(F.when(F.col("__record") > 0, F.struct("__piece", "__record"))).over(across)
    # at most two fragments per piece meet here
    mended = (found.filter(torn).withColumn("owner", owner).groupBy("__file", "owner").agg(
        F.collect_list(F.struct(F.struct("__piece", "__record").alias("at"), "text")).alias("parts"), F.max("head").alias("head"))
        .select("__file", "owner.__piece", "owner.__record", "head", _joined("parts").alias("text")))
    blank = F.trim(F.regexp_replace("text", r"[\r\n]", "")) == ""
    whole = found.filter(~torn & ~F.col("blank")).select(*PLACE, "head", "text")
    return whole.unionByName(mended.filter(~blank)).unionByName(alone).withColumn("text", F.regexp_replace("text", r"\r$", ""))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_quoted(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """Tables with a header in every file; columns in order of ``schema``, else texts named by the first file's header.

    The columns of ``PLACE`` come first; they order the rows of a file.
    """
    if schema is None:
        names = spark.read.options(header=True, escape='"', multiLine=True, sep=sep).csv(path).columns
        schema = ", ".join(f"{_quoted(n)} string" for n in names)
    value = F.from_csv("text", schema, {"sep": sep, "quote": '"', "escape": '"'})
    return records(spark, path).filter(~F.col("head")).select(*PLACE, value.alias("r")).select(*PLACE, "r.*")
