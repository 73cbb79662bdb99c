"""Periodic runs of words, found by window minima at many scales.

A run is a maximal stretch of words in which words ``q`` apart are identical, q being its smallest period, at least
``max(LEAST, EXPONENT * q)`` words long.

*Short periods* (below ``SHORT``) are scanned directly: every lag is compared with the text as a whole.

*Longer ones* lie in one of the scales w = SHORT, 2 SHORT, ... with w <= q < 2w.  Every window of w consecutive places
marks the place whose w words hash lowest, the leftmost of equal ones.  Inside a run windows q apart see the same words, so
the marks repeat q apart with the same hash.  A mark is paired with the ``NEAR`` nearest equal marks at least w behind it,
and a pair less than 2w apart seeds an extension of its lag in both directions, word by word.

Four partners suffice.  Take the lowest hash of a run's period and its first place within a stretch that overlaps copies of
itself.  An equal place between w and q behind it lies in the same stretch, of which at most one does, since a stretch
of smaller period b is shorter than q + b; or it overlaps the copy at q by nearly w, which leaves room for two more.  A run has
four periods or more, so that place, its window and their copies fit into it.

All texts of a step are handled as one array, with a separator of its own behind every text; a match across a separator is
always shorter than three periods.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeyard.llm import pieces, shingles
from routeyard.llm.common import register, steps, table, utf8
from routeyard.llm.quality import let, words_of

EXPONENT, LEAST = 4, 6
SHORT, NEAR = 16, 4
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def least_length(q):
    return np.maximum(LEAST, EXPONENT * q)


def short_runs(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(starts, lengths, period) of all stretches with a period below ``SHORT``."""
    out = []
    for q in range(1, min(SHORT, len(x))):
        edge = np.diff(np.concatenate([[False], x[:-q] == x[q:], [False]]).view(np.int8))
        starts = np.flatnonzero(edge == 1)
        lengths = np.flatnonzero(edge == -1) - starts + q
        long = lengths >= least_length(q)
        if long.any():
            out.append((starts[long], lengths[long], q))
    return out


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Leftmost places of the least of any w consecutive values, w a power of two."""
    place, k = np.arange(len(values)), 1
    while k < w:
        take = values[k:] < values[:-k]
        values = np.where(take, values[k:], values[:-k])
        place = np.where(take, place[k:], place[:-k])
        k *= 2
    return place[np.flatnonzero(np.diff(place, prepend=-1))]


def equal_pairs(values: np.ndarray, marks: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks and lags to their nearest equal marks between w and 2w behind them, by lag, then place."""
    order = np.argsort(values[marks], kind="stable")
    place, value = marks[order], values[marks][order]
    group = np.cumsum(np.diff(value, prepend=value[:1]) != 0)
    span = len(values) + 2 * w
    key = group * span + place
    first = np.searchsorted(key, key + w)
    found = []
    for k in range(NEAR):
        other = np.minimum(first + k, len(key) - 1)
        good = np.flatnonzero((first + k < len(key)) & (group[other] == group) & (place[other] - place < 2 * w)
                              & (place[other] - place >= w))
        found.append((place[good], place[other[good]] - place[good]))
    at, lag = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((at, lag))
    return at[order], lag[order]


def extended(x: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """Start and length of the maximal stretch of period q around a place that agrees with the one q behind it."""
    high, size = at, 64
    while high < len(x) - q:
        to = min(high + size, len(x) - q)
        other = np.flatnonzero(x[high:to] != x[high + q:to + q])
        if len(other):
            high += int(other[0])
            break
        high, size = to, size * 2
    low, size = at, 64
    while low > 0:
        to = max(low - size, 0)
        other = np.flatnonzero(x[to:low] != x[to + q:low + q])
        if len(other):
            low = to + int(other[-1]) + 1
            break
        low, size = to, size * 2
    return low, high - low + q


def long_runs(x: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(starts, lengths, period) of the stretches that pairs of equal minima seed; ``sizes`` are the texts' words."""
    out, w = [], SHORT
    behind = np.repeat(sizes, sizes + 1)                    # words of the text that a place belongs to
    while (fits := behind >= EXPONENT * w).any():
        at = np.flatnonzero(fits)
        part = x[at]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * pieces.powers(len(part)))])
        grams = pieces.mix((sums[w:] - sums[:-w]) * pieces.inverse_powers(len(part))[:len(part) - w + 1])
        places, lags = equal_pairs(grams, window_minima(grams, w), w)
        end, period = -1, -1                                # what the last extension has covered
        for a, q in zip(places.tolist(), lags.tolist()):
            if q == period and a < end:
                continue
            start, length = extended(part, a, q)
            end, period = start + length - q, q
            if length >= least_length(q):
                out.append((at[start:start + 1], np.array([length]), q))
        w *= 2
    return out


def runs_of(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period, starts counted from the text's first word."""
    found = short_runs(x) + long_runs(x, sizes)
    if not found:
        return np.zeros((0, 4), np.int64)
    start, length = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    period = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a multiple of the smallest period has the same stretch
    first = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(length) != 0)])
    start, length, period = start[first], length[first], period[first]
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.searchsorted(begins, start, side="right") - 1
    order = np.lexsort((period, start))
    return np.stack([text, start - begins[text], length, period], axis=1)[order]


def word_array(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text followed by a separator of its own; and how many words each has."""
    if len(data):
        starts, ends, first = shingles.word_spans(data, bounds, shingles.NOT_BLANK)
        words = pieces.span_hashes(data, starts, ends)
    else:
        words, first = np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    sizes = np.diff(first)
    marks = pieces.mix(np.arange(len(sizes), dtype=np.uint64) + np.uint64(0x5EA1 << 40))
    return np.insert(words, first[1:], marks), sizes


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: all runs by start and period, and the text without their repeats.

    ``collapsed`` joins by one space the words that no run contains behind its first period.  A null or empty text has no
    words, no runs and an empty ``collapsed``.  Repeated rows and null ids are handled row by row; an empty table gives
    no rows; further columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                data, bounds = utf8(part.column("text"))
                raw = data.tobytes()
                x, sizes = word_array(data, bounds)
                rows = runs_of(x, sizes)
                cut = np.searchsorted(rows[:, 0], np.arange(part.num_rows + 1))
                texts, lists = [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    words = raw[a:b].split()
                    own = rows[cut[i]:cut[i + 1], 1:].tolist()
                    if own:
                        keep = np.ones(len(words), bool)
                        for start, length, period in own:
                            keep[start + period:start + length] = False
                        words = [words[k] for k in np.flatnonzero(keep).tolist()]
                    texts.append(b" ".join(words))
                    lists.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_words": pa.array(sizes, pa.int64()),
                    "runs": pa.array(lists, kind), "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a period put into the texts that a hash of doc_id names; a null doc_id leaves its text alone."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(ws):
        n = F.size(ws).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (g % 8 + 3)) + 1

        def of(start_and_period):
            s, q = start_and_period["a"], start_and_period["p"]
            place = lambda i: F.when(i < s, i).otherwise(s + (i - s) % q).cast("int")
            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, place(i))), " ")

        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), of)).otherwise(F.lit(""))

    return docs.select("doc_id", F.when(h % 10 == 0, let(words_of(F.col("text")), repeated)).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run and hashes of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.withColumn("best", longest)
    length, period = -F.col("best.less"), F.col("best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


ORACLE = r"""
WITH h AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                  CRC AS h FROM documents),
p AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, (h // 10) % greatest(len(ws), 1) AS a,
             (h // 10) % 8 + 3 AS parts FROM h),
d AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n),
             lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END + 1]) ELSE ws END AS ws FROM p),
w AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(0, n)) AS i FROM d),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i
      AND 4 * (y.i - x.i) <= x.n),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, island
      HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN o USING (doc_id, i) GROUP BY w.doc_id),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min(row(start, length, period), row(-length, start, period)) AS best,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
      FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length,
       best[3]::BIGINT AS period, (1000 * best[2] // best[3])::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def crc_sql(text: str) -> str:
    """CRC-32 of a short ASCII text in DuckDB, a byte and a bit at a time."""
    step = "list_reduce([c::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    byte = step.replace("c::BIGINT", "xor(c, b)")
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), "
            f"lambda c, b: {byte}), 4294967295)")


@register("op12_periodic_runs", ORACLE.replace("CRC", crc_sql("doc_id::VARCHAR")))
def op12_periodic_runs(spark, sf_dir):
    return digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))
