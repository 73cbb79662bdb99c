"""Toxicity by a linear classifier whose scores may not hang on identity terms.

Features are the words of a text and their first 4 to 7 bytes, hashed; a text has each or hasn't.  From a bounded sample
of labelled rows (``positives`` toxic and ``negatives`` other ones, the first by a hash of doc_id) the features that tell
the classes apart are selected, and a logistic regression is fitted with weights that restore the classes' shares.

The counterfactual part: every sentence of the sample that names a group (women, Muslims, ...) is taken again with the
term swapped for another of its list, and the squared difference of the two scores is added to the loss.  A group's name
thus can't carry weight that another group's name doesn't, whatever the labelled rows associate with it.

Scoring reads every text once and sends nothing but the few thousand weights to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeyard.llm import pieces, shingles
from routeyard.llm.common import free_name, register, steps, table, utf8

POSITIVES, NEGATIVES = 4000, 8000
BUCKETS = 1 << 22
PREFIXES = (4, 5, 6, 7)
FEATURES, MIN_GAIN = 2000, 20.0
PENALTY, FAIRNESS, ROUNDS = 1e-4, 1.0, 300
THRESHOLD = 0.3
# Text scored at once, and sampled rows looked up at once: arrays of such a step are a few dozen times as large.
STEP_BYTES, STEP_ROWS = 1 << 17, 256
#: Terms that swap with each other, by list.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mujeres", "hombres"), ("femmes", "hommes"),
    ("frauen", "männer"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"), ("musulmanes", "cristianos", "judíos"),
    ("musulmans", "chrétiens", "juifs"), ("muslime", "christen", "juden"),
)
ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin letters À to Þ."""
    out = shingles.LOWER[data]
    lead = np.concatenate([[False], data[:-1] == 0xC3])
    capital = lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[capital] += 0x20
    return out


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Hashed features of all texts and the text each belongs to, repeated ones included; and the words' spans."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), (np.zeros(0, np.int64),) * 2
    starts, ends, first = shingles.word_spans(data, bounds, shingles.ALNUM)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    found, docs = [pieces.span_hashes(data, starts, ends)], [doc]
    for n in PREFIXES:
        long = ends - starts >= n
        found.append(pieces.span_hashes(data, starts[long], starts[long] + n) ^ np.uint64(n))
        docs.append(doc[long])
    return ((np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(docs), (starts, ends))


def swaps(text: bytes, terms: dict[bytes, bytes], spans: tuple) -> Iterator[tuple[bytes, bytes]]:
    """Sentences with an identity term, as they are and with all terms swapped."""
    places = [(a, b) for a, b in zip(*(s.tolist() for s in spans)) if text[a:b] in terms]
    if not places:
        return
    ends = [0, *(np.flatnonzero(ENDS[np.frombuffer(text, np.uint8)]) + 1).tolist(), len(text)]
    for low, high in zip(ends, ends[1:]):
        inside = [(a, b) for a, b in places if low <= a < high]
        if inside:
            out, at = [], low
            for a, b in inside:
                out += [text[at:a], terms[text[a:b]]]
                at = b
            yield text[low:high], b"".join([*out, text[at:high]])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample_of(labels: DataFrame, label: str, positives: int, negatives: int) -> tuple[DataFrame, tuple[int, int]]:
    """At most so many labelled rows that aren't held out, each with its class's weight; and the classes' sizes."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y")))
    sizes = known.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
             for y, n in ((1, positives), (0, negatives))]
    return parts[0].union(parts[1]), (sizes["p"], sizes["n"])


def sample_features(docs: DataFrame, sample: DataFrame) -> list:
    """The sample's rows: label, distinct features, and features of the swapped sentences (bounded by the sample)."""
    terms = {one.encode(): other.encode() for group in IDENTITY_TERMS
             for one, other in zip(group, (*group[1:], group[0]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, _ = utf8(batch.column("text").slice(i, 1))
                data = lowered(data)
                found, _, spans = features(data, np.array([0, len(data)]))
                rows = [(batch.column("y")[i].as_py(), 0, np.unique(found))]
                for pair in swaps(data.tobytes(), terms, spans):
                    for sign, side in zip((1, -1), pair):
                        raw = np.frombuffer(side, np.uint8)
                        rows.append((None, sign, np.unique(features(raw, np.array([0, len(raw)]))[0])))
                yield pa.RecordBatch.from_pydict({
                    "y": pa.array([r[0] for r in rows], pa.int32()), "sign": pa.array([r[1] for r in rows], pa.int32()),
                    "found": pa.array([r[2].astype("<i4").tobytes() for r in rows], pa.binary())})

    # one row per sampled id, whatever its copies: of several texts the least
    joined = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id")
              .agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y"))
    return joined.mapInArrow(run, "y int, sign int, found binary").collect()


def gains(y: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that a toxic row has, and twice the log-likelihood ratio of each one's presence and the label."""
    on = [np.zeros(BUCKETS, np.int32) for _ in (0, 1)]
    for label, found in zip(y, rows):
        on[label][found] += 1
    at = np.flatnonzero(on[1])
    on = [x[at].astype(np.float64) for x in on]
    sizes, total = [(y == k).sum() for k in (0, 1)], len(y)
    out = np.zeros(len(at))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in (0, 1):
            for cell, side in ((on[k], on[0] + on[1]), (sizes[k] - on[k], total - on[0] - on[1])):
                out += np.where(cell > 0, 2 * cell * np.log(cell * total / (side * sizes[k])), 0)
    return at, out


class Lookup:
    """Finds the chosen features, which are sorted, among others."""

    def __init__(self, chosen: np.ndarray):
        self.chosen, self.wanted = chosen, np.zeros(BUCKETS, bool)
        self.wanted[chosen] = True

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chosen features stand, and the place of each among the chosen ones."""
        here = np.flatnonzero(self.wanted[found])
        return here, np.searchsorted(self.chosen, found[here])


class Presence:
    """Which of the chosen features each row has, as index pairs; products with it take time per present feature."""

    def __init__(self, rows: list[np.ndarray], chosen: np.ndarray):
        lookup, pairs = Lookup(chosen), [(np.zeros(0, np.int32),) * 2]
        for low in range(0, len(rows), STEP_ROWS):
            some = rows[low:low + STEP_ROWS]
            here, column = lookup.find(np.concatenate(some))
            row = np.searchsorted(np.cumsum([len(r) for r in some]), here, side="right") + low
            pairs.append((row.astype(np.int32), column.astype(np.int32)))
        self.row, self.column = (np.concatenate(side) for side in zip(*pairs))
        self.shape = (len(rows), len(chosen))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], minlength=self.shape[0])

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, r[self.row], minlength=self.shape[1])


def fit(y: np.ndarray, rows: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], shares: tuple[int, int],
        fairness: float = FAIRNESS) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen buckets, their weights and the bias: accelerated gradient steps on the regularised loss."""
    at, gain = gains(y, rows)
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    chosen = np.sort(at[best[gain[best] >= MIN_GAIN]])
    x = Presence(rows, chosen)
    one, other = (Presence([p[i] for p in pairs], chosen) for i in (0, 1))
    weight = np.where(y == 1, shares[0] / max(1, (y == 1).sum()), shares[1] / max(1, (y == 0).sum()))
    weight = weight / weight.sum()

    def swapped(w: np.ndarray) -> np.ndarray:
        """Slope of the mean squared difference between sentences and their swapped copies, halved."""
        d = one.times(w) - other.times(w)
        return (one.transposed(d) - other.transposed(d)) * (fairness / max(1, len(pairs)))

    def curvature(v: np.ndarray) -> np.ndarray:
        r = weight * (x.times(v[:-1]) + v[-1]) / 4
        return np.append(x.transposed(r) + PENALTY * v[:-1] + 2 * swapped(v[:-1]), r.sum())

    v = np.ones(len(chosen) + 1)
    for _ in range(20):                 # power iterations: the largest curvature bounds the step
        v = curvature(v)
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (1.1 * size)
    w = before = np.zeros(len(chosen) + 1)
    for t in range(1, ROUNDS + 1):
        look = w + (t - 1) / (t + 2) * (w - before)
        r = weight * (1 / (1 + np.exp(-np.clip(x.times(look[:-1]) + look[-1], -30, 30))) - y)
        slope = np.append(x.transposed(r) + PENALTY * look[:-1] + 2 * swapped(look[:-1]), r.sum())
        before, w = w, look - step * slope
    return chosen, w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES,
          negatives: int = NEGATIVES, fairness: float = FAIRNESS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from the labelled rows that aren't held out.  Without labels of both classes every score is 0."""
    sample, shares = sample_of(labels, label, positives, negatives)
    if min(shares) == 0:
        return np.zeros(0, np.int64), np.zeros(0), -np.inf
    found = sample_features(docs, sample)
    plain = [(r["y"], np.frombuffer(r["found"], "<i4")) for r in found if r["sign"] == 0]
    sides = [np.frombuffer(r["found"], "<i4") for r in found if r["sign"] != 0]
    y = np.array([a for a, _ in plain], np.int64)
    if len(set(y.tolist())) < 2:
        return np.zeros(0, np.int64), np.zeros(0), -np.inf
    return fit(y, [b for _, b in plain], list(zip(sides[::2], sides[1::2])), shares, fairness)


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str) -> DataFrame:
    """All columns, whatever their names, and the score in a further column ``name``.

    A null or empty text gets the score of a text without features.
    """
    chosen, weights, bias = model
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(chosen)
        for batch in batches:
            for part in steps(batch, text, STEP_BYTES):
                data, bounds = utf8(part.column(text))
                found, doc, _ = features(lowered(data), bounds)
                here, at = lookup.find(found)
                key = np.unique(doc[here] * max(1, len(chosen)) + at)
                z = np.bincount(key // max(1, len(chosen)), weights[key % max(1, len(chosen))] if len(chosen) else None,
                                minlength=part.num_rows) + bias
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-z))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())],
                                                 names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """All columns with score and predicted, which replace columns of these names."""
    name = free_name(docs, "toxicity")
    out = scored(docs.drop("score", "predicted"), model, name)
    return out.withColumn("score", F.col(name)).withColumn("predicted", (F.col(name) >= threshold).cast("int")).drop(name)


def not_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, all columns unchanged; each of repeated rows is judged like the others."""
    name = free_name(docs, "toxicity")
    return scored(docs, model, name).filter(F.col(name) < threshold).drop(name)


@register("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
