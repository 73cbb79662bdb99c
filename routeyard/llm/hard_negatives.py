"""Hard negatives of anchors, exact, by candidate lists that the anchors of a cluster share.

Anchors of like direction form clusters of bounded size, rows of like direction form shards of bounded size.  Where a
cluster meets a shard, the shard's rows are sorted once by an upper bound that holds for every member: a row at angle t from
the cluster's centre, of which no member is more than T away, scores at most |row| cos(max(0, t - T)) per unit of a member's
length.  Every member walks that one list, a block of rows at a time, and stops when the bound times its own length falls
below what it still needs: that is its certificate.

Whole shards fall the same way before they are sent: cells, the directions that rows are dealt to, are few, and a cluster
only visits shards of cells whose bound reaches the least score that any member needs.  Shards form parts, ``PARTS`` of them or more
where ``PART_BYTES`` ask for it; a cluster, at most ``MEMBERS`` vectors, is sent once to each part in which it visits a shard, a shard's
vectors are sent once per join.  Both sides are sorted and merged: what the visits of a small table amount to isn't known beforehand.

Three rounds: one shard per cluster gives floors, the fifth best score of the same label; all shards at or above the floors
give the positives; the shards that reach 80 percent of a member's least positive give the negatives.

Centres are fitted on a bounded sample (``SAMPLE`` rows, the first by a hash); they decide the order of work, never a result.
Scores are integers, kept in doubles while 100 of them stay below 2**53, and in Python integers beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeyard.llm.common import register, stored, table

POSITIVES, NEGATIVES, LOW_PERCENT = 5, 5, 80
SHARD_ROWS, MEMBERS, BLOCK = 4096, 256, 128
SAMPLE, MAX_CENTRES, ROUNDS = 4096, 256, 8
PARTS, PART_BYTES = 64, 1 << 25
EXACT = float(2 ** 53) / 100
FOUND = "dims int, anchor_id long, twin long, vec_id long, score long, place int, high long"


def prepared(vectors: DataFrame, scale: int, shift_every: int, labels: int) -> DataFrame:
    """(vec_id, label, dims, v, twin) of the rows that take part; ``twin`` tells rows of one vec_id apart."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < F.lit(float(2 ** 53)), F.floor(c * scale).cast("double"))
                        .otherwise(c * scale))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % shift_every == 0, (label + 1) % labels).otherwise(label)
    return (vectors.filter(good).select("vec_id", moved.alias("label"), F.size("embedding").alias("dims"), whole.alias("v"))
            .withColumn("twin", F.xxhash64("label", "v")))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths of the rows; a zero row stays zero."""
    size = np.sqrt((x * x).sum(axis=1))
    return x / np.where(size > 0, size, 1.0)[:, None], size


def angles(directions: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions @ centre, -1.0, 1.0))


def fitted_centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centres are spread over the sample."""
    x, _ = unit(sample)
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        fresh, size = unit(sums)
        centres = np.where(size[:, None] > 0, fresh, centres)
    return centres


def centres_of(rows: DataFrame, size: int, total: int) -> dict[int, np.ndarray]:
    """Centres per vector length, from a bounded sample; about one for every ``size`` rows."""
    drawn = rows.orderBy(F.xxhash64(F.lit(3), "vec_id", "v"), "vec_id").limit(SAMPLE).select("dims", "v").collect()
    by: dict[int, list] = {}
    for r in drawn:
        by.setdefault(r["dims"], []).append(r["v"])
    out = {}
    for dims, vs in by.items():
        share = max(1, min(MAX_CENTRES, round(total * len(vs) / max(1, len(drawn)) / size)))
        if dims:
            out[dims] = fitted_centres(np.array(vs), share)
    return out


def vectors_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def placed(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """The rows with the cell whose centre is nearest, the angle to it and their length."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            cell, angle, size = np.zeros(len(dims), np.int64), np.zeros(len(dims)), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d:
                    x, size[at] = unit(vectors_of(batch.column("v").take(pa.array(at)), d))
                    if d in centres:
                        cell[at] = (x @ centres[d].T).argmax(axis=1)
                        angle[at] = np.arccos(np.clip((x * centres[d][cell[at]]).sum(axis=1), -1.0, 1.0))
                    else:
                        angle[at] = np.pi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle), pa.array(size)],
                                             names=[*names, "cell", "angle", "size"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, cell long, angle double, size double")


def packed_vectors(v: np.ndarray) -> bytes:
    """Integers in 16 bits where they fit, else as doubles; the length tells which."""
    return (v.astype("<i2") if np.abs(v).max(initial=0) < 1 << 15 else v.astype("<f8")).tobytes()


def unpacked_vectors(raw: bytes, rows: int, dims: int) -> np.ndarray:
    if not rows * dims:
        return np.zeros((rows, dims))
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * rows * dims else "<f8").astype(np.float64).reshape(rows, dims)


def blobs(rows: DataFrame, group: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per group of a bounded number of rows: ids, twins, labels and vectors as bytes, other columns as lists."""
    schema = f"dims int, {group} long, cell long, ids binary, twins binary, labels binary, vectors binary" + "".join(
        f", {c} array<array<bigint>>" for c in carried)

    def pack(part: pa.Table) -> pa.Table:
        part = part.combine_chunks().sort_by([("vec_id", "ascending"), ("twin", "ascending")])
        dims = part.column("dims")[0].as_py()
        v = vectors_of(part.column("v").combine_chunks(), dims)
        out = {"dims": pa.array([dims], pa.int32()), group: pa.array([part.column(group)[0].as_py()], pa.int64()),
               "cell": pa.array([part.column("cell")[0].as_py()], pa.int64())}
        for name, column in (("ids", "vec_id"), ("twins", "twin"), ("labels", "label")):
            out[name] = pa.array([part.column(column).to_numpy().astype("<i8").tobytes()], pa.binary())
        out["vectors"] = pa.array([packed_vectors(v)], pa.binary())
        for c in carried:
            out[c] = pa.array([part.column(c).to_pylist()], pa.list_(pa.list_(pa.int64())))
        return pa.table(out)

    columns = ["dims", group, "cell", "vec_id", "twin", "label", "v", *carried]
    return rows.select(*columns).groupBy("dims", group).applyInArrow(pack, schema)


class Needs:
    """The best rows that one member still wants: all of its own label, or others between two scores."""

    def __init__(self, k: int, low, high=None):
        self.k, self.low, self.high, self.best = k, low, high, []

    def floor(self):
        """Least score that could still matter."""
        return self.best[-1][0] if len(self.best) == self.k else self.low

    def offer(self, found: list[tuple]) -> None:
        self.best = sorted(self.best + found, key=lambda x: (-x[0], x[1]))[:self.k]


def walk(members: np.ndarray, own: np.ndarray, labels: np.ndarray, rows: np.ndarray, ids: np.ndarray, row_labels: np.ndarray,
         needs: list[list[Needs]], same: bool) -> int:
    """Members of a cluster walk the rows of a shard, sorted once by the bound they share; returns the scores computed."""
    large = max(float(np.abs(members).max(initial=0)), 1.0) * max(float(np.abs(rows).max(initial=0)), 1.0)
    exact = large * max(members.shape[1], 1) < EXACT
    directions, length = unit(members)
    centre = unit(directions.sum(axis=0)[None, :])[0][0]
    wide = float(angles(directions, centre).max(initial=0)) if centre.any() else np.pi
    row_directions, row_length = unit(rows)
    near = np.cos(np.maximum(angles(row_directions, centre) - wide - 1e-7, 0.0))
    bound = np.where(near > 0, near, 0.0) * row_length * (1 + 1e-9)
    order = np.argsort(-bound, kind="stable")
    rows, ids, row_labels, bound = rows[order], ids[order], row_labels[order], bound[order]
    active, computed = [i for i in range(len(members)) if needs[i]], 0
    if not exact:
        bound = np.full(len(rows), 1e300)                   # clamped scores follow no bound
    for at in range(0, len(rows), BLOCK):
        reach = bound[at] * length + 1e-6
        # the bound says nothing below 0, so a member that takes any score walks to the end
        active = [i for i in active if any(n.floor() <= max(reach[i], 0.0) for n in needs[i])]
        if not active:
            break
        block = slice(at, at + BLOCK)
        computed += len(active) * len(ids[block])
        if exact:
            scores = members[active] @ rows[block].T
        else:
            whole = [[int(x) for x in r] for r in rows[block].tolist()]
            scores = np.array([[clamped(sum(int(a) * b for a, b in zip(members[i].tolist(), r))) for r in whole] for i in active], object)
        low = [min(n.floor() for n in needs[i]) for i in active]
        high = [np.inf if needs[i][0].high is None else max(n.high for n in needs[i]) for i in active]
        fits = ((row_labels[block][None, :] == labels[active][:, None]) == same) & (ids[block][None, :] != own[active][:, None])
        fits &= (scores >= np.array(low)[:, None]) & (scores <= np.array(high)[:, None])
        for k in np.flatnonzero(fits.any(axis=1)).tolist():
            found = [(int(scores[k, j]), int(ids[at + j])) for j in np.flatnonzero(fits[k]).tolist()]
            for n in needs[active[k]]:
                n.offer([x for x in found if n.floor() <= x[0] and (n.high is None or x[0] <= n.high)])
    return computed


def clamped(score: int) -> int:
    return min(max(score, -(1 << 63)), (1 << 63) - 1)


def visiting(clusters: DataFrame, cells: dict, needed: Callable, first_only: bool = False) -> DataFrame:
    """A row per cluster and part in which it has shards to visit, with the cluster; ``needed`` gives a member's least score."""
    schema = clusters.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                dims, members = row.column("dims")[0].as_py(), member_rows(row)
                directions, length = unit(members)
                centre = unit(directions.sum(axis=0)[None, :])[0][0]
                wide = float(angles(directions, centre).max(initial=0)) if centre.any() else np.pi
                least = np.array([np.inf if x is None else x for x in needed(row)], float)
                reach = []
                for cell, (middle, spread, most, pieces, before, per) in cells.get(dims, {}).items():
                    apart = float(angles(centre[None, :], middle)[0]) if centre.any() and middle.any() else 0.0
                    near = max(np.cos(max(apart - wide - spread - 1e-7, 0.0)), 0.0) * most * (1 + 1e-9)
                    if first_only or (least <= np.maximum(near * length + 1e-6, 0.0)).any():
                        reach.append((-near, cell, range(before, before + pieces), per))
                reach.sort(key=lambda x: x[:2])
                parts: dict[int, list[int]] = {}
                for *_, numbers, per in reach[:1] if first_only else reach:
                    for number in numbers[:1] if first_only else numbers:
                        parts.setdefault(number // per, []).append(number)
                for part, numbers in parts.items():
                    yield pa.RecordBatch.from_arrays(
                        [*row.columns, pa.array([part], pa.int64()), pa.array([numbers], pa.list_(pa.int64()))],
                        names=[*row.schema.names, "part", "numbers"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return clusters.mapInArrow(run, f"{kinds}, part long, numbers array<bigint>")


def member_rows(row: pa.RecordBatch, side: str = "") -> np.ndarray:
    ids, dims = row.column(f"{side}ids")[0].as_py(), row.column("dims")[0].as_py()
    return unpacked_vectors(row.column(f"{side}vectors")[0].as_py(), len(ids) // 8, dims)


def longs(row: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(row.column(name)[0].as_py(), "<i8")


def met(visits: DataFrame, shards: DataFrame, make_needs: Callable, same: bool) -> DataFrame:
    """What the members of visiting clusters find in the shards they visit."""
    sides = shards.select("dims", "part", "number", *[F.col(c).alias(f"s_{c}") for c in ("ids", "labels", "vectors")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                needs = make_needs(row)
                own, twins = longs(row, "ids"), longs(row, "twins")
                walk(member_rows(row), own, longs(row, "labels"), member_rows(row, "s_"), longs(row, "s_ids"),
                     longs(row, "s_labels"), needs, same)
                out = [(int(own[i]), int(twins[i]), found, score, place, n.high)
                       for i, wanted in enumerate(needs) for place, n in enumerate(wanted) for score, found in n.best]
                columns = list(zip(*out)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                dims = pa.array([row.column("dims")[0].as_py()] * len(out), pa.int32())
                yield pa.RecordBatch.from_arrays([dims, *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                                 names=[c.split()[0] for c in FOUND.split(", ")])

    # Spark takes the visits to be as small as the stored clusters and would broadcast them
    pairs = visits.join(sides.hint("merge"), ["dims", "part"]).filter(F.array_contains("numbers", F.col("number")))
    return pairs.mapInArrow(run, FOUND)


def best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best per group, ranked from 1.  Every shard sends k rows per group at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor_every: int = 100, scale: int = 256, shift_every: int = 7, labels: int = 10,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT,
                   shard_rows: int = SHARD_ROWS, members: int = MEMBERS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows of another vector length are no partners.  Rows that repeat an anchor's vec_id are neither its positives nor its
    negatives; of anchors that agree in vec_id, label and vector one is taken, those that differ are anchors each.  Other
    repeated rows are candidates each.  Null ids, labels and vectors and vectors with a null or non-finite component take no
    part; an empty vector scores 0 with other empty ones; a score that a long can't hold counts as the nearest long; an empty
    table gives no rows.
    """
    rows = stored(prepared(vectors, scale, shift_every, labels), "candidates")
    asked = F.col("vec_id") % anchor_every == 0
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("q")).first()
    # rows in cells, cells in pieces of bounded size
    cell_centres = centres_of(rows, shard_rows, total["n"])
    dealt = placed(rows, cell_centres)
    pieces = F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("pieces")
    about = dealt.groupBy("dims", "cell").agg(F.max("angle").alias("spread"), F.max("size").alias("most"), pieces)
    # the shards of a vector length are numbered along its cells; ``per`` of them form a part
    one = Window.partitionBy("dims")
    held = F.greatest(F.lit(1), F.floor(F.lit(PART_BYTES) / (F.lit(8 * shard_rows) * F.greatest("dims", F.lit(1)))))
    about = stored(about.withColumn("before", F.sum("pieces").over(one.orderBy("cell")) - F.col("pieces")).withColumn(
        "per", F.least(F.ceil(F.sum("pieces").over(one) / F.lit(PARTS)), held)), "cells")
    cells: dict[int, dict] = {}
    for r in about.collect():               # MAX_CENTRES cells at most per vector length of the sample, one per other length
        c = cell_centres.get(r["dims"])
        cells.setdefault(r["dims"], {})[r["cell"]] = (
            np.zeros(r["dims"]) if c is None else c[r["cell"]], r["spread"], r["most"], r["pieces"], r["before"], r["per"])
    numbered = dealt.join(about.select("dims", "cell", "pieces", "before", "per"), ["dims", "cell"]).withColumn(
        "shard", F.col("before") + F.pmod(F.xxhash64("vec_id", "twin"), F.col("pieces")))
    shards = blobs(numbered.withColumn("cell", F.floor(F.col("shard") / F.col("per"))), "shard")
    shards = stored(shards.withColumnsRenamed({"shard": "number", "cell": "part"}), "shards")

    # anchors in clusters of like direction and bounded size
    anchors = rows.filter(asked).dropDuplicates(["vec_id", "twin"])
    anchors = placed(anchors, centres_of(rows.filter(asked), members, total["q"]))
    sizes = anchors.groupBy("dims", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(members)).cast("int").alias("pieces"))
    anchors = stored(anchors.join(sizes, ["dims", "cell"]).withColumn("cluster", F.xxhash64(
        "dims", "cell", F.pmod(F.xxhash64("vec_id", "twin"), F.col("pieces")))).drop("pieces", "angle", "size"), "anchors")
    none = lambda row: [-np.inf] * (len(row.column("ids")[0].as_py()) // 8)
    firsts = visiting(blobs(anchors, "cluster"), cells, none, first_only=True)
    floors = best(met(firsts, shards, lambda row: [[Needs(positives, x)] for x in none(row)], True),
                  ["anchor_id", "twin", "dims"], positives)
    floors = floors.filter(F.col("rank") == positives).select(F.col("anchor_id").alias("vec_id"), "twin", "dims",
                                                              F.array("score").alias("floors"))
    key = ["vec_id", "twin", "dims"]
    with_floors = anchors.join(floors, key, "left").withColumn("floors", F.coalesce("floors", F.expr("array(cast(null as bigint))")))
    clusters = stored(blobs(with_floors, "cluster", ("floors",)), "clusters")
    # beyond this size scores may be clamped and follow no bound
    least = lambda row: [-np.inf if f[0] is None or abs(f[0]) >= EXACT else f[0] for f in row.column("floors")[0].as_py()]
    found = met(visiting(clusters, cells, least), shards, lambda row: [[Needs(positives, x)] for x in least(row)], True)
    chosen = stored(best(found, ["anchor_id", "twin", "dims"], positives), "positives")

    listed = F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score")))
    per_anchor = chosen.groupBy(F.col("anchor_id").alias("vec_id"), "twin", "dims").agg(listed.alias("p")).select(
        *key, F.transform("p", lambda p: p["score"]).alias("scores"))
    clusters = stored(blobs(anchors.join(per_anchor.hint("merge"), key), "cluster", ("scores",)), "clusters")
    # 80 p <= 100 n is n >= ceil(80 p / 100); a score that isn't positive leaves at most n = p = 0
    low = lambda p: -(-low_percent * p // 100)
    wanted = lambda row: [[(low(p), p) for p in ps] for ps in row.column("scores")[0].as_py()]
    lowest = lambda row: [min((-np.inf if abs(b) >= EXACT else a for a, b in w if a <= b), default=None) for w in wanted(row)]
    # an impossible range keeps its place in the list
    make = lambda row: [[Needs(negatives, a if a <= b else np.inf, b) for a, b in w] for w in wanted(row)]
    kept = met(visiting(clusters, cells, lowest), shards, make, False)
    ranked = best(kept, ["anchor_id", "twin", "dims", "place"], negatives)
    partner = chosen.select("anchor_id", "twin", "dims", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"))
    return ranked.join(partner, ["anchor_id", "twin", "dims", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("high").alias("positive_score"),
        F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@register("op13_hard_negatives", ORACLE)
def op13_hard_negatives(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))
