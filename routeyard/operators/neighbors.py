"""Exact and approximate nearest neighbours and the policies built on them.

Training vectors are assigned to the nearest of about sqrt(n) pivots, ``MAX_PIVOTS`` at most.  The pivots form groups of like
place, so a query first meets groups, then the pivots of the groups that can matter, a tile of fixed size at a time.  The
triangle inequality tells which cells can hold one of a query's ``k`` nearest neighbours, and no pair outside them is
ever formed.  Neighbouring cells are dealt to ``SPLITS`` parts, more only where a part would exceed ``PART_BYTES``; a query is
sent once to every part that has a cell it visits, however many cells those are, and the visitors of a part in as many waves.
So rows travel a fixed number of times.  Where a part meets a wave, the cells are met one by one and every query keeps its
``k`` best.  Nothing is dropped: ``nearest`` equals the brute-force answer, ``nearest_approximate`` visits the nearest cells
only.  No task holds more than the pivots, a part and a wave.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeyard.functions import vectors as X
from routeyard.functions.scores import hash_bucket
from routeyard.operators.labels import argmax
from routeyard.runtime import persisted

DIGITS = 9          # distances are compared at this precision, ties by id
SLACK = 1e-6        # room for rounding in the pruning bounds
SLACK_DIGITS = 2 * 10.0 ** -DIGITS      # room for what is equal once rounded
BLOCK_ROWS = 2048   # rows that are worth a part or wave of their own
SPLITS = 6          # parts, and waves of a part's visitors, unless they grow too large
PART_BYTES = 1 << 26
MAX_PIVOTS = 1 << 14
TILE_ROWS = 512     # queries that meet a group of pivots at once
CHUNK_ROWS = 1024   # queries that meet a cell at once


def _metric_space(df: DataFrame, id_col: str, vec: str, metric: str, side: int) -> DataFrame:
    """Points whose Euclidean distance orders like the wanted metric.

    For the cosine distance that is the unit vector.  A zero vector has cosine
    0 with everything, which two extra components (one per side) express.
    """
    v = X.as_double(F.col(vec))
    if metric == "cosine":
        zero = X.norm(v) == 0
        extra = [F.when(zero, F.lit(1.0)).otherwise(F.lit(0.0)) if i == side else F.lit(0.0) for i in (0, 1)]
        v = F.concat(X.l2_normalize(v), F.array(*extra))
    elif metric != "euclidean":
        raise ValueError(f"unknown metric: {metric}")
    return df.select(F.col(id_col).alias("id"), v.alias("v"))


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (m * m).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (m @ pivots.T)
    return np.sqrt(np.maximum(sq, 0.0))


class Pivots:
    """Pivots in groups around every so many of them, searched group by group."""

    def __init__(self, points: np.ndarray):
        heads = points[:max(1, math.isqrt(len(points)))]
        group = np.concatenate([_distances(points[i:i + TILE_ROWS], heads).argmin(axis=1) for i in range(0, len(points), TILE_ROWS)])
        self.points, self.heads = points, heads
        self.members = [np.flatnonzero(group == g) for g in range(len(heads))]
        self.reach = np.array([_distances(points[i], heads[[g]]).max(initial=0.0) for g, i in enumerate(self.members)])

    def nearest(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of every row, and the distance; of equal ones the first."""
        best, cell = np.full(len(m), np.inf), np.zeros(len(m), np.int64)
        for at in range(0, len(m), TILE_ROWS):
            rows, low = m[at:at + TILE_ROWS], best[at:at + TILE_ROWS]
            to_heads = _distances(rows, self.heads)
            for g in np.argsort(to_heads.min(axis=0), kind="stable").tolist():
                some = np.flatnonzero(to_heads[:, g] - self.reach[g] <= low + SLACK)
                if len(some) and len(self.members[g]):
                    d = _distances(rows[some], self.points[self.members[g]])
                    k = d.argmin(axis=1)
                    value, found = d[np.arange(len(some)), k], self.members[g][k]
                    here = at + some
                    better = (value < best[here]) | ((value == best[here]) & (found < cell[here]))
                    best[here[better]], cell[here[better]] = value[better], found[better]
        return cell, best

    def limits(self, rows: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Bounds of the k-th neighbour's distance; ``near`` has per cell its members' least distances to the pivot, infinity for none.

        The bound is the k-th least of (distance to a pivot + a member's distance to it).
        """
        k, to_heads = near.shape[1], _distances(rows, self.heads)
        bound = np.full((len(rows), k), np.inf)
        for g in np.argsort(to_heads.min(axis=0), kind="stable").tolist():
            some = np.flatnonzero(to_heads[:, g] - self.reach[g] <= bound[:, -1])
            if len(some) and len(self.members[g]):
                d = _distances(rows[some], self.points[self.members[g]])
                upper = (d[:, :, None] + near[self.members[g]][None, :, :]).reshape(len(some), -1)
                bound[some] = np.sort(np.partition(np.concatenate([bound[some], upper], axis=1), k - 1, axis=1)[:, :k], axis=1)
        return bound[:, -1] + SLACK

    def within(self, rows: np.ndarray, limit: np.ndarray, radius: np.ndarray):
        """Per group of pivots the rows that may reach it, their distances to its pivots and which cells they visit: those whose
        pivot is no farther than the limit beyond the cell's radius."""
        to_heads = _distances(rows, self.heads)
        for g, members in enumerate(self.members):
            some = np.flatnonzero(to_heads[:, g] - self.reach[g] - radius[members].max(initial=-np.inf) <= limit)
            if len(some) and len(members):
                d = _distances(rows[some], self.points[members])
                yield some, members, d, d - radius[members][None, :] <= limit[some][:, None]

    def visits(self, m: np.ndarray, radius: np.ndarray, near: np.ndarray, probes: int | None) -> list[np.ndarray]:
        """Per row the cells to visit, with ``probes`` only so many of the nearest."""
        out = []
        for at in range(0, len(m), TILE_ROWS):
            rows = m[at:at + TILE_ROWS]
            found = [[] for _ in rows]
            for some, members, d, keep in self.within(rows, self.limits(rows, near), radius):
                for r, line, far in zip(some.tolist(), keep, d):
                    found[r].append(np.stack([far[line], members[line]]))
            for parts in found:
                cells = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0))
                cells = cells[:, np.lexsort((cells[1], cells[0]))][:, :probes]
                out.append(np.sort(cells[1]).astype("int32"))
        return out

    def visited_parts(self, m: np.ndarray, radius: np.ndarray, near: np.ndarray, lies_in: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per row its limit and the parts it visits; ``lies_in`` tells of every cell in which parts its rows are."""
        limits, out = [], []
        for at in range(0, len(m), TILE_ROWS):
            rows = m[at:at + TILE_ROWS]
            limits.append(self.limits(rows, near))
            met = np.zeros((len(rows), lies_in.shape[1]), np.int32)
            for some, members, _, keep in self.within(rows, limits[-1], radius):
                met[some] += keep.astype(np.int32) @ lies_in[members].astype(np.int32)
            out += [np.flatnonzero(line).astype("int32") for line in met]
        return np.concatenate([np.zeros(0), *limits]), out


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy())


def _prepared(queries: DataFrame, train: DataFrame, k: int, metric: str, id_col: str, vec: str):
    """Training points in cells, queries, the pivots and per cell its rows, radius and least distances; None without points."""
    q = _metric_space(queries, id_col, vec, metric, 0)
    t = _metric_space(train, id_col, vec, metric, 1)
    # Of equal vectors only the k first ids can ever be chosen.
    copies = Window.partitionBy("v").orderBy("id")
    t = persisted(t.withColumn("c", F.row_number().over(copies)).filter(F.col("c") <= k).drop("c"), "knn-points")
    size = t.count()
    if size == 0:
        return None
    n_pivots = max(1, min(MAX_PIVOTS, math.isqrt(size)))
    chosen = t.orderBy(hash_bucket(F.concat(F.lit("pivot|"), F.col("id"))), "id").limit(n_pivots).collect()
    pivots = Pivots(np.array([r["v"] for r in chosen]))

    @F.pandas_udf("struct<cell:int,d:double>")
    def assign(v: pd.Series) -> pd.DataFrame:
        cell, d = pivots.nearest(_matrix(v))
        return pd.DataFrame({"cell": cell.astype("int32"), "d": d})

    placed = persisted(t.withColumn("a", assign("v")).select("id", "v", "a.cell", "a.d"), "knn-train")
    # Per cell: row count, radius and the k distances closest to the pivot.
    closest = Window.partitionBy("cell").orderBy("d")
    near_rows = (placed.select("cell", "d").withColumn("r", F.row_number().over(closest)).filter(F.col("r") <= k)
                 .groupBy("cell").agg(F.array_sort(F.collect_list("d")).alias("near")))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).join(near_rows, "cell")
    rows, radius, near = np.zeros(n_pivots, np.int64), np.full(n_pivots, -np.inf), np.full((n_pivots, k), np.inf)
    for c in cells.collect():               # MAX_PIVOTS rows at most
        rows[c["cell"]], radius[c["cell"]] = c["n"], c["radius"]
        near[c["cell"], :len(c["near"])] = c["near"]
    return placed, q, pivots, rows, radius, near


def _parts(rows: int, worth: int, largest: int) -> int:
    return max(1, min(SPLITS, math.ceil(rows / worth)), math.ceil(rows / largest))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)


class _Best:
    """The ``k`` best points of every query of a chunk, as flat arrays by query, distance and the point's place."""

    def __init__(self, rows: int, k: int):
        self.k, self.kth = k, np.full(rows, np.inf)
        self.row, self.point, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, row: np.ndarray, point: np.ndarray, d: np.ndarray, place: np.ndarray) -> None:
        row, point, d = np.concatenate([self.row, row]), np.concatenate([self.point, point]), np.concatenate([self.d, d])
        order = np.lexsort((place[point], d, row))
        row, point, d = row[order], point[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.point, self.d = row[keep], point[keep], d[keep]
        last = rank == self.k - 1
        self.kth[row[last]] = d[last]


def _meet(a: np.ndarray, b: np.ndarray, place: np.ndarray, cell: np.ndarray, wanted, k: int, euclid: bool):
    """(query, point, distance) of the ``k`` best points per query; the points ``b`` come cell by cell, equal distances by ``place``.

    ``wanted`` tells of a chunk of queries which of the cells every one visits.
    """
    cells, first = np.unique(cell, return_index=True)
    ends = np.append(first[1:], len(cell))
    size_a, size_b = (a * a).sum(1), (b * b).sum(1)
    for at in range(0, len(a), CHUNK_ROWS):
        rows, best = a[at:at + CHUNK_ROWS], _Best(len(a[at:at + CHUNK_ROWS]), k)
        visited = wanted(slice(at, at + CHUNK_ROWS), cells)
        for c, (lo, hi) in enumerate(zip(first.tolist(), ends.tolist())):
            some = np.flatnonzero(visited[:, c])
            if not len(some):
                continue
            dots = rows[some] @ b[lo:hi].T
            if euclid:          # near enough to leave out what is too far; the rest is taken exactly
                sizes = size_a[at:at + CHUNK_ROWS][some][:, None] + size_b[None, lo:hi]
                d, room = sizes - 2.0 * dots, 1e-12 * sizes
            else:
                d, room = 1.0 - dots, 0.0

            def close(kth: np.ndarray) -> np.ndarray:
                top = kth + SLACK_DIGITS
                return d <= (top * top if euclid else top)[:, None] + room

            kth = best.kth[some]
            keep = close(kth)
            if hi - lo > k and keep.sum() > 4 * k * len(some):
                tile = np.partition(d + room, k - 1, axis=1)[:, k - 1]
                keep = close(np.minimum(kth, np.sqrt(np.maximum(tile, 0.0)) if euclid else tile))
            r, p = np.nonzero(keep)
            if len(r):
                exact = np.sqrt(((rows[some[r]] - b[lo + p]) ** 2).sum(1)) if euclid else d[r, p]
                best.add(some[r], lo + p, np.round(exact, DIGITS) + 0.0, place)
        yield at + best.row, best.point, best.d


def _best(queries: DataFrame, train: DataFrame, k: int, metric: str, id_col: str, vec: str, block_rows: int,
          probes: int | None) -> DataFrame:
    spark, found_schema = queries.sparkSession, "query_id string, train_id string, distance double"
    prepared = _prepared(queries, train, k, metric, id_col, vec)
    if prepared is None:
        return spark.createDataFrame([], f"{found_schema}, rank int")
    placed, q, pivots, rows, radius, near = prepared
    largest = max(1, PART_BYTES // (8 * pivots.points.shape[1]))
    # cells side by side, like ones together; a part takes the same number of rows from anywhere, so large cells are cut
    order = np.concatenate(pivots.members)
    start = np.zeros(len(rows), np.int64)
    start[order] = np.cumsum(rows[order]) - rows[order]
    n_parts = _parts(int(rows.sum()), block_rows, largest)
    part_rows = math.ceil(int(rows.sum()) / n_parts)
    parts = np.arange(n_parts)[None, :]
    lies_in = (rows > 0)[:, None] & (start[:, None] // part_rows <= parts) & (parts <= (start + rows - 1)[:, None] // part_rows)

    @F.pandas_udf("struct<limit:double,cells:array<int>,parts:array<int>>")
    def reach(v: pd.Series) -> pd.DataFrame:
        m = _matrix(v)
        if probes is None:
            limit, met = pivots.visited_parts(m, radius, near, lies_in)
            return pd.DataFrame({"limit": limit, "cells": [None] * len(m), "parts": met})
        cells = pivots.visits(m, radius, near, probes)
        return pd.DataFrame({"limit": np.inf, "cells": cells, "parts": [np.flatnonzero(lies_in[c].any(axis=0)).astype("int32") for c in cells]})

    asked = persisted(q.withColumn("r", reach("v")).select("id", "v", "r.*"), "knn-queries")
    visitors = asked.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
    # one row per part, one row per cell
    waves = F.broadcast(spark.createDataFrame([(r["part"], _parts(r["n"], block_rows, largest)) for r in visitors], "part int, waves int"))
    starts = F.broadcast(spark.createDataFrame([(c, int(start[c]), int(rows[c])) for c in np.flatnonzero(rows).tolist()],
                                               "cell int, start long, n long"))
    dealt = lambda salt, n: F.pmod(hash_bucket(F.concat(F.lit(salt), F.col("id"))), F.col(n))
    left = asked.withColumn("part", F.explode("parts")).join(waves, "part").select(
        "part", dealt("wave|", "waves").cast("int").alias("wave"), "id", "v", "limit", "cells")
    in_part = F.floor((F.col("start") + dealt("block|", "n")) / F.lit(part_rows)).cast("int")
    right = placed.join(starts, "cell").withColumn("part", in_part).join(waves, "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("waves") - 1)).alias("wave"), "id", "v", "cell")
    euclid = metric == "euclidean"
    out_schema = pa.schema([("query_id", pa.string()), ("train_id", pa.string()), ("distance", pa.float64())])

    def best_of_part(qs: pa.Table, ts: pa.Table) -> pa.Table:
        if not qs.num_rows or not ts.num_rows:
            return out_schema.empty_table()
        ids, cell = ts.column("id").cast(pa.string()), ts.column("cell").to_numpy()
        place = np.empty(len(cell), np.int64)
        place[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(cell))
        by_cell = np.lexsort((place, cell))
        a, limit, lists = _vectors(qs.column("v")), qs.column("limit").to_numpy(), qs.column("cells")

        def wanted(chunk: slice, cells: np.ndarray) -> np.ndarray:
            if probes is None:
                return _distances(a[chunk], pivots.points[cells]) - radius[cells][None, :] <= limit[chunk][:, None]
            return np.array([np.isin(cells, c) for c in lists[chunk].to_pylist()])

        found = list(_meet(a, _vectors(ts.column("v"))[by_cell], place[by_cell], cell[by_cell], wanted, k, euclid))
        row, point, d = (np.concatenate(x) for x in zip(*found))
        return pa.Table.from_arrays([qs.column("id").cast(pa.string()).take(pa.array(row)), ids.take(pa.array(by_cell[point])), pa.array(d)],
                                    schema=out_schema)

    found = left.groupBy("part", "wave").cogroup(right.groupBy("part", "wave")).applyInArrow(best_of_part, found_schema)
    by_distance = Window.partitionBy("query_id").orderBy("distance", "train_id")
    return found.withColumn("rank", F.row_number().over(by_distance)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, train: DataFrame, k: int = 5, metric: str = "cosine",
            id_col: str = "sample_id", vec: str = "vec", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest training rows of every query: (query_id, train_id, distance, rank)."""
    return _best(queries, train, k, metric, id_col, vec, block_rows, None)


def nearest_approximate(queries: DataFrame, train: DataFrame, k: int = 5, metric: str = "cosine", probes: int = 8,
                        id_col: str = "sample_id", vec: str = "vec", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As ``nearest``, but every query visits only its ``probes`` nearest cells; ``recall`` tells what that finds."""
    return _best(queries, train, k, metric, id_col, vec, block_rows, max(1, probes))


def visit_report(queries: DataFrame, train: DataFrame, k: int = 5, metric: str = "cosine", probes: int | None = None,
                 id_col: str = "sample_id", vec: str = "vec") -> DataFrame:
    """One row: queries, cells, visits, and the share of (query, training row) pairs that no visit forms."""
    prepared = _prepared(queries, train, k, metric, id_col, vec)
    if prepared is None:
        return queries.sparkSession.createDataFrame([], "queries long, cells long, visits long, pruned_share double")
    _, q, pivots, rows, radius, near = prepared

    @F.pandas_udf("struct<visits:long,pairs:long>")
    def visited(v: pd.Series) -> pd.DataFrame:
        cells = pivots.visits(_matrix(v), radius, near, probes)
        return pd.DataFrame({"visits": [len(c) for c in cells], "pairs": [int(rows[c].sum()) for c in cells]})

    formed = q.select(visited("v").alias("x")).agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("x.visits"), F.lit(0)).alias("visits"),
                                                   F.coalesce(F.sum("x.pairs"), F.lit(0)).alias("pairs"))
    share = 1 - F.col("pairs") / F.nullif(F.col("queries") * F.lit(int(rows.sum())), F.lit(0))
    return formed.select("queries", F.lit(int((rows > 0).sum())).cast("bigint").alias("cells"), "visits", share.alias("pruned_share"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: neighbours looked for, and the share of them found at least as near as the exact ones of the same rank."""
    far = found.select("query_id", "rank", F.col("distance").alias("got"))
    both = exact.select("query_id", "rank", "distance").join(far, ["query_id", "rank"], "left")
    return both.agg(F.count(F.lit(1)).alias("neighbors"), F.avg((F.coalesce("got", F.lit(float("inf"))) <= F.col("distance")).cast("double")).alias("recall"))


def vote_shares(neighbors: DataFrame, labels: DataFrame, weights: str = "distance") -> DataFrame:
    """Share of the (distance-weighted) vote per query and label.

    Neighbours at distance 0 outvote all others.
    """
    joined = neighbors.join(labels.select(F.col("sample_id").alias("train_id"), "model_id"), "train_id")
    per_query = Window.partitionBy("query_id")     # k rows at most
    exact = F.max((F.col("distance") == 0).cast("int")).over(per_query)
    weight = F.lit(1.0) if weights == "uniform" else (
        F.when(F.col("__exact") == 1, (F.col("distance") == 0).cast("double"))
        .otherwise(F.lit(1.0) / F.nullif(F.col("distance"), F.lit(0.0))))
    voted = joined.withColumn("__exact", exact).withColumn("w", weight)
    sums = voted.groupBy("query_id", "model_id").agg(F.sum("w").alias("w"))
    return sums.select(F.col("query_id").alias("sample_id"), "model_id",
                       (F.col("w") / F.sum("w").over(per_query)).alias("score"))


def knn_route(neighbors: DataFrame, labels: DataFrame, weights: str = "distance") -> DataFrame:
    return argmax(vote_shares(neighbors, labels, weights))


def pairwise_wins(outcomes: DataFrame) -> DataFrame:
    """How many other models each model beats on each sample.

    Better means more correct, or equally correct and cheaper.  Models ordered
    at or above a model (peers included) are those it does not beat, so one
    sorted window per sample replaces the model-by-model comparison.  A cost
    that is NULL or NaN is dearer than any other.
    """
    all_models = Window.partitionBy("sample_id")
    known = F.nanvl(F.col("cost").cast("double"), F.lit(None).cast("double")).asc_nulls_last()
    at_or_above = (Window.partitionBy("sample_id").orderBy(F.col("quality").desc_nulls_last(), known)
                   .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    wins = F.count(F.lit(1)).over(all_models) - F.count(F.lit(1)).over(at_or_above)
    return outcomes.select("sample_id", "model_id", wins.alias("wins"))


def preference_scores(neighbors: DataFrame, wins: DataFrame, weights: str = "distance") -> DataFrame:
    """Weighted pairwise wins of each model over a query's neighbours."""
    w = F.lit(1.0) if weights == "uniform" else F.lit(1.0) / (F.lit(1e-6) + F.col("distance"))
    joined = neighbors.join(wins.withColumnRenamed("sample_id", "train_id"), "train_id")
    return joined.groupBy(F.col("query_id").alias("sample_id"), "model_id").agg(
        F.sum(w * F.col("wins")).alias("score"))


def preference_probabilities(scores: DataFrame) -> DataFrame:
    """Softmax of the scores after dividing by the largest score of all queries (at least 1)."""
    from routeyard.operators.labels import softmax

    top = scores.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("m")).scalar()
    return softmax(scores.withColumn("scaled", F.col("score") / top), "scaled").drop("scaled")
