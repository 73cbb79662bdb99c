"""Exact top-k inner products by ball trees, searched shard by shard with a shared k-th score.

Rows are dealt to shards of bounded size by a hash, and every shard becomes one ball tree: nodes hold a centre and a
radius, split at the median of the widest of two far ends.  By Cauchy and Schwarz no vector of a node scores above
q.centre + |q| * radius, so a search visits nodes by that bound and drops those below the current k-th score.

Queries go in blocks.  A block first searches one shard of its own choice; the k-th scores found there, a lower bound of
the final ones, are shared with its searches of all other shards, which mostly prune at once.  The k best per query and
shard are merged by a grouped sort of at most k times the number of shards rows.  Scores are integers; arithmetic is in
doubles while every product sum stays below 2**53, and in Python integers beyond.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeyard.llm.common import register, stored, table

SHARD_ROWS, BLOCK_ROWS, LEAF = 4096, 256, 64
EXACT = float(2 ** 53)
HITS = "query_id long, dims int, vec_id long, score long"


class BallTree:
    """Vectors as rows; ties in score go to the smaller id, so rows are kept in id order inside leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors, self.ids = vectors, ids
        self.nodes: list[tuple] = []        # (centre, radius, left, right, rows)
        self._build(np.arange(len(ids)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        points = self.vectors[rows]
        centre = points.mean(axis=0)
        away = np.sqrt(((points - centre) ** 2).sum(axis=1))
        radius = float(away.max())
        if len(rows) <= leaf or radius == 0.0:
            self.nodes[me] = (centre, radius, -1, -1, rows)
            return me
        one = points[int(away.argmax())]
        other = points[int(((points - one) ** 2).sum(axis=1).argmax())]
        order = np.argsort(points @ (other - one), kind="stable")
        half = len(rows) // 2
        left = self._build(rows[order[:half]], leaf)
        right = self._build(rows[order[half:]], leaf)
        self.nodes[me] = (centre, radius, left, right, None)
        return me

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id), without the query's own id and without scores below ``floor``."""
        norm = float(np.sqrt((query ** 2).sum()))
        slack = 1e-9 * (1.0 + norm)
        best: list[tuple[float, int]] = []          # least first; ids negated, so the larger id is dropped first
        bound = lambda n: float(query @ n[0]) + norm * n[1] * (1 + 1e-9) + slack * (1 + abs(n[1]))
        heap = [(-bound(self.nodes[0]), 0)]
        while heap:
            high, at = heapq.heappop(heap)
            if -high < max(floor, best[0][0] if len(best) == k else floor):
                break
            centre, radius, left, right, rows = self.nodes[at]
            if rows is None:
                for child in (left, right):
                    heapq.heappush(heap, (-bound(self.nodes[child]), child))
                continue
            scores = self.vectors[rows] @ query
            least = max(floor, best[0][0] if len(best) == k else floor)
            for i in np.flatnonzero(scores >= least).tolist():
                if (row := int(self.ids[rows[i]])) == own:
                    continue
                item = (float(scores[i]), -row)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def exhaustive(ids, vectors, query, own: int, k: int) -> list[tuple[int, int]]:
    """The same in Python integers, for components so large that doubles don't hold the sums; kept in 64 bits."""
    low, high = -(1 << 63), (1 << 63) - 1
    q = [int(x) for x in query]
    found = ((min(max(sum(a * int(b) for a, b in zip(q, v)), low), high), int(i)) for i, v in zip(ids, vectors))
    return sorted((x for x in found if x[1] != own), key=lambda x: (-x[0], x[1]))[:k]


def search_shard(ids, vectors, query_ids, queries, floors, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of a shard for a block of queries."""
    out = []
    large = max(float(np.abs(vectors).max(initial=0)), 1.0) * max(float(np.abs(queries).max(initial=0)), 1.0)
    if large * max(vectors.shape[1], 1) >= EXACT:
        for own, q in zip(query_ids.tolist(), queries):
            out += [(own, i, s) for s, i in exhaustive(ids, vectors, q, own, k)]
        return out
    tree = BallTree(ids, vectors)
    for own, q, floor in zip(query_ids.tolist(), queries, floors):
        out += [(own, i, s) for s, i in tree.search(q, own, k, floor)]
    return out


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, dims, v): components floor(scale * x) as doubles; rows with a null or non-finite component are out."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < F.lit(float("inf"))))
    # one multiplication and rounding of doubles; floor() of Spark gives longs, which huge components don't fit
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < F.lit(EXACT), F.floor(c * scale).cast("double"))
                        .otherwise(c * scale))
    return vectors.filter(good).select("vec_id", F.size("embedding").alias("dims"), whole.alias("v"))


def _blobs(rows: DataFrame, group: str, out: str) -> DataFrame:
    """One row per group of a bounded number of rows: ids and vectors as bytes."""
    schema = f"dims int, {group} long, {out}_ids binary, {out}_vectors binary"

    def pack(part: pa.Table) -> pa.Table:
        ids = part.column("vec_id").to_numpy()
        flat = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        dims = part.column("dims")[0].as_py()
        order = np.argsort(ids, kind="stable")
        vectors = flat.reshape(len(ids), dims)[order]
        return pa.table({"dims": pa.array([dims], pa.int32()), group: pa.array([part.column(group)[0].as_py()]),
                         f"{out}_ids": pa.array([ids[order].tobytes()], pa.binary()),
                         f"{out}_vectors": pa.array([vectors.tobytes()], pa.binary())})

    return rows.groupBy("dims", group).applyInArrow(pack, schema)


def top_k(vectors: DataFrame, query_every: int = 100, k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best for every row whose vec_id is divisible by ``query_every``.

    Vectors of another length than the query's are no candidates.  An id asks once: of rows that
    repeat a query's vec_id the one with the fewest, then least integers asks, and none of them is its candidate; other
    repeated vec_ids are candidates each.  Null ids, null vectors and vectors with a null or non-finite
    component take no part; an empty vector scores 0 with other empty ones; an empty table gives no rows.
    """
    rows = stored(integers(vectors, scale), "vectors")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"),
                     F.count_if(F.col("vec_id") % query_every == 0).alias("q")).first()
    shards, blocks = max(1, -(-sizes["n"] // shard_rows)), max(1, -(-sizes["q"] // block_rows))
    spread = F.xxhash64("vec_id", "v")
    shard = F.pmod(spread, F.lit(shards)).alias("shard")
    block = F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.lit(blocks)).alias("block")
    base = stored(_blobs(rows.select("*", shard), "shard", "s"), "shards")
    one = F.min(F.struct("dims", "v")).alias("row")
    queries = rows.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(one).select("vec_id", "row.*")
    asked = stored(_blobs(queries.select("*", block), "block", "q"), "blocks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                dims = cell["dims"]
                ids, query_ids = (np.frombuffer(cell[c], np.int64) for c in ("s_ids", "q_ids"))
                vecs = np.frombuffer(cell["s_vectors"]).reshape(len(ids), dims)
                queries = np.frombuffer(cell["q_vectors"]).reshape(len(query_ids), dims)
                floors = np.full(len(query_ids), -np.inf)
                if cell.get("floors") is not None:
                    floors = np.frombuffer(cell["floors"])
                found = search_shard(ids, vecs, query_ids, queries, floors, k)
                columns = list(zip(*found)) or [[], [], []]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(columns[0], pa.int64()), "dims": pa.array([dims] * len(found), pa.int32()),
                    "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.int64())})

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th score of every query in the shard that its block searches first."""
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ids, query_ids = (np.frombuffer(cell[c], np.int64) for c in ("s_ids", "q_ids"))
                vecs = np.frombuffer(cell["s_vectors"]).reshape(len(ids), cell["dims"])
                queries = np.frombuffer(cell["q_vectors"]).reshape(len(query_ids), cell["dims"])
                out = np.full(len(query_ids), -np.inf)
                scores: dict[int, list[int]] = {}
                for own, _, s in search_shard(ids, vecs, query_ids, queries, out, k):
                    scores.setdefault(own, []).append(s)
                for i, own in enumerate(query_ids.tolist()):
                    if len(scores.get(own, ())) >= k and abs(scores[own][-1]) < EXACT:
                        out[i] = min(scores[own][:k])
                yield pa.RecordBatch.from_pydict({
                    "dims": pa.array([cell["dims"]], pa.int32()), "block": pa.array([cell["block"]], pa.int64()),
                    "floors": pa.array([out.tobytes()], pa.binary())})

    # every block meets every shard of its vector length once; a cell is two bounded byte strings
    listed = base.select("dims", "shard")
    cells = asked.select("dims", "block").join(listed, "dims")
    parts = max(1, min(shards * blocks, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    first = cells.groupBy("dims", "block").agg(F.min_by("shard", F.xxhash64("block", "shard")).alias("shard"))
    shared = stored(first.join(base, ["dims", "shard"]).join(asked, ["dims", "block"])
                    .repartition(parts, "dims", "block").mapInArrow(floors, "dims int, block long, floors binary"),
                    "floors")
    hits = (cells.join(base, ["dims", "shard"]).join(asked.join(shared, ["dims", "block"], "left"), ["dims", "block"])
            .repartition(parts, "dims", "block", "shard").mapInArrow(search, HITS))
    order = Window.partitionBy("query_id", "dims").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asks AS (SELECT * FROM v WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY len(e), e) = 1),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM asks q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@register("op9_topk", ORACLE)
def op9_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))
