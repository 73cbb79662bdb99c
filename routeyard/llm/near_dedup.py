"""Near-duplicate components by a chosen-path similarity join over minwise tokens.

A document is the set of its distinct five-word shingles.  Documents with equal sets form one class, and classes are
joined, so copies cost nothing further.  Every class keeps a few dozen minwise tokens (the least value of its shingles
under random permutations) and a sketch of 128 more in 16 bits each.

*Trees.*  Each independent tree sends a class to the nodes named by its tokens at the tree's chosen positions; two sets of
similarity J share a node of one position with probability J.  ``trees * branches`` positions at the root miss a pair at
the threshold 0.85 with probability 0.15 ** 6, about 1e-5.  In a node that branches a pair stays together with probability
1 - (1 - J) ** branches per level, 0.9775 of two branches at 0.85, so the probability rises to 2.3e-5 after one level, 4.4e-5
after two and 7.7e-5 after three.  The sketch, which all trees share, loses at most ``MISS`` of the pairs at the threshold, whatever the
threshold is.

*Stars.*  In every node, all members are compared with its least member only, one pair per member: sketches first, then
the full sets, taken again from the texts.  This links whole groups of copies at linear cost.  Stars give preliminary
components.

*Small nodes exhaustively.*  What stars can have missed lies in nodes that still hold several components.  Nodes of at
most ``leaf`` members compare all pairs of different components in one task; larger ones branch again by further tokens
chosen from the path, never one that named a node above, ``depth`` times at most; what then is still large, or so alike that
branching doesn't divide it, is compared block by block, so no node is dropped.  Members whose sketch agrees with one of another component come again with their texts, and all their pairs are
counted on the full sets.  Pairs are never sent on: a node returns the links of a spanning forest.

Links found in both steps give the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard.llm.common import binary, free_name, register, steps, stored, table, utf8
from routeyard.llm.components import components
from routeyard.llm.shingles import factors, shingle_sets

SHINGLE, PERCENT = 5, 85
TREES, BRANCHES, DEPTH, LEAF = 3, 2, 8, 1024
# Shingles per step of an exhaustive comparison.
COLUMNS = 8192
# Text cut into shingles at once; arrays of the step are a few dozen times as large.
STEP_BYTES = 1 << 17
TOKENS, SKETCH = 24, 128
# Share of the pairs at the threshold that the comparison of sketches may lose.
MISS = 1e-6
BLANKS = r"[\x20\x09-\x0D]+"
SETS = "doc_id long, copy long, n long, fp1 long, fp2 long, tokens binary, sketch binary"


def minwise(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and sketch of a set of 64-bit shingles."""
    h = (found >> np.uint64(32)).astype(np.uint32)
    a = (factors(TOKENS + SKETCH, 2) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (factors(TOKENS + SKETCH, 3) >> np.uint64(32)).astype(np.uint32)
    least = np.full(TOKENS + SKETCH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 4096):
        np.minimum(least, (h[i:i + 4096, None] * a + b).min(axis=0), out=least)
    sketch = (least[TOKENS:] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return least[:TOKENS], sketch.astype(np.uint16)


def agreement(percent: float) -> int:
    """Equal sketch tokens to ask for: of pairs at the threshold a share of at most ``MISS`` has fewer (binomial tail)."""
    p, fewer = percent / 100, 0.0
    for k in range(SKETCH):
        fewer += comb(SKETCH, k) * p ** k * (1 - p) ** (SKETCH - k)
        if fewer > MISS:
            return k
    return SKETCH


def _signed(x) -> int:
    return int(np.uint64(x).astype(np.int64))


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """Per row: size and 128-bit fingerprint of its set, tokens and sketch; ``copy`` tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, limit=STEP_BYTES):
                found = shingle_sets(*utf8(part.column("text")), size)
                mins = [minwise(s) if len(s) else (np.zeros(0, np.uint32), np.zeros(0, np.uint16)) for s in found]
                one = [_signed(s.sum(dtype=np.uint64)) for s in found]
                two = [_signed(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(29))))
                       if len(s) else 0 for s in found]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "copy": part.column("copy"),
                    "n": pa.array([len(s) for s in found], pa.int64()), "fp1": pa.array(one, pa.int64()),
                    "fp2": pa.array(two, pa.int64()), "tokens": binary([m[0].tobytes() for m in mins]),
                    "sketch": binary([m[1].tobytes() for m in mins])})

    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    return rows.mapInArrow(run, SETS)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches agree and whose full sets, taken from the texts, reach the threshold."""
    least = agreement(percent)
    sides = classes.select("class", "doc_id", "copy", "sketch")
    near = (pairs.join(sides.select(F.col("class").alias("a"), F.col("doc_id").alias("a_id"),
                                    F.col("copy").alias("a_copy"), F.col("sketch").alias("a_sketch")), "a")
            .join(sides.select(F.col("class").alias("b"), F.col("doc_id").alias("b_id"),
                               F.col("copy").alias("b_copy"), F.col("sketch").alias("b_sketch")), "b"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SKETCH)
                            for c in ("a_sketch", "b_sketch"))
                keep = (one == two).sum(axis=1) >= least
                yield batch.drop_columns(["a_sketch", "b_sketch"]).filter(pa.array(keep))

    fields = ("a", "b", "a_id", "a_copy", "b_id", "b_copy")
    likely = stored(near.select(*fields, "a_sketch", "b_sketch")
                    .mapInArrow(agree, ", ".join(f"{c} long" for c in fields)), "likely")
    texts = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")

    def side(x: str) -> Column:
        return F.col("doc_id").eqNullSafe(F.col(f"{x}_id")) & (F.col("copy") == F.col(f"{x}_copy"))

    both = likely.join(texts, side("a")).select("a", "b", "b_id", "b_copy", F.col("text").alias("a_text"))
    both = both.join(texts, side("b")).select("a", "b", "a_text", F.col("text").alias("b_text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "a_text", STEP_BYTES):
                one, two = (shingle_sets(*utf8(part.column(c)), size) for c in ("a_text", "b_text"))
                keep = []
                for x, y in zip(one, two):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "a long, b long").distinct()


def token(column: str, position: Column) -> Column:
    """The minwise token at a position, as four bytes."""
    return F.substring(F.col(column), position * 4 + 1, F.lit(4))


def _by_node(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each node, which come one after the other."""
    node, rows = None, []
    for batch in batches:
        for at, *row in zip(*(batch.column(c).to_pylist() for c in ("node", *columns))):
            if at != node:
                if len(rows) > 1:
                    yield node, rows
                node, rows = at, []
            rows.append(tuple(row))
    if len(rows) > 1:
        yield node, rows


def likely_members(members: DataFrame, percent: int) -> DataFrame:
    """Members of (node, class, component, part, sketch) that agree with a member of another component of their node.

    A node has ``leaf`` members, or two parts of about that many; then only pairs across the parts count.
    """
    least = agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, rows in _by_node(batches, ("class", "component", "part", "sketch")):
            comps, parts = (np.array([r[i] for r in rows]) for i in (1, 2))
            sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(-1, SKETCH)
            split = parts.min() != parts.max()
            hit = np.zeros(len(rows), bool)
            for i in range(len(rows) - 1):
                other = np.flatnonzero((comps[i + 1:] != comps[i]) & ((parts[i + 1:] != parts[i]) | (not split))) + i + 1
                if len(other):
                    same = (sketches[other] == sketches[i]).sum(axis=1) >= least
                    hit[other[same]] = True
                    hit[i] |= bool(same.any())
            if hit.any():
                found = [rows[i] for i in np.flatnonzero(hit).tolist()]
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array([node] * len(found), pa.int64()), "class": pa.array([r[0] for r in found], pa.int64()),
                    "component": pa.array([r[1] for r in found], pa.int64())})

    ordered = members.repartition("node").sortWithinPartitions("node")
    return ordered.mapInArrow(run, "node long, class long, component long")


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets reach the threshold, from the counts of shared shingles, a block of shingles at a time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    found, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    keep = (times > 1)[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n), np.float64)
    for low in range(0, int((times > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        block = np.zeros((n, COLUMNS), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        shared += block @ block.T
    sizes = np.array([len(s) for s in sets], np.float64)
    return 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)


def links_in_nodes(members: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of a node, from the full sets of its members: fewer than it has members."""
    places = members.join(classes.select("class", "doc_id", "copy"), "class").select(
        "node", "class", "component", F.col("doc_id").alias("of_id"), F.col("copy").alias("of_copy"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("copy") == F.col("of_copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_node(batches, ("class", "component", "text")):
            rows = list({r[0]: r for r in rows}.values())           # rows may repeat a doc_id and its text
            data, bounds = utf8(pa.array([r[2] for r in rows], pa.large_string()))
            near = similar(shingle_sets(data, bounds, size), percent)
            seen, links = np.zeros(len(rows), bool), []
            for i in range(len(rows)):
                reached = [] if seen[i] else [i]
                seen[i] = True
                while reached:
                    at = reached.pop()
                    for j in np.flatnonzero(near[at] & ~seen).tolist():
                        seen[j] = True
                        reached.append(j)
                        if rows[at][1] != rows[j][1]:
                            links.append((rows[at][0], rows[j][0]))
            if links:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()),
                                                  "b": pa.array([y for _, y in links], pa.int64())})

    found = texts.join(places, same).select("node", "class", "component", "text")
    return found.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def mixed_nodes(nodes: DataFrame) -> DataFrame:
    """Members of nodes that hold several components, with the node's size."""
    sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"),
                                      F.max("component").alias("high"))
    return nodes.join(sizes.filter(F.col("low") != F.col("high")).select("node", "size"), "node")


def in_blocks(large: DataFrame, leaf: int) -> DataFrame:
    """Members of large nodes, dealt by a hash into blocks of about ``leaf``, once for every pair of blocks."""
    blocks = F.ceil(F.col("size") / leaf).cast("int")
    return (large.withColumn("mine", F.pmod(F.xxhash64("class"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"),
                    "class", "component", F.col("mine").alias("part")))


def small_nodes(nodes: DataFrame, classes: DataFrame, leaf: int, branches: int, depth: int) -> DataFrame:
    """Members of mixed nodes, (node, class, component, part, sketch), in nodes of about ``leaf`` or two.

    ``nodes`` tells in ``used``, a bit per position, which tokens named a node's path; a large node branches by others,
    ``depth`` times at most.  Where one child keeps half of its members, they are so alike that branching only
    repeats them: such a node, and one that stays large, goes block by block.
    """
    sketches = classes.select("class", "tokens", "sketch")
    level, leaves = stored(mixed_nodes(nodes), "level"), []
    for at in range(depth + 1):
        small = level.filter(F.col("size") <= leaf).withColumn("part", F.lit(0))
        leaves.append(small.select("node", "class", "component", "part"))
        large = level.filter(F.col("size") > leaf).select("node", "class", "component", "size", "used")
        if large.isEmpty():
            break
        if at == depth:
            leaves.append(in_blocks(large, leaf))
            break
        # the path decides which tokens are chosen next
        fresh = F.filter(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda i: F.getbit("used", i) == 0)
        drawn = F.sort_array(F.transform(fresh, lambda i: F.struct(F.xxhash64("node", i).alias("h"), i.alias("i"))))
        spots = F.transform(F.slice(drawn, 1, branches), lambda x: x["i"])
        children = stored(
            large.join(sketches.select("class", "tokens"), "class")
            .select(F.col("node").alias("parent"), "class", "component", "tokens", "node", "size", "used", F.explode(spots).alias("spot"))
            .select("parent", F.col("size").alias("of"), "class", "component",
                    F.expr("used | shiftleft(1L, spot)").alias("used"),
                    F.xxhash64("node", "spot", token("tokens", F.col("spot"))).alias("node")).distinct(), "children")
        dense = (children.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("size"), F.max("of").alias("of"))
                 .filter(2 * F.col("size") >= F.col("of")).select("parent").distinct())
        alike = stored(dense, "dense")
        leaves.append(in_blocks(large.join(alike, F.col("node") == F.col("parent"), "left_semi"), leaf))
        rest = children.join(alike, "parent", "left_anti").select("node", "class", "component", "used")
        level = stored(mixed_nodes(rest), "level")
    members = leaves[0]
    for more in leaves[1:]:
        members = members.union(more)
    return members.join(sketches.select("class", "sketch"), "class")


def linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, trees: int = TREES,
           branches: int = BRANCHES, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """(doc_id, copy, n, root, component_id) per row: ``copy`` hashes the text, ``root`` names the component's classes.

    Root and component_id are null for a text without words.
    """
    rows = stored(sets_of(docs, size), "sets").withColumn(
        "class", F.when(F.col("n") > 0, F.xxhash64("n", "fp1", "fp2")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("least")
    grouped = rows.filter("n > 0").groupBy("class").agg(
        least, F.min("tokens").alias("tokens"), F.min("sketch").alias("sketch"))
    classes = stored(grouped.select("class", "least.doc_id", "least.copy", "tokens", "sketch"), "classes")

    spots = F.explode(F.array(*[F.lit(i) for i in range(trees * branches)])).alias("spot")
    roots = classes.select("class", "tokens", spots).select(
        F.xxhash64("spot", token("tokens", F.col("spot"))).alias("node"), "class",
        F.expr("shiftleft(1L, spot)").alias("used"))
    shared = (roots.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("b"))
              .filter("size > 1"))
    nodes = stored(roots.join(shared.select("node", "b"), "node"), "nodes")
    stars = (nodes.filter(F.col("class") != F.col("b")).select(F.col("class").alias("a"), "b").distinct())
    star_links = stored(confirmed(stars, classes, docs, size, percent), "links")
    early = components(star_links)
    labelled = nodes.select("node", "class", "used").join(early.select(F.col("node").alias("class"), "root"), "class", "left")
    labelled = labelled.select("node", "class", "used", F.coalesce("root", "class").alias("component"))
    likely = stored(likely_members(small_nodes(labelled, classes, leaf, branches, depth), percent), "likely")
    more = links_in_nodes(likely, classes, docs, size, percent)
    final = components(star_links.union(more))

    named = classes.select("class", "doc_id").join(
        final.select(F.col("node").alias("class"), "root"), "class", "left").select(
        "class", "doc_id", F.coalesce("root", "class").alias("root"))
    firsts = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(firsts, "root").select("class", "root", "component_id")
    return (rows.select("doc_id", "copy", "n", "class").join(of_class, "class", "left")
            .select("doc_id", "copy", "n", "root", "component_id"))


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row.

    Texts that are null, empty or without words have no shingles and are linked with nothing: each is its own component.
    component_id is the least doc_id reached, a null doc_id counting only where a component has no other; ``kept`` is
    doc_id = component_id, false for a null doc_id.  Rows that repeat a doc_id are documents of their own.  An empty
    table gives no rows; further columns are ignored.
    """
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return linked(docs, **parameters).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def representatives(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` with one document of every component: the least doc_id, a null one last.

    Texts without words all stay.  Of rows that repeat both doc_id and text one stays.
    """
    copy, of, text = (free_name(docs, name) for name in ("copy_hash", "of_copy", "of_text"))
    own = docs.withColumn(copy, F.xxhash64("text"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("least")
    chosen = (linked(docs, **parameters).filter(F.col("root").isNotNull()).groupBy("root").agg(least)
              .select(F.col("least.doc_id").alias(of), F.col("least.copy").alias(text)))
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(copy) == F.col(text))
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, "") == ""
    stays = own.filter(~blank).join(chosen, same, "left_semi").dropDuplicates(["doc_id", copy])
    return stays.union(own.filter(blank)).drop(copy)


ORACLE = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5
                 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
h AS (SELECT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents
      UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n USING (doc_id)
"""


@register("op1_near_dedup", ORACLE)
def op1_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
