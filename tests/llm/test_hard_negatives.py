"""Hard negatives against brute force (13)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeyard.llm import hard_negatives as hn

VECTORS = "vec_id long, embedding array<float>, label int, cell long, score string, twin int"


def brute(rows):
    """Every pair of rows; repeated rows are candidates each, equal anchors one."""
    good = [(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows
            if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, q in sorted({r for r in good if r[0] % 100 == 0}):
        scored = [(sum(x * z for x, z in zip(q, v)), i, y == label) for i, y, v in good if i != a and len(v) == len(q)]
        for p, positive, _ in sorted((x for x in scored if x[2]), key=lambda x: (-x[0], x[1]))[:5]:
            fit = sorted(((s, i) for s, i, same in scored if not same and 80 * p <= 100 * s <= 100 * p), key=lambda x: (-x[0], x[1]))
            out += [(a, positive, k + 1, i, p, s) for k, (s, i) in enumerate(fit[:5])]
    return sorted(out)


def clustered(rng, n, dims=6, centres=8):
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [m + rng.gauss(0, 0.15) for m in rng.choice(middles)], rng.randrange(10)) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(i, v, y, 1, "x", 2) for i, v, y in rows], VECTORS).repartition(5)


@pytest.mark.parametrize("shard_rows,members", [(4096, 256), (40, 2)])
def test_negatives_equal_brute_force(frame, shard_rows, members):
    rng = random.Random(4)
    rows = clustered(rng, 700)
    rows += [(i, [rng.choice([0.5, -0.5, 0.25]) for _ in range(3)], rng.randrange(3)) for i in range(1000, 1060)]       # many ties
    rows += [(i, [0.5, 0.5, 0.5], 1 + i % 2) for i in range(1100, 1140)]
    rows += [(1400, [0.0] * 6, 1), (1401, [0.0] * 6, 2), (1402, [0.0] * 6, 3), (1500, [-1.0] * 6, 4), (1600, [], 1), (1601, [], 1), (1603, [], 2)]
    rows += [(None, [1.0] * 6, 1), (1700, None, 1), (1701, [1.0] * 6, None), (1702, [None] * 6, 1), (1703, [float("nan")] * 6, 1),
             (1704, [float("inf")] * 6, 1), (1800, [0.3], 2)]
    rows += [rows[0], rows[5], rows[5], (100, rows[3][1], 4), rows[200]]                                              # repeats
    df = frame(rows)
    as_floats = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = hn.hard_negatives(df, shard_rows=shard_rows, members=members)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(as_floats)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_huge_components_and_empty_tables(frame):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1), (2, [9e29, 1.0], 2), (3, [-1e30, 0.0], 2), (4, [1.0, 1.0], 2)]
    got = hn.hard_negatives(frame(rows)).collect()
    # vec_id 0 moves to label 2; scores beyond 64 bits count as the nearest long, so ties go to the smaller vec_id
    assert sorted((r["anchor_id"], r["positive_id"], r["negative_id"]) for r in got) == [(0, 2, 1), (0, 4, 1)]
    assert {r["positive_score"] for r in got} == {(1 << 63) - 1}
    assert hn.hard_negatives(frame(rows).limit(0)).count() == 0
    assert hn.hard_negatives(frame([(1, [1.0], 2)])).count() == 0


def test_walks_end_early_on_clustered_vectors():
    """Members whose rows lie in their own direction compute few of all scores, and miss none."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(16, 32))
    rows = np.floor(256 * (middles[rng.integers(0, 16, 4096)] + 0.2 * rng.normal(size=(4096, 32))))
    members = np.floor(256 * (middles[3] + 0.2 * rng.normal(size=(20, 32))))
    ids, own, labels = np.arange(4096), np.arange(10000, 10020), rng.integers(0, 3, 20)
    row_labels = rng.integers(0, 3, 4096)
    needs = [[hn.Needs(5, -np.inf)] for _ in range(20)]
    computed = hn.walk(members, own, labels, rows, ids, row_labels, needs, True)
    assert computed < 0.35 * 20 * 4096
    for i in range(20):
        s = members[i] @ rows.T
        want = sorted(((int(x), int(j)) for j, x in enumerate(s) if row_labels[j] == labels[i]), key=lambda x: (-x[0], x[1]))[:5]
        assert needs[i][0].best == want


def test_visits_are_merged_and_sent_once_per_part(spark, frame, monkeypatch):
    """What the visits amount to isn't known when the join is planned, so they are never broadcast; and they grow with parts, not shards."""
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)], rng.randrange(3)) for i in range(900)]
    joins, sent, shards = [], [], []
    met, visiting = hn.met, hn.visiting

    def met_seen(visits, of, *rest):
        joins.append(met(visits, of, *rest))
        shards.append(of.count())
        return joins[-1]

    def visiting_seen(*args, **kwargs):
        sent.append(visiting(*args, **kwargs))
        return sent[-1]

    monkeypatch.setattr(hn, "met", met_seen)
    monkeypatch.setattr(hn, "visiting", visiting_seen)
    df = frame(rows)
    got = hn.hard_negatives(df, shard_rows=4, members=4)
    assert sorted(map(tuple, got.collect())) == brute([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    plans = [d._jdf.queryExecution().toString() for d in joins]
    assert len(plans) == 3 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
    assert min(shards) > 200
    for visits in sent:
        assert visits.groupBy("dims", "cluster").count().agg(F.max("count")).first()[0] <= 64
