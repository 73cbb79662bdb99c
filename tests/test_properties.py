"""Properties and small re-derivations that SQL does not cover."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeyard import fixtures as D
from routeyard.functions import scores as S
from routeyard.operators import calibration as K
from routeyard.operators import costs as C
from routeyard.operators import evaluate as E
from routeyard.operators import experiments as X
from routeyard.operators import labels as L
from routeyard.operators import neighbors as NN
from routeyard.operators import policies as P
from routeyard.operators import prefix as PX
from routeyard.operators import quantiles as Q
from routeyard.operators import registry as G

OUTCOME = "sample_id string, model_id string, quality int, cost double"


def edge_outcomes(spark):
    nan = float("nan")
    return spark.createDataFrame([
        ("wrong", "a", 0, 3.0), ("wrong", "b", 0, 2.0), ("wrong", "c", 0, 5.0),
        ("equal", "a", 1, 1.0), ("equal", "b", 1, 1.0), ("equal", "c", 0, 0.5),
        ("single", "b", 1, 9.0),
        ("lost", "a", 1, None), ("lost", "b", 1, 4.0), ("lost", "c", 0, 1.0),
        ("nan", "a", 1, nan), ("nan", "b", 0, 7.0),
        ("none", "a", 0, nan), ("none", "b", 1, None)], OUTCOME)


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys[:-1]) if len(keys) > 2 else r[keys[0]]: r[keys[-1]] for r in df.collect()}


def test_hard_labels_edge_cases(spark):
    got = as_dict(L.hard_labels(edge_outcomes(spark)), "sample_id", "model_id")
    assert got == {"wrong": "b", "equal": "a", "single": "b", "lost": "b", "nan": "b", "none": "a"}
    dropped = as_dict(L.hard_labels(edge_outcomes(spark), "drop"), "sample_id", "model_id")
    assert "wrong" not in dropped and len(dropped) == 5


def test_oracle_uses_finite_costs_only(spark):
    got = as_dict(L.oracle_route(edge_outcomes(spark)), "sample_id", "model_id")
    assert got == {"wrong": "b", "equal": "a", "single": "b", "lost": "b", "nan": "b", "none": "a"}


@pytest.mark.parametrize("lam,scheme,fallback", [(0.0, "exp", "cheapest"), (5.0, "exp", "cost_soft"), (2.0, "power", "cheapest"),
                                                 (1e6, "exp", "cheapest"), (None, "exp", "cheapest")])
def test_soft_targets_sum_to_one(spark, sf, lam, scheme, fallback):
    t = L.soft_targets(D.outcomes(spark, sf), lam, scheme, fallback=fallback)
    sums = t.groupBy("sample_id").agg(F.sum("target").alias("s"), F.min("target").alias("lo")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 and r["lo"] >= 0 for r in sums)


def test_lambda_extremes(spark, sf):
    o = L.solvable(D.outcomes(spark, sf))
    flat = L.soft_targets(o, 0.0).join(o, ["sample_id", "model_id"])
    per = flat.groupBy("sample_id").agg(
        F.max(F.when(F.col("quality") == 1, F.col("target"))).alias("hi"),
        F.min(F.when(F.col("quality") == 1, F.col("target"))).alias("lo"),
        F.max(F.when(F.col("quality") == 0, F.col("target"))).alias("wrong")).collect()
    assert all(abs(r["hi"] - r["lo"]) < 1e-12 and (r["wrong"] or 0) == 0 for r in per)
    sharp = L.argmax(L.soft_targets(o, 1e7), "target")
    assert sharp.exceptAll(L.hard_labels(o).select("sample_id", "model_id")).count() == 0


def test_rank_score_monotone(spark):
    rows = [(a / 10, c / 1000) for a in range(11) for c in range(1, 12)]
    df = spark.createDataFrame(rows, "a double, c double").withColumn(
        "s", S.rank_score(F.col("a"), F.col("c"), F.lit(0.001), F.lit(0.01)))
    got = {(r["a"], r["c"]): r["s"] for r in df.collect()}
    assert all(0 <= v <= 1 for v in got.values())
    for a, c in rows:
        assert got[(a, c)] >= got.get((round(a - 0.1, 1), c), 0) - 1e-12
        assert got[(a, c)] <= got.get((a, round(c - 0.001, 3)), 1) + 1e-12
    docs = spark.createDataFrame([(0.9, 0.001), (0.9, 0.009), (0.5, 0.001)], "a double, c double").select(
        S.rank_score(F.col("a"), F.col("c"), F.lit(0.0005), F.lit(0.01)).alias("s")).collect()
    assert [round(r["s"], 3) for r in docs] == [0.886, 0.278, 0.516]


def test_equal_bounds(spark):
    one = spark.range(1).select(S.normalize_cost(F.lit(3.0), F.lit(2.0), F.lit(2.0)).alias("n"),
                                S.rank_score(F.lit(0.5), F.lit(2.0), F.lit(2.0), F.lit(2.0)).alias("s"),
                                S.rank_breakdown(F.lit(0.5), F.lit(2.0), F.lit(2.0), F.lit(2.0))["relative_cost"].alias("r")).first()
    assert one["n"] == 0 and one["s"] == 0 and one["r"] == 0.5


def test_oracle_beats_every_policy(spark, sf):
    o, m = D.outcomes(spark, sf), D.meta(spark, sf)
    b = C.cost_bounds(o)
    acc = lambda d: E.score(E.gather(d, o), b).first()["accuracy"]
    best = acc(P.oracle(o))
    for d in (P.strongest_global(m, o), P.cheapest_global(m, o), P.strongest_per_dataset(m, o, m),
              P.random_route(m, D.MODEL_IDS)):
        assert acc(d) <= best


def pairs_frame(spark, n=400, seed=3, distinct=17):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, distinct, n) / (distinct - 1)
    y = (rng.random(n) < 0.3 + 0.4 * p).astype(float)
    df = spark.createDataFrame([(str(i), float(a), float(b)) for i, (a, b) in enumerate(zip(p, y))],
                               "sample_id string, p double, label double")
    return p, y, df


def test_failure_auc(spark):
    p, y, df = pairs_frame(spark)
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert K.failure_auc(df).first()["auc"] == pytest.approx(want, abs=1e-12)
    bent = df.withColumn("p", F.exp(F.col("p") * 3) + 2)
    assert K.failure_auc(bent).first()["auc"] == pytest.approx(want, abs=1e-12)
    tied = df.withColumn("p", F.lit(0.25))
    assert K.failure_auc(tied).first()["auc"] == pytest.approx(0.5)
    assert K.failure_auc(df.withColumn("label", F.lit(1.0))).first()["auc"] is None


def test_calibration_error(spark):
    p, y, df = pairs_frame(spark, distinct=31)
    edges, want = np.linspace(0, 1, 16), 0.0
    for i in range(15):
        mask = (p >= edges[i]) & ((p <= edges[i + 1]) if i == 14 else (p < edges[i + 1]))
        if mask.any():
            want += mask.mean() * abs(p[mask].mean() - y[mask].mean())
    assert K.calibration_error(df).first()["ece"] == pytest.approx(want, abs=1e-12)
    assert K.brier_score(df).first()["brier"] == pytest.approx(np.mean((p - y) ** 2))


@pytest.mark.parametrize("distinct", [2, 400])
def test_risk_coverage(spark, distinct):
    """With two distinct risks, half of the rows share one value."""
    p, y, df = pairs_frame(spark, distinct=distinct)
    chosen = df.select("sample_id", F.col("p").alias("risk"), F.col("label").alias("correct"))
    run = K.running_accuracy(chosen).orderBy("seen").collect()
    assert [r["seen"] for r in run] == list(range(1, len(p) + 1))
    assert all(a["risk"] <= b["risk"] for a, b in zip(run, run[1:]))
    acc = np.array([r["accuracy"] for r in run])
    hits = np.cumsum([r["correct"] for r in run]) / np.arange(1, len(p) + 1)
    assert np.allclose(acc, hits)
    cover, curve = np.concatenate([[0], np.arange(1, len(p) + 1) / len(p)]), np.concatenate([[acc[0]], acc])
    want = float(np.sum(np.diff(cover) * (curve[1:] + curve[:-1]) / 2))
    assert K.risk_coverage_auc(chosen).first()["area"] == pytest.approx(want, abs=1e-12)


def test_hot_tie_is_spread_over_ranges(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("sample_id"),
                                    F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id") * 1.0).alias("risk"),
                                    F.lit(1.0).alias("correct"))
    tie = S.hash_bucket(F.col("sample_id")) / F.lit(float(2 ** 32))
    ranged = PX.with_range(rows.withColumn("t", tie), "risk", "t", 64)
    sizes = ranged.filter("risk = 1.0").groupBy("__range").count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 5000 / 10


@pytest.mark.parametrize("ranges", [2, 7, 64, 500])
def test_running_totals_for_any_number_of_ranges(spark, ranges):
    rng = np.random.default_rng(ranges)
    v = np.where(rng.random(900) < 0.4, 5.0, rng.integers(0, 300, 900) / 10)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id bigint, v double")
    tie = S.hash_bucket(F.col("id").cast("string")) / F.lit(float(2 ** 32))
    got = PX.running_totals(df, "v", {"n": F.lit(1), "s": F.col("v")}, tie=tie, then_by=["id"], ranges=ranges)
    rows = got.orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 901))
    assert np.allclose([r["s"] for r in rows], np.cumsum(np.sort(v)))


def test_frontier_is_an_antichain(spark):
    rng = np.random.default_rng(5)
    pts = spark.createDataFrame([(f"r{i}", float(a), float(c)) for i, (a, c) in enumerate(rng.random((40, 2)).round(2))],
                                "router string, accuracy double, avg_cost double")
    f = K.pareto(pts).filter("is_frontier = 1").orderBy("avg_cost").collect()
    assert all(a["accuracy"] < b["accuracy"] and a["avg_cost"] <= b["avg_cost"] for a, b in zip(f, f[1:]))
    bad = spark.createDataFrame([("x", float("nan"), 1.0), ("y", 0.5, float("nan")), ("z", 0.4, 2.0)],
                                "router string, accuracy double, avg_cost double")
    assert {r["router"]: r["is_frontier"] for r in K.pareto(bad).collect()} == {"x": 0, "y": 1, "z": 1}


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 301), rng.normal(size=77)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("a", None)], "g string, v double")
    got = as_dict(Q.percentiles(df, "v", [0, 10, 50, 95, 99, 100], ["g"]), "g", "values")
    for name, xs in (("a", a), ("b", b)):
        assert got[name] == pytest.approx(list(np.percentile(xs, [0, 10, 50, 95, 99, 100])))


def brute_force(q, t, k, metric):
    out = {}
    for qi, qv in q.items():
        d = []
        for ti, tv in t.items():
            if metric == "cosine":
                nq, nt = np.linalg.norm(qv), np.linalg.norm(tv)
                x = 1.0 if nq == 0 or nt == 0 else 1 - qv @ tv / (nq * nt)
            else:
                x = np.linalg.norm(qv - tv)
            d.append((round(x, NN.DIGITS) + 0.0, ti))
        out[qi] = [ti for _, ti in sorted(d)[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_equals_brute_force(spark, metric):
    """A third of the training vectors are copies, some vectors are zero, blocks are tiny."""
    rng = np.random.default_rng(11)
    t = {f"t{i:03d}": rng.normal(size=6).round(3) for i in range(90)}
    t |= {f"c{i:03d}": np.array([1.0, 0, 0, 1, 0, 0]) for i in range(45)}
    t |= {"z0": np.zeros(6), "z1": np.zeros(6)}
    q = {f"q{i:02d}": rng.normal(size=6).round(3) for i in range(25)}
    q |= {"qc": np.array([2.0, 0, 0, 2, 0, 0]), "qz": np.zeros(6)}
    frame = lambda d: spark.createDataFrame([(k, [float(x) for x in v]) for k, v in d.items()],
                                            "sample_id string, vec array<double>")
    got = NN.nearest(frame(q), frame(t), k=4, metric=metric, block_rows=8).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["train_id"])
    assert found == brute_force(q, t, 4, metric)


def test_nearest_with_few_training_rows(spark):
    frame = lambda d: spark.createDataFrame(d, "sample_id string, vec array<double>")
    train = frame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])])
    got = NN.nearest(frame([("q", [1.0, 0.1])]), train, k=5).orderBy("rank").collect()
    assert [r["train_id"] for r in got] == ["a", "b"]
    assert NN.nearest(frame([("q", [1.0, 0.1])]), train.limit(0), k=5).count() == 0


def test_exact_hit_outvotes(spark):
    n = spark.createDataFrame([("q", "a", 0.0), ("q", "b", 0.1), ("q", "c", 0.1)], "query_id string, train_id string, distance double")
    lab = spark.createDataFrame([("a", "m1"), ("b", "m2"), ("c", "m2")], "sample_id string, model_id string")
    assert NN.knn_route(n, lab).first()["model_id"] == "m1"
    assert NN.knn_route(n, lab, "uniform").first()["model_id"] == "m2"


def test_results_do_not_depend_on_partitions(spark, sf):
    o = D.outcomes(spark, sf)
    a = L.soft_targets(o.repartition(1), 3.0)
    b = L.soft_targets(o.repartition(13), 3.0)
    assert a.withColumn("target", F.round("target", 10)).exceptAll(b.withColumn("target", F.round("target", 10))).count() == 0


def test_upsert_newest_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "sample_id string, v int")
    assert as_dict(G.upsert(old, new), "sample_id", "v") == {"a": 1, "b": 3, "c": 4}


def test_upsert_with_repeated_fresh_keys(spark):
    old = spark.createDataFrame([("a", 1, "x")], "sample_id string, seq int, v string")
    new = spark.createDataFrame([("a", 5, "q"), ("a", 9, "b"), ("a", 7, "z"), ("n", 1, "r"), ("n", 1, "s")],
                                "sample_id string, seq int, v string")
    for n in (1, 7):
        got = as_dict(G.upsert(old, new.repartition(n), order=["seq"]), "sample_id", "v")
        assert got == {"a": "b", "n": "s"}


def test_missing_costs_and_scores_come_last(spark):
    nan = float("nan")
    o = spark.createDataFrame([("s", "a", 1, None), ("s", "b", 1, 2.0), ("s", "c", 1, nan), ("t", "b", 1, nan),
                               ("t", "a", 1, None), ("t", "c", 0, nan)], OUTCOME)
    samples = spark.createDataFrame([("s",)], "sample_id string")
    assert P.cheapest_global(samples, o).first()["model_id"] == "b"
    wins = {(r["sample_id"], r["model_id"]): r["wins"] for r in NN.pairwise_wins(o).collect()}
    assert wins["s", "b"] == 2 and wins["s", "a"] == wins["s", "c"] == 0
    assert wins["t", "a"] == wins["t", "b"] == 1
    scored = spark.createDataFrame([("s", "a", None), ("s", "b", 0.1), ("s", "c", nan), ("t", "b", None), ("t", "a", nan)],
                                   "sample_id string, model_id string, score double")
    for pick in (L.argmax(scored), L.argmin(scored, "score")):
        assert as_dict(pick, "sample_id", "model_id") == {"s": "b", "t": "a"}


def test_unknown_models_count_as_wrong_everywhere(spark):
    o = spark.createDataFrame([("s", "a", 1, 2.0), ("t", "a", 1, 2.0)], OUTCOME)
    d = spark.createDataFrame([("s", "a"), ("t", "nobody")], "sample_id string, model_id string")
    b = spark.createDataFrame([(1.0, 4.0)], "cmin double, cmax double")
    one, two = E.score(E.gather(d, o), b).first(), E.summary(d, o, b).first()
    assert one["accuracy"] == two["accuracy"] == 0.5 and one["avg_cost"] == two["avg_cost"] == 1.0


def test_lookups_do_not_repeat_rows(spark):
    from routeyard.operators import assets as A

    long_one, long_two = "x" * 100, "y" * 100
    rows = spark.createDataFrame([("1", long_one, 0), ("1", long_two, 1), ("2", "1", 2)], "index string, image string, at int")
    got = A.resolve_references(rows, order="at").collect()
    assert len(got) == 3 and [r["image"] for r in got if r["index"] == "2"] == [long_two]
    meta = spark.createDataFrame([("s", "p.png")], "sample_id string, image_path string")
    samples = spark.createDataFrame([("s", "old", 0), ("s", "new", 1)], "sample_id string, prompt string, at int")
    got = A.attach_samples(meta, samples, order="at").collect()
    assert [r["text"] for r in got] == ["new"]
    none = A.attach_samples(meta, samples.filter("sample_id = 'z'")).first()
    assert not none["matched"] and [a["uri"] for a in none["assets"]] == ["p.png"]


def test_model_split():
    pool = ["lab/a", "b", "c"]
    assert X.model_split(pool, ["A"]) == (["b", "c"], ["lab/a"])
    assert X.model_split(pool, ["2", "b"]) == (["lab/a"], ["b", "c"])
    assert X.model_split(pool, ["zzz"]) == (pool, [])
    assert X.model_split(pool, pool) == (pool, [])


def test_unknown_options_are_refused(spark, sf):
    with pytest.raises(ValueError):
        L.soft_targets(D.outcomes(spark, sf), scheme="linear")
    from routeyard.functions.vectors import fuse

    with pytest.raises(ValueError):
        fuse(F.col("a"), F.col("b"), "sum")


def test_entropy_bounds(spark, sf):
    o = D.outcomes(spark, sf)
    r = L.target_diagnostics(L.soft_targets(o, 0.0), o).first()
    assert 0 <= r["mean_entropy"] <= r["max_entropy"] == pytest.approx(math.log(8))


def test_approximate_neighbors_and_visits(spark):
    """Clustered points: few probes find nearly all neighbours, and exact searches leave most pairs out."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(30, 8)) * 4
    points = middles[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 8))
    frame = spark.createDataFrame([(f"{i:05d}", p.tolist()) for i, p in enumerate(points)], "sample_id string, vec array<double>")
    queries, train = frame.filter("sample_id < '00200'"), frame.filter("sample_id >= '00200'")
    exact = NN.nearest(queries, train, k=5, metric="euclidean")
    rows = exact.collect()
    want = {}
    for i in range(200):
        d = np.round(np.sqrt(((points[200:] - points[i]) ** 2).sum(1)), NN.DIGITS)
        want[f"{i:05d}"] = [f"{200 + j:05d}" for j in np.lexsort((np.arange(len(d)), d))[:5]]
    assert all(want[r["query_id"]][r["rank"] - 1] == r["train_id"] for r in rows) and len(rows) == 1000
    exact = spark.createDataFrame(rows, exact.schema)
    some = NN.recall(NN.nearest_approximate(queries, train, k=5, metric="euclidean", probes=4), exact).first()
    assert some["neighbors"] == 1000 and 0.9 <= some["recall"] <= 1
    report = NN.visit_report(queries, train, k=5, metric="euclidean").first()
    assert report["queries"] == 200 and report["cells"] <= 53 and report["pruned_share"] > 0.5
    fewer = NN.visit_report(queries, train, k=5, metric="euclidean", probes=4).first()
    assert fewer["visits"] <= 800 and fewer["pruned_share"] >= report["pruned_share"]
    assert NN.visit_report(queries, train.limit(0)).count() == 0


def test_pivots_are_searched_like_one_list():
    """Groups of pivots and tiles of queries change nothing."""
    rng = np.random.default_rng(6)
    points, m = rng.normal(size=(150, 3)), rng.normal(size=(700, 3))
    pivots = NN.Pivots(points)
    cell, d = pivots.nearest(m)
    far = np.sqrt(((m[:, None] - points[None]) ** 2).sum(2))
    assert (far[np.arange(700), cell] <= far.min(axis=1) + 1e-9).all() and np.allclose(d, far.min(axis=1))
    radius, near = rng.random(150), np.sort(rng.random((150, 2)), axis=1)
    limit = np.sort((far[:, :, None] + near[None]).reshape(700, -1), axis=1)[:, 1]
    got = pivots.visits(m, radius, near, None)
    for i in range(700):
        assert set(np.flatnonzero(far[i] - radius <= limit[i] + NN.SLACK / 2)) <= set(got[i].tolist()) <= set(
            np.flatnonzero(far[i] - radius <= limit[i] + 2 * NN.SLACK))
    assert all(len(c) <= 3 for c in pivots.visits(m, radius, near, 3))


def shuffled_rows(df):
    """Rows that the exchanges of an executed plan have written."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        below = sum(walk(node.children().apply(i)) for i in range(node.children().length()))
        return below + (node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0)

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_vectors_travel_a_fixed_number_of_times(spark, monkeypatch, metric):
    """In many dimensions every query visits nearly every cell; it is shuffled once per part all the same."""
    rng = np.random.default_rng(8)
    q, t = ({f"{side}{i:04d}": rng.normal(size=16) for i in range(n)} for side, n in (("q", 1300), ("t", 2500)))
    frame = lambda d: spark.createDataFrame([(k, v.tolist()) for k, v in d.items()], "sample_id string, vec array<double>")
    a, b = np.array(list(q.values())), np.array(list(t.values()))
    if metric == "cosine":
        d = 1 - (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    else:
        d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))
    want = {f"q{i:04d}": [f"t{j:04d}" for j in np.argsort(np.round(d[i], NN.DIGITS), kind="stable")[:5]] for i in range(len(a))}
    for largest, parts in ((1 << 26, NN.SPLITS), (8 * 18 * 300, 9)):
        monkeypatch.setattr(NN, "PART_BYTES", largest)
        got = NN.nearest(frame(q), frame(t), k=5, metric=metric, block_rows=64)
        found = {}
        for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
            found.setdefault(r["query_id"], []).append(r["train_id"])
        assert found == want
        # the vectors, and the best of every part: k rows a query
        assert shuffled_rows(got) <= len(a) * parts + len(b) * NN.SPLITS + 5 * len(a) * parts
