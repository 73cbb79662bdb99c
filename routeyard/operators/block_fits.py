"""Logistic fits by Newton steps whose sums are taken on blocks of samples, many fits in one pass.

A design table has one row per sample: its standardised vector, its query type, a label per model and a weight per fit.
Every step of all fits together is one pass over it: a task adds up first and second derivatives of its blocks in NumPy, the
sums are added in groups, and the driver solves for the next step.  What travels depends on the number of features, types and
models only, never on the number of samples.  Newton's method needs few passes, and ends when every derivative is below
the tolerance.

*Pairwise risk* has the linear score  w·x(sample) + v·p(model) + c[type]·p(model) + b.  Over the samples of one type, a
model's profile is constant, so its part is one number per (type, model): the wide row of a pair with its crossed terms never
exists.  *Heads* are one fit per model on the same vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.runtime import persisted

FAN_IN = 64
MAX_STEPS = 100


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def design(rows: DataFrame, outcomes: DataFrame, label: Column, models: list[str], weights: list[Column], name: str) -> DataFrame:
    """(sample_id, kind, x, y, w), written once: ``y`` has a label per model, NaN where there is none, ``w`` a weight per fit.

    ``rows`` is (sample_id, query_type, vec); a type that isn't known gets the kind -1.
    """
    at = {m: F.max(F.when(F.col("model_id") == m, label)) for m in models}
    cells = outcomes.groupBy("sample_id").agg(F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in at.values()]).alias("y"))
    kinds = F.coalesce(F.array_position(F.array(*[F.lit(q) for q in V.QUERY_TYPES]), F.col("query_type")), F.lit(0)).cast("int") - 1
    return persisted(rows.join(cells, "sample_id").select(
        "sample_id", kinds.alias("kind"), F.col("vec").alias("x"), "y", F.array(*[w.cast("double") for w in weights]).alias("w")), name)


def _added(table: DataFrame, sums: Callable[[dict], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of ``sums``, an array of ``size`` numbers per block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                width = len(batch.column("x")[0])
                total += sums({"x": _vectors(batch.column("x"), width), "kind": batch.column("kind").to_numpy(),
                               "y": _vectors(batch.column("y"), len(batch.column("y")[0])),
                               "w": _vectors(batch.column("w"), len(batch.column("w")[0]))})
        yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                          "total": pa.array([total.tobytes()], pa.binary())})

    def together(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["task"])
        total = sum(np.frombuffer(r["total"]) for r in rows)
        return pa.table({"task": pa.array([rows[0]["task"] % len(groups)], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

    out, tasks, groups = table.mapInArrow(run, "task long, total binary"), table.rdd.getNumPartitions(), range(1)
    while tasks > FAN_IN:                   # a tree: the driver never adds more than FAN_IN of them
        tasks = -(-tasks // FAN_IN)
        groups = range(tasks)
        out = out.groupBy(F.pmod("task", F.lit(tasks)).alias("group")).applyInArrow(together, "task long, total binary")
    return sum((np.frombuffer(r["total"]) for r in sorted(out.collect(), key=lambda r: r["task"])), np.zeros(size))


def _newton(fits: int, size: Callable[[int], int], derivatives: Callable, reg: float, free: list[int], tol: float) -> tuple[list[np.ndarray], list[float]]:
    """Minimise all fits at once; ``derivatives`` gives per fit (loss, slope, curvature) of the mean loss at the points.

    A step that raises a fit's loss is halved.  Returns the points and the largest derivative of each.
    """
    points = [np.zeros(size(f)) for f in range(fits)]
    kept = [None] * fits                    # (point, loss, direction) of the last accepted point
    done, slopes, step = [False] * fits, [np.inf] * fits, [1.0] * fits
    for _ in range(MAX_STEPS):
        found = derivatives(points, [not d for d in done])
        for f in range(fits):
            if done[f]:
                continue
            loss, slope, curvature = found[f]
            ridge = np.full(len(points[f]), reg)
            ridge[free[f]] = 0.0
            loss = loss + (ridge * points[f] ** 2).sum() / 2
            slope = slope + ridge * points[f]
            if kept[f] is not None and loss > kept[f][1] + 1e-12 * (1 + abs(kept[f][1])) and step[f] > 1e-6:
                step[f] /= 2
                points[f] = kept[f][0] + step[f] * kept[f][2]
                continue
            slopes[f] = float(np.abs(slope).max(initial=0.0))
            if slopes[f] <= tol:
                done[f] = True
                continue
            direction = -np.linalg.lstsq(curvature + np.diag(ridge + 1e-12), slope, rcond=None)[0]
            kept[f], step[f] = (points[f], loss, direction), 1.0
            points[f] = points[f] + direction
        if all(done):
            break
    return points, slopes


def _logistic(z: np.ndarray, y: np.ndarray, w: np.ndarray, brier: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss and its derivatives by the score; NaN labels have weight 0.

    ``brier`` adds so much of the squared error of the probability, whose second derivative is that of a Gauss-Newton step.
    """
    known = ~np.isnan(y)
    w, y = np.where(known, w, 0.0), np.where(known, y, 0.0)
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    loss, r, v = np.logaddexp(0.0, z) - y * z, p - y, p * (1 - p)
    if brier:
        loss, r, v = loss + brier * (p - y) ** 2, r + 2 * brier * (p - y) * v, v + 2 * brier * v * v
    return float((w * loss).sum()), w * r, w * v


@dataclass
class RiskFit:
    """One pairwise fit: which rows count, which columns and models it sees, and the models' profiles (models × width)."""

    profiles: np.ndarray
    weight: Column = field(default_factory=lambda: F.lit(1.0))
    columns: np.ndarray | None = None
    models: np.ndarray | None = None
    by_type: bool = True
    brier: float = 0.0

    def cells(self) -> np.ndarray:
        """What (type, model) contributes per coefficient of the model part: its profile, and again in its type's block."""
        kinds, (models, width) = len(V.QUERY_TYPES), self.profiles.shape
        plain = np.tile(self.profiles, (kinds + 1, 1))              # the last type is an unknown one
        if not self.by_type:
            return plain
        crossed = np.zeros(((kinds + 1) * models, kinds * width))
        for q in range(kinds):
            crossed[q * models:(q + 1) * models, q * width:(q + 1) * width] = self.profiles
        return np.concatenate([plain, crossed], axis=1)


@dataclass
class RiskModel:
    """Fitted coefficients: of the sample's vector, the intercept, and one number per (type, model)."""

    sample: np.ndarray
    intercept: float
    model: np.ndarray                       # of the profile, then a block per type
    slope: float
    by_type: bool = True

    def offsets(self, profiles: np.ndarray) -> np.ndarray:
        """(types and one unknown) × models."""
        return (RiskFit(profiles, by_type=self.by_type).cells() @ self.model).reshape(-1, len(profiles)) + self.intercept


def fit_risks(table: DataFrame, fits: list[RiskFit], reg: float = 1e-3, tol: float = 1e-9) -> list[RiskModel]:
    """All fits over one design table, whose ``w`` has their weights in this order."""
    first = table.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no samples to learn from")
    d, kinds = first["d"], len(V.QUERY_TYPES) + 1
    cells = [f.cells() for f in fits]
    models = [len(f.profiles) for f in fits]
    masks = [np.ones(d) if f.columns is None else np.asarray(f.columns, float) for f in fits]
    briers = [f.brier for f in fits]            # what the tasks get must not hold columns
    seen = [np.ones(k) if f.models is None else np.asarray(f.models, float) for f, k in zip(fits, models)]
    # loss, weight, slope of x and 1, slope of cells, curvature of x and 1, of x with cells, of cells
    shapes = [[(1,), (1,), (d + 1,), (kinds * k,), (d + 1, d + 1), (d + 1, kinds * k), (kinds * k,)] for k in models]
    sizes = [sum(int(np.prod(s)) for s in shape) for shape in shapes]

    def derivatives(points: list[np.ndarray], wanted: list[bool]) -> list:
        active = [f for f in range(len(fits)) if wanted[f]]
        linear = {f: np.append(points[f][:d] * masks[f], points[f][d]) for f in active}
        offset = {f: (cells[f] @ points[f][d + 1:]).reshape(kinds, -1) for f in active}

        def sums(block: dict) -> np.ndarray:
            kind = block["kind"] % kinds            # -1 is the last one
            one = np.append(block["x"], np.ones((len(kind), 1)), axis=1)
            out = []
            for f in active:
                x = one * np.append(masks[f], 1.0)
                w = block["w"][:, f:f + 1] * seen[f]
                loss, r, v = _logistic((one @ linear[f])[:, None] + offset[f][kind], block["y"], w, briers[f])
                by_kind = [np.flatnonzero(kind == q) for q in range(kinds)]
                total = float(np.where(np.isnan(block["y"]), 0.0, w).sum())
                out += [np.array([loss, total]), x.T @ r.sum(axis=1), np.concatenate([r[i].sum(axis=0) for i in by_kind]),
                        (x.T @ (x * v.sum(axis=1)[:, None])).ravel(),
                        np.concatenate([x[i].T @ v[i] for i in by_kind], axis=1).ravel(),
                        np.concatenate([v[i].sum(axis=0) for i in by_kind])]
            return np.concatenate(out)

        total = _added(table, sums, sum(sizes[f] for f in active))
        out, at = [None] * len(fits), 0
        for f in active:
            parts = []
            for shape in shapes[f]:
                n = int(np.prod(shape))
                parts.append(total[at:at + n].reshape(shape))
                at += n
            loss, n, g_x, g_cells, h_x, h_mixed, h_cells = parts
            n = max(n[0], 1e-300)
            mixed = h_mixed @ cells[f]
            curvature = np.block([[h_x, mixed], [mixed.T, cells[f].T @ (h_cells[:, None] * cells[f])]])
            out[f] = (loss[0] / n, np.concatenate([g_x, cells[f].T @ g_cells]) / n, curvature / n)
        return out

    points, slopes = _newton(len(fits), lambda f: d + 1 + cells[f].shape[1], derivatives, reg, [d] * len(fits), tol)
    return [RiskModel(p[:d] * m, float(p[d]), p[d + 1:], s, f.by_type) for p, m, s, f in zip(points, masks, slopes, fits)]


def risk_scores(rows: DataFrame, fitted: list[tuple[RiskModel, np.ndarray]], models: list[str]) -> DataFrame:
    """(sample_id, z): per fit an array over the models of the linear score; ``rows`` is (sample_id, query_type, vec).

    The sample's part is computed once per fit, the rest is one number per type and model.
    """
    kind = F.coalesce(F.array_position(F.array(*[F.lit(q) for q in V.QUERY_TYPES]), F.col("query_type")),
                      F.lit(len(V.QUERY_TYPES) + 1)).cast("int")
    numbers = lambda a: F.array(*[F.lit(float(x)) for x in a])
    dot = lambda w: F.aggregate(F.zip_with("vec", numbers(w), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def of_fit(i: int, m: RiskModel, p: np.ndarray) -> Column:
        offsets = F.element_at(F.array(*[numbers(r) for r in m.offsets(p)]), kind)
        return F.transform(offsets, lambda o: o + F.col(f"__own{i}"))

    out = [of_fit(i, m, p) for i, (m, p) in enumerate(fitted)]
    owned = rows.withColumns({f"__own{i}": dot(m.sample) for i, (m, _) in enumerate(fitted)})
    return owned.select("sample_id", F.array(*out).alias("z"))


def exploded_risks(scored: DataFrame, models: list[str], fit: int = 0) -> DataFrame:
    """(sample_id, model_id, risk) of one fit of ``risk_scores``."""
    names = F.array(*[F.lit(m) for m in models])
    pairs = F.explode(F.arrays_zip(names.alias("model_id"), F.col("z")[fit].alias("z"))).alias("m")
    return scored.select("sample_id", pairs).select("sample_id", "m.model_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("m.z")))).alias("risk"))


def coefficients(spark, fitted: list[RiskModel]) -> DataFrame:
    """Fits as a table: (fit, part, kind, dim, value), the kind being the query type of a model's block."""
    rows = []
    for f, m in enumerate(fitted):
        width = len(m.model) // (len(V.QUERY_TYPES) + 1) if m.by_type else len(m.model)
        rows.append((f, "intercept", "all" if m.by_type else "", 0, m.intercept))
        rows += [(f, "sample", "", i, float(x)) for i, x in enumerate(m.sample)]
        rows += [(f, "model", "" if i < width else V.QUERY_TYPES[i // width - 1], i % width, float(x)) for i, x in enumerate(m.model)]
    return spark.createDataFrame(rows, "fit int, part string, kind string, dim int, value double")


def fitted_models(table: DataFrame) -> list[RiskModel]:
    rows, order = table.collect(), ("", *V.QUERY_TYPES)
    out = []
    for f in sorted({r["fit"] for r in rows}):
        of = lambda part, f=f: sorted((order.index(r["kind"]) if part == "model" else 0, r["dim"], r["value"])
                                      for r in rows if r["fit"] == f and r["part"] == part)
        level = next(r for r in rows if r["fit"] == f and r["part"] == "intercept")
        out.append(RiskModel(np.array([x for *_, x in of("sample")]), level["value"], np.array([x for *_, x in of("model")]), 0.0,
                             level["kind"] == "all"))
    return out


def fit_heads(table: DataFrame, reg: float = 1e-3, tol: float = 1e-9) -> tuple[np.ndarray, list[float]]:
    """One balanced logistic head per label: (labels × features and intercept), and the largest derivatives.

    Weights n / (2 n_1) and n / (2 n_0) balance a head's labels.  A head whose label always is 1 gets the intercept infinity,
    one whose label never is 1 minus infinity.
    """
    first = table.select(F.size("x").alias("d"), F.size("y").alias("k")).first()
    if first is None:
        raise ValueError("no samples to learn from")
    d, heads = first["d"], first["k"]
    counted = _added(table, lambda b: np.concatenate([(b["y"] == 1).sum(axis=0), (b["y"] == 0).sum(axis=0)]).astype(float), 2 * heads)
    ones, zeros = counted[:heads], counted[heads:]
    # a head without a label of each kind isn't fitted
    fitted = (ones > 0) & (zeros > 0)
    plus = (ones + zeros) / (2 * np.maximum(ones, 1))
    minus = (ones + zeros) / (2 * np.maximum(zeros, 1))
    size = 2 + (d + 1) + (d + 1) ** 2

    def derivatives(points: list[np.ndarray], wanted: list[bool]) -> list:
        active = [k for k in range(heads) if wanted[k] and fitted[k]]

        def sums(block: dict) -> np.ndarray:
            x = np.append(block["x"], np.ones((len(block["kind"]), 1)), axis=1)
            out = []
            for k in active:
                y = block["y"][:, k]
                w = block["w"][:, 0] * np.where(y == 1, plus[k], minus[k])
                loss, r, v = _logistic(x @ points[k], y, w)
                out += [np.array([loss, np.where(np.isnan(y), 0.0, w).sum()]), x.T @ r, (x.T @ (x * v[:, None])).ravel()]
            return np.concatenate(out) if out else np.zeros(0)

        total = _added(table, sums, size * len(active)).reshape(len(active), size) if active else []
        out = [(0.0, np.zeros(d + 1), np.eye(d + 1))] * heads
        for k, t in zip(active, total):
            n = max(t[1], 1e-300)
            out[k] = (t[0] / n, t[2:d + 3] / n, t[d + 3:].reshape(d + 1, d + 1) / n)
        return out

    points, slopes = _newton(heads, lambda k: d + 1, derivatives, reg, [d] * heads, tol)
    for k in np.flatnonzero(~fitted).tolist():
        points[k][d] = np.inf if ones[k] > 0 else -np.inf
    return np.array(points), slopes
