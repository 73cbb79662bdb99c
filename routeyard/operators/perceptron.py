"""Weights of a perceptron that learns whole target distributions.

The classifier of ``pyspark.ml`` takes one label per row.  Here the loss is the soft cross-entropy  -sum t log p  over a target
per model, minimised by L-BFGS: every evaluation is one pass over a stored design table (``block_fits.design``), in which a task
adds up loss and derivatives of its blocks in NumPy.  What travels is as long as the weights, whatever the number of samples.
The network is the classifier's own (logistic hidden units, softmax at the end, per layer the matrix by columns and then the
intercepts), so its weights can be handed to the classifier, which then scores, saves and loads as usual.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from routeyard.operators.block_fits import _added

MEMORY, SUFFICIENT, MAX_HALVINGS = 10, 1e-4, 30
BLOCK = 4096


def unpacked(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per layer its matrix (outputs x inputs) and intercepts."""
    out, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        matrix = weights[at:at + n_in * n_out].reshape(n_in, n_out).T
        at += n_in * n_out
        out.append((matrix, weights[at:at + n_out]))
        at += n_out
    return out


def start_weights(layers: list[int], seed: int) -> np.ndarray:
    rng, parts = np.random.default_rng(seed), []
    for n_in, n_out in zip(layers, layers[1:]):
        reach = np.sqrt(6.0 / (n_in + n_out))
        parts += [rng.uniform(-reach, reach, n_in * n_out), np.zeros(n_out)]
    return np.concatenate(parts)


def _activations(weights: np.ndarray, layers: list[int], x: np.ndarray) -> list[np.ndarray]:
    """Input, hidden values and, last, the logarithms of the probabilities."""
    values, parts = [x], unpacked(weights, layers)
    for i, (matrix, intercepts) in enumerate(parts):
        z = values[-1] @ matrix.T + intercepts
        if i < len(parts) - 1:
            values.append(0.5 * (1.0 + np.tanh(0.5 * z)))
        else:
            z = z - z.max(axis=1, keepdims=True)
            values.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
    return values


def probabilities(weights: np.ndarray, layers: list[int], x: np.ndarray) -> np.ndarray:
    return np.exp(_activations(weights, layers, x)[-1])


def loss_and_slope(weights: np.ndarray, layers: list[int], x: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Sum of the soft cross-entropy over the rows, then its derivative by every weight."""
    values, parts = _activations(weights, layers, x), unpacked(weights, layers)
    slope = np.exp(values[-1]) * targets.sum(axis=1, keepdims=True) - targets
    found = []
    for i in range(len(parts) - 1, -1, -1):
        found += [slope.sum(axis=0), (slope.T @ values[i]).T.ravel()]
        if i:
            slope = (slope @ parts[i][0]) * values[i] * (1.0 - values[i])
    return np.concatenate([[-(targets * values[-1]).sum()], *reversed(found)])


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int,
             tol: float) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with halved steps; ends when the loss falls by less than ``tol`` of itself.  Returns point and losses."""
    point, pairs = start, []
    loss, slope = evaluate(point)
    losses = [loss]
    for _ in range(max_iter):
        direction, scales = slope.copy(), []
        for s, y in reversed(pairs):
            scales.append((s @ direction) / (s @ y))
            direction -= scales[-1] * y
        if pairs:
            s, y = pairs[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(scales)):
            direction += (a - (y @ direction) / (s @ y)) * s
        fall = slope @ direction
        if not fall > 0:
            break
        step = 1.0 if pairs else min(1.0, 1.0 / np.abs(slope).sum())
        for _ in range(MAX_HALVINGS):
            next_point = point - step * direction
            next_loss, next_slope = evaluate(next_point)
            if next_loss <= loss - SUFFICIENT * step * fall:
                break
            step /= 2
        else:
            break
        s, y = next_point - point, next_slope - slope
        if s @ y > 1e-12 * (y @ y):         # the inverse stays positive
            pairs = [*pairs, (s, y)][-MEMORY:]
        change = loss - next_loss
        point, loss, slope = next_point, next_loss, next_slope
        losses.append(loss)
        if change <= tol * max(abs(loss), 1e-12):
            break
    return point, losses


def fit_soft(table: DataFrame, rows: int, layers: list[int], seed: int, max_iter: int, tol: float = 1e-5) -> tuple[np.ndarray, list[float]]:
    """Weights that fit the targets ``y`` of a design table of ``rows`` rows; an absent target counts as 0."""
    start = start_weights(layers, seed)

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(block: dict) -> np.ndarray:
            total = np.zeros(len(weights) + 1)
            for at in range(0, len(block["x"]), BLOCK):
                part = slice(at, at + BLOCK)
                total += loss_and_slope(weights, layers, block["x"][part], np.nan_to_num(block["y"][part]))
            return total

        total = _added(table, sums, len(start) + 1) / max(rows, 1)
        return float(total[0]), total[1:]

    return minimise(evaluate, start, max_iter, tol)
