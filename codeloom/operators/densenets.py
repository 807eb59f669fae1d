"""Weights of a feed-forward net (sigmoid hidden layers, softmax output) by L-BFGS over all rows.

Rows become blocks of their smallest number type once; each evaluation sends the weights out and adds up the
blocks' losses and gradients, by matrix products inside the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import staged

_BLOCK_ROWS = 512
_BLOCK_SCHEMA = "n int, kind string, x binary, y binary"


def _packed(values: np.ndarray) -> np.ndarray:
    whole = np.isfinite(values).all() and (values == np.rint(values)).all() and np.abs(values).max(initial=0) < 1 << 31
    return values.astype(np.result_type(*map(np.min_scalar_type, (int(values.min()), int(values.max())))) if whole else np.float64)


def blocks(data: DataFrame, features: str, label: str) -> DataFrame:
    """Rows as blocks (n, kind, x, y), written once and dealt to all cores."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_ROWS):
                part = batch.slice(at, _BLOCK_ROWS)
                x = _packed(part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                y = part.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([len(y)], pa.int32()), "kind": [x.dtype.str], "x": pa.array([x.tobytes()], pa.binary()),
                    "y": pa.array([y.tobytes()], pa.binary())})

    rows = data.select(F.col(features).cast("array<double>"), F.col(label).cast("int"))
    cores = data.sparkSession.sparkContext.defaultParallelism
    return staged(rows.mapInArrow(pack, _BLOCK_SCHEMA).repartition(2 * cores), "blocks")


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views (inputs x outputs, bias) in the order in which Spark's net keeps its weights."""
    out, at = [], 0
    for m, n in zip(sizes, sizes[1:]):
        out.append((weights[at:at + m * n].reshape(m, n), weights[at + m * n:at + m * n + n]))
        at += m * n + n
    return out


def first_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    """Uniform, by the number of a layer's inputs, as in Spark's net."""
    random = np.random.default_rng(seed)
    return np.concatenate([random.uniform(-2.4, 2.4, m * n + n) / np.sqrt(m) for m, n in zip(sizes, sizes[1:])])


def loss_and_gradient(weights: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over the rows of the cross-entropy and of its gradient, by products in the numbers of ``x``."""
    layers, gradient = _layers(weights.astype(x.dtype, copy=False), sizes), np.empty_like(weights)
    inputs = [x]
    for w, b in layers[:-1]:
        h = inputs[-1] @ w
        h += b
        h *= 0.5
        np.tanh(h, out=h)
        h += 1
        h *= 0.5
        inputs.append(h)
    w, b = layers[-1]
    z = inputs[-1] @ w + b
    z -= z.max(axis=1, keepdims=True)
    log_sum = np.log(np.exp(z).sum(axis=1))
    rows = np.arange(len(y))
    loss = float((log_sum - z[rows, y]).sum(dtype=np.float64))
    delta = np.exp(z - log_sum[:, None])
    delta[rows, y] -= 1
    into = _layers(gradient, sizes)
    for i in range(len(layers) - 1, -1, -1):
        into[i][0][:] = inputs[i].T @ delta
        into[i][1][:] = delta.sum(axis=0)
        if i:
            delta = (delta @ layers[i][0].T) * inputs[i] * (1 - inputs[i])
    return loss, gradient


def _numbers(x: bytes, kind: str) -> np.ndarray:
    """Small whole numbers as single precision, which holds them exactly; others as double."""
    return np.frombuffer(x, kind).astype(np.float32 if np.dtype(kind).kind in "iu" and np.dtype(kind).itemsize <= 2 else np.float64)


def _evaluate(rows: DataFrame, sizes: Sequence[int], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Means over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def partial(part: Iterator) -> Iterator[tuple[int, float, np.ndarray]]:
        w, total, loss, gradient = sent.value, 0, 0.0, None
        for n, kind, x, y in part:
            one, slope = loss_and_gradient(
                w, sizes, _numbers(x, kind).reshape(n, sizes[0]), np.frombuffer(y, np.int32))
            total, loss, gradient = total + n, loss + one, slope if gradient is None else gradient + slope
        if gradient is not None:
            yield total, loss, gradient

    n, loss, gradient = rows.rdd.mapPartitions(partial).treeReduce(lambda a, b: tuple(i + j for i, j in zip(a, b)))
    sent.unpersist()
    return loss / n, gradient / n


def minimize(value: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, iterations: int, tol: float = 1e-6,
             memory: int = 10) -> np.ndarray:
    """L-BFGS (Liu and Nocedal, 1989) with steps that meet the weak Wolfe conditions."""
    f, g = value(w)
    past, values = [], [f]
    for _ in range(iterations):
        d, scales = -g, []
        for s, t in reversed(past):
            scales.append((s @ d) / (s @ t))
            d -= scales[-1] * t
        if past:
            s, t = past[-1]
            d *= (s @ t) / (t @ t)
        for (s, t), a in zip(past, reversed(scales)):
            d += (a - (t @ d) / (s @ t)) * s
        slope = g @ d
        if not slope < 0:
            break
        step, low, high = 1.0 if past else min(1.0, 1 / np.linalg.norm(g)), 0.0, np.inf
        for _ in range(20):
            at = w + step * d
            f2, g2 = value(at)
            if not f2 <= f + 1e-4 * step * slope:
                high = step
            elif g2 @ d < 0.9 * slope:
                low = step
            else:
                break
            step = 2 * low if np.isinf(high) else (low + high) / 2
        if not f2 < f:
            break
        if (at - w) @ (g2 - g) > 0:
            past = [*past, (at - w, g2 - g)][-memory:]
        w, f, g = at, f2, g2
        values.append(f)
        if np.linalg.norm(g) <= tol * max(1.0, abs(f)) or len(values) > 10 and values[-11] - f <= tol * abs(f):
            break
    return w


def train_weights(data: DataFrame, features: str, label: str, sizes: Sequence[int], iterations: int, seed: int) -> np.ndarray:
    rows, sizes = blocks(data, features, label), list(sizes)
    return minimize(lambda w: _evaluate(rows, sizes, w), first_weights(sizes, seed), iterations)
