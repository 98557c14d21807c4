"""Logistic models of all targets over sparse rows: one pass over the data is a gradient of every target.

A row is a list of feature indices and values: a constant, the filled and scaled numbers, their missing flags and the ids of
multi-hot fields, each field at its own offset. Each task adds up losses and gradients of all targets in one
matrix, Spark sums them by feature, and the driver, which holds a weight for each feature and target (at most MOST_WEIGHTS),
moves every target by its own quasi-Newton step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadlake.operators.prepare import impute_stats
from dyadlake.sources.shared import cut

MOST_WEIGHTS = 1 << 22
MEMORY = 8  # earlier steps that shape a direction


@dataclass
class Design:
    """Where features lie: the constant at 0, two places for each number, then the ids 0..size-1 of each multi-hot field."""

    numeric: list[str]
    multi: dict[str, int]
    stats: dict[str, tuple[float, float, float]]  # fill, mean and deviation of each number
    size: int = field(init=False)

    def __post_init__(self) -> None:
        self.size = 1 + 2 * len(self.numeric) + sum(self.multi.values())

    def columns(self) -> tuple[Column, Column]:
        """(indices, values) of a row; ids outside 0..size-1 have no feature."""
        at, val = [F.lit(0)], [F.lit(1.0)]
        for i, f in enumerate(self.numeric):
            fill, mean, std = self.stats[f]
            x = F.col(f).cast("double")
            x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
            at += [F.lit(1 + 2 * i), F.lit(2 + 2 * i)]
            val += [(F.coalesce(x, F.lit(fill)) - mean) / std, x.isNull().cast("double")]
        at, val, start = F.array(*at), F.array(*val), 1 + 2 * len(self.numeric)
        for f, size in self.multi.items():
            ids = F.filter(F.array_distinct(F.coalesce(F.col(f), F.array().cast("array<int>"))), _between(size))
            at = F.concat(at, F.transform(ids, _plus(start)))
            val = F.concat(val, F.transform(ids, lambda x: F.lit(1.0)))
            start += size
        return at, val


def _between(size: int):
    return lambda x: (x >= 0) & (x < size)


def _plus(start: int):
    return lambda x: (x + start).cast("int")


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of all entries of a batch."""
    indices = batch.column("_at")
    row = np.repeat(np.arange(len(batch)), np.diff(indices.offsets.to_numpy()))
    return row, indices.flatten().to_numpy(), batch.column("_val").flatten().to_numpy()


def _scores(row: np.ndarray, at: np.ndarray, val: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((n, weights.shape[1]))
    np.add.at(out, row, val[:, None] * weights[at])
    return out


def gradients(weights: np.ndarray, positive: np.ndarray):
    """mapInArrow over (_at, _val, _y): a row (index, s0...) for each feature that a task met; index -1 has losses, -2 the sums of row weights."""
    targets = weights.shape[1]
    names = ["index", *(f"s{t}" for t in range(targets))]

    def run(batches):
        total, loss, mass = np.zeros_like(weights), np.zeros(targets), np.zeros(targets)
        for batch in batches:
            row, at, val = _sparse(batch)
            y = batch.column("_y").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), targets)
            z = _scores(row, at, val, len(batch), weights)
            w = np.where(np.isnan(y), 0.0, np.where(y > 0, positive, 1.0))  # an unknown label has no weight
            y = np.nan_to_num(y)
            loss += (w * (np.logaddexp(0, z) - y * z)).sum(axis=0)
            mass += w.sum(axis=0)
            np.add.at(total, at, val[:, None] * (w * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y))[row])
        met = np.flatnonzero(total.any(axis=1))
        sums = np.concatenate([total[met], loss[None], mass[None]])
        columns = [pa.array(np.r_[met, -1, -2], pa.int32()), *(pa.array(c) for c in sums.T)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _evaluated(data: DataFrame, weights: np.ndarray, positive: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(mean losses, their gradients) of all targets in one pass; the constant isn't penalised."""
    names = [f"s{t}" for t in range(weights.shape[1])]
    parts = data.mapInArrow(gradients(weights, positive), ", ".join(["index int", *(f"{n} double" for n in names)]))
    sums = parts.groupBy("index").agg(*(F.sum(n).alias(n) for n in names)).toArrow().to_pydict()  # a row for each feature
    rows, index = np.array([sums[n] for n in names]).T, np.array(sums["index"])
    mass = np.maximum(rows[index == -2][0], 1e-12)
    grad = np.zeros_like(weights)
    grad[index[index >= 0]] = rows[index >= 0] / mass
    free = np.vstack([np.zeros((1, weights.shape[1])), weights[1:]])
    return rows[index == -1][0] / mass + ridge / 2 * (free**2).sum(axis=0), grad + ridge * free


def _direction(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction of one target from its last moves (step, change of gradient)."""
    q, kept = grad.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(kept), strict=True):
        q += (a - (y @ q) / (s @ y)) * s
    return -q


@dataclass
class Propensities:
    design: Design
    targets: list[str]
    weights: np.ndarray  # features by targets

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with p_<target> of every model; other columns stay as they are."""
        weights = self.weights

        @F.pandas_udf("array<double>")
        def chances(at: pd.Series, val: pd.Series) -> pd.Series:
            n = at.map(len).to_numpy()
            z = _scores(np.repeat(np.arange(len(n)), n), np.concatenate([*at, []]).astype(int), np.concatenate([*val, []]), len(n), weights)
            return pd.Series(list(1 / (1 + np.exp(-np.clip(z, -500, 500)))))

        at, val = self.design.columns()
        own = "_p" + "_" * max(map(len, rows.columns), default=0)  # longer than any name of the caller's
        out = rows.withColumn(own, chances(at, val))
        return out.select(*rows.columns, *(F.col(own)[i].alias(f"p_{t}") for i, t in enumerate(self.targets)))


def fit_propensities(rows: DataFrame, numeric: list[str], targets: list[str], weights: dict[str, float], multi: dict[str, int] | None = None, rounds: int = 40, ridge: float = 0.01) -> Propensities:
    """Models of the outcome_ targets that have both classes, fitted together.

    multi has the number of ids of each multi-hot column. weights are those of positive rows. A null label counts for
    nothing. A target whose step doesn't lower its loss tries half of it in the next pass; it rests once its gradient is small.
    """
    label = lambda t: F.col(f"outcome_{t}").cast("double")
    both = rows.agg(*(F.struct(F.min(label(t)).alias("lo"), F.max(label(t)).alias("hi")).alias(t) for t in targets)).first()
    kept = [t for t in targets if both[t].lo is not None and both[t].lo < both[t].hi]
    stats = {r.field: (r.fill, r.mean, r.std) for r in impute_stats(rows, numeric).collect()} if numeric else {}  # a row for each number
    design = Design(numeric, multi or {}, stats)
    if design.size * len(targets) > MOST_WEIGHTS:
        raise ValueError(f"{design.size} features of {len(targets)} targets are more than {MOST_WEIGHTS} weights")
    if not kept:
        return Propensities(design, [], np.zeros((design.size, 0)))
    at, val = design.columns()
    labels = F.array(*(F.coalesce(label(t), F.lit(float("nan"))) for t in kept))
    data = cut(rows.select(at.alias("_at"), val.alias("_val"), labels.alias("_y")))
    positive = np.array([weights.get(t, 1.0) for t in kept])
    held = np.zeros((design.size, len(kept)))
    loss, grad = _evaluated(data, held, positive, ridge)
    past: list[list] = [[] for _ in kept]
    way, size = -grad, np.ones(len(kept))
    for _ in range(rounds):
        busy = np.abs(grad).max(axis=0) > 1e-5
        if not busy.any():
            break
        tried = held + np.where(busy, size, 0.0) * way
        new_loss, new_grad = _evaluated(data, tried, positive, ridge)
        for t in np.flatnonzero(busy):
            if new_loss[t] > loss[t] + 1e-4 * size[t] * (grad[:, t] @ way[:, t]):
                size[t] /= 2
                continue
            step, change = tried[:, t] - held[:, t], new_grad[:, t] - grad[:, t]
            if step @ change > 1e-12:
                past[t] = [*past[t], (step, change)][-MEMORY:]
            held[:, t], loss[t], grad[:, t], size[t] = tried[:, t], new_loss[t], new_grad[:, t], 1.0
            way[:, t] = _direction(grad[:, t], past[t])
    return Propensities(design, kept, held)


def predict_propensities(rows: DataFrame, models: Propensities) -> DataFrame:
    """rows with p_<target> of every model."""
    return models.predict(rows)
