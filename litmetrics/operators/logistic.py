"""Weighted logistic regressions of all training sets and strengths of a cross-validation at once.

A table (fold, features, y, w) has k + 1 training sets: set i < k leaves out the rows of fold i, set k takes all. Rows
whose fold is negative are fixed: they are in every set with the weight they have, while the weights of the other rows
are scaled to mean 1 within each set. Features are standardized by the set's own unweighted means and deviations.
In place of `fold` a row may hold `folds`, an array with a fold for each of several jobs, each with its own k + 1 sets, and
`free` (false: fixed): OUT says that the row takes no part in a job, k that it is in all of the job's sets.

Rows that agree in features, y, w and free differ only in the sets that hold them. `patterns` makes them one row with `times`,
how often each set holds it, and `gathered` one of those of all batches, so the passes below grow with the different rows and
not with all; both forms are taken.

Every step of Newton's method is one pass for all sets and strengths: a task adds up the gradient and the second
derivatives of its rows, the tasks' sums are added by set (of many tasks first in SALT shares), and only the totals reach
the driver, which are jobs * (k + 1) * len(grid) * (features + 1) ** 2 numbers whatever the number of rows. A step that
makes the loss larger is halved.

Defined results: a constant feature keeps scale 1; a set with one class only tends to that class; no rows give
coefficients of 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, TOLERANCE, RIDGE = 100, 1e-9, 1e-10
LOW, HIGH = 5, 95  # per cent: the thresholds tried

OUT, SALT = -1, 64
ROWS = 4096  # patterns of a task: a few are not worth many

Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # times by set, whether free, features, y, w


@dataclass
class Fits:
    """mean, scale: (set, feature); beta: (set, strength, feature + 1), the intercept last."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _folds_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Folds by job, and whether the rows are free."""
    if "fold" in batch.schema.names:
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        return np.where(fold < 0, np.iinfo(np.int32).max, fold)[:, None], fold >= 0
    return _matrix(batch, "folds"), batch.column("free").to_numpy(zero_copy_only=False)


def _times(folds: np.ndarray, at: np.ndarray, many: int, k: int) -> np.ndarray:
    """How often each of the job's sets holds each of `many` patterns; at: the pattern of each row."""
    out = np.zeros((many, folds.shape[1], k + 1), np.int32)
    for job, fold in enumerate(folds.T):
        out[:, job] = np.bincount(at[fold != OUT], minlength=many)[:, None]
        held = (fold != OUT) & (fold < k)
        out[:, job, :k] -= np.bincount(at[held] * k + fold[held], minlength=many * k).reshape(many, k)
    return out.reshape(many, -1)


def _rows_of(batch: pa.RecordBatch, k: int) -> Rows:
    y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
    if "times" in batch.schema.names:
        times, free = _matrix(batch, "times"), batch.column("free").to_numpy(zero_copy_only=False)
    else:
        folds, free = _folds_of(batch)
        times = _times(folds, np.arange(batch.num_rows), batch.num_rows, k)
    return times.astype(float), free, _matrix(batch, "features"), y, w


def _unified(free: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, times_of: Callable[[np.ndarray, int], np.ndarray]) -> pa.RecordBatch:
    """Equal rows as one; times_of: of the pattern of each row and the number of patterns, how often each set holds each."""

    def lists(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    whole = np.ascontiguousarray(np.column_stack([free, y, w, x]), np.float64)
    _, first, at = np.unique(whole.view(f"V{whole.strides[0]}").ravel(), return_index=True, return_inverse=True)
    columns = [pa.array(free[first]), lists(x[first]), pa.array(y[first]), pa.array(w[first]), lists(times_of(at, len(first)))]
    return pa.RecordBatch.from_arrays(columns, names=["free", "features", "y", "w", "times"])


SAME, PATTERNS = ["free", "features", "y", "w"], "free boolean, features array<double>, y double, w double, times array<int>"


def patterns(rows: DataFrame, k: int) -> DataFrame:
    """(free, features, y, w, times): equal rows of an Arrow batch as one. What batches share `gathered` brings together;
    a batch of different rows keeps them all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                folds, free = _folds_of(batch)
                y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
                yield _unified(free, _matrix(batch, "features"), y, w, lambda at, many, folds=folds: _times(folds, at, many, k))

    return rows.mapInArrow(work, PATTERNS)


def gathered(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Cached patterns in few partitions, the width of their features and the number of partitions. Patterns that many
    batches share meet by a shuffle, so that what a fit goes over grows with the different rows; where most occur once, as
    rows with an embedding do, they stay where they are."""
    facts = [F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*SAME)).alias("different"), F.coalesce(F.max(F.size("features")), F.lit(0)).alias("width")]
    size = rows.agg(*facts).first()
    if size.n < 2 * size.different:
        tasks = 1 + size.n // ROWS
        return rows.coalesce(tasks), size.width, tasks

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                times = _matrix(batch, "times")

                def added(at: np.ndarray, many: int, times: np.ndarray = times) -> np.ndarray:
                    out = np.zeros((many, times.shape[1]), np.int32)
                    np.add.at(out, at, times)
                    return out

                free, y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("free", "y", "w"))
                yield _unified(free, _matrix(batch, "features"), y, w, added)

    tasks = 1 + size.different // ROWS
    # sorted, so that of a pattern only what lies about the end of a batch is left in two rows
    return rows.repartition(tasks, *SAME).sortWithinPartitions(*SAME).mapInArrow(work, PATTERNS).cache(), size.width, tasks


def _added(rows: DataFrame, k: int, sums_of: Callable[[Rows], np.ndarray], shape: tuple[int, ...], tasks: int = 1) -> np.ndarray:
    """The sum of sums_of over all rows: an array of that shape, added up in every task first and then by its first index."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += sums_of(_rows_of(batch, k))
        salt = pa.array([TaskContext.get().partitionId() % SALT] * shape[0], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), salt, pa.array(list(total.reshape(shape[0], -1)), pa.list_(pa.float64()))], names=["at", "salt", "sums"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": part["at"].iloc[:1], "salt": part["salt"].iloc[:1], "sums": [reduce(np.add, part["sums"])]})

    out, schema = np.zeros((shape[0], int(np.prod(shape[1:])))), "at int, salt int, sums array<double>"
    sums = rows.mapInArrow(work, schema)
    if tasks > SALT:
        sums = sums.groupBy("at", "salt").applyInPandas(add, schema)
    for at, _, values in (sums.groupBy("at").applyInPandas(add, schema) if tasks > 1 else sums).collect():
        out[at] += values
    return out.reshape(shape)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit_all(rows: DataFrame, k: int, grid: tuple[float, ...], width: int, jobs: int = 1, tasks: int = 2) -> Fits:
    """rows (fold or folds and free, features, y, w) or their patterns, features of that width, in about so many tasks. The loss of a set is the weighted log loss + |coefficients|^2 / (2 c)."""
    sets, many, d = jobs * (k + 1), len(grid), width

    def first(data: Rows) -> np.ndarray:
        times, free, x, _, w = data
        return np.column_stack([times.sum(axis=0), times[free].sum(axis=0), times[free].T @ w[free], times.T @ x])

    moments = _added(rows, k, first, (sets, 3 + d), tasks)
    n = np.maximum(moments[:, 0], 1)
    mean = moments[:, 3:] / n[:, None]

    def second(data: Rows) -> np.ndarray:
        times, _, x, _, _ = data
        return np.stack([times[:, i] @ (x - mean[i]) ** 2 for i in range(sets)])

    scale = np.sqrt(_added(rows, k, second, (sets, d), tasks) / n[:, None])
    scale[scale <= 1e-12 * np.maximum(1, np.abs(mean))] = 1
    unit = np.where(moments[:, 2] > 0, moments[:, 2] / np.maximum(moments[:, 1], 1), 1.0)  # the mean weight

    here = np.zeros((sets, many, d + 1))  # the best place so far
    step = np.zeros_like(here)
    best = np.full((sets, many), np.inf)
    busy = np.ones((sets, many), bool)
    penalty = np.array([[1 / c] * d + [0] for c in grid])
    q = d + 1
    for _ in range(STEPS):
        place, active = here + step, busy.copy()

        def derivatives(data: Rows, place: np.ndarray = place, active: np.ndarray = active) -> np.ndarray:
            times, free, x, y, w = data
            out = np.zeros((sets, many, 2 + q + q * q))
            for i in range(sets):
                if not active[i].any():
                    continue
                own = times[:, i] > 0
                xs = np.hstack([(x[own] - mean[i]) / scale[i], np.ones((own.sum(), 1))])
                ws = times[own, i] * np.where(free[own], w[own] / unit[i], w[own])
                for c in np.flatnonzero(active[i]):
                    z = xs @ place[i, c]
                    p = _sigmoid(z)
                    loss = ws @ (np.logaddexp(0, z) - y[own] * z)
                    half = xs * np.sqrt(ws * p * (1 - p))[:, None]  # a product with itself takes half the steps
                    out[i, c, 0], out[i, c, 1], out[i, c, 2 : 2 + q] = loss, ws.sum(), xs.T @ (ws * (p - y[own]))
                    out[i, c, 2 + q :] = (half.T @ half).ravel()
            return out

        sums = _added(rows, k, derivatives, (sets, many, 2 + q + q * q), tasks)
        for i, c in zip(*np.nonzero(active), strict=True):
            loss = sums[i, c, 0] + (penalty[c] * place[i, c] ** 2).sum() / 2
            if loss > best[i, c] + 1e-12 * abs(best[i, c]):
                step[i, c] /= 2
                busy[i, c] = np.abs(step[i, c]).max() > 1e-12
                continue
            here[i, c], best[i, c] = place[i, c], loss
            slope = sums[i, c, 2 : 2 + q] + penalty[c] * here[i, c]
            bend = sums[i, c, 2 + q :].reshape(q, q) + np.diag(penalty[c] + RIDGE)
            busy[i, c] = np.abs(slope).max() > TOLERANCE * max(sums[i, c, 1], 1e-300)
            step[i, c] = -np.linalg.solve(bend, slope)
            if busy[i, c] and -(slope @ step[i, c]) / 2 <= 1e-12 * abs(loss):
                # the loss can no longer tell whether this last step is one: close to the end it is
                here[i, c] += step[i, c]
                busy[i, c] = False
        step[~busy] = 0
        if not busy.any():
            break
    return Fits(mean, scale, here)


def thresholds(rows: DataFrame, fits: Fits, k: int, jobs: int = 1, tasks: int = 2) -> list[tuple[float, float]]:
    """For each job and strength the largest weighted F1 of the free rows, each scored by the set that leaves it out, and the first threshold that has it."""
    many, bins = fits.beta.shape[1], HIGH - LOW + 2

    def reached(data: Rows) -> np.ndarray:
        times, free, x, y, w = data
        out = np.zeros((jobs, many, 2, bins))
        for job in range(jobs):
            for i in range(k):
                at = job * (k + 1) + i
                held = times[:, job * (k + 1) + k] - times[:, at]
                own = free & (held > 0)
                ws = held[own] * w[own]
                xs = (x[own] - fits.mean[at]) / fits.scale[at]
                for c in range(many):
                    score = _sigmoid(xs @ fits.beta[at, c, :-1] + fits.beta[at, c, -1])
                    bin_of = np.clip(np.floor(score * 100 + 1e-9), LOW - 1, HIGH).astype(int) - (LOW - 1)
                    out[job, c, 0] += np.bincount(bin_of, ws * (y[own] == 1), bins)
                    out[job, c, 1] += np.bincount(bin_of, ws, bins)
        return out

    found = []
    for pos, every in _added(rows, k, reached, (jobs, many, 2, bins), tasks).reshape(jobs * many, 2, bins):
        hit, flagged = (np.cumsum(v[::-1])[::-1][1:] for v in (pos, every))
        precision, recall = hit / np.maximum(flagged, 1e-12), hit / max(pos.sum(), 1e-12)
        f1 = np.where(precision + recall == 0, 0.0, 2 * precision * recall / np.maximum(precision + recall, 1e-300))
        best = int(np.argmax(f1))
        found.append((float(f1[best]), (LOW + best) / 100))
    return found
