"""A linear support vector machine with squared hinge loss on sparse rows, by a trust-region Newton method.

The loss is |w|^2 / 2 + c * sum of max(0, 1 - s m)^2, where m = w x, s = 1 for label 1 and -1 for label 0, and a component of
1 (number 0) stands in every row for the intercept, which is so regularised like the others. Newton steps are found by
conjugate gradients inside a trust region; they need only products of the second derivatives with a vector. A value, a
slope or a product is one pass: each task adds up what its rows contribute to each component, Spark adds up by ranges of
components, which go as bytes, and the driver receives a number for each component, however many rows there are.

`solve` finds the same weights where there are far more components than rows: they are a sum of rows, so a number for each row
states them, and all it asks for is the product of the rows' inner products with such numbers, one pass over the postings of
the components. Losses and slopes follow from products it has. After each pass it goes to the least loss among all sums of the
slopes it keeps, so what is learnt of the curvature outlives a change of the rows that count.

Defined results: rows without components have the intercept alone; a single class tends to that class; no rows give zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, INNER, TOLERANCE = 100, 200, 1e-6
ROWS = 4096  # of a task: a few labelled texts are not worth many
RANGE = 1 << 15  # components that are sent and added up together
KEPT, NUMBERS = 40, 1 << 24  # slopes that solve keeps at most, and the numbers they may take together


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a batch, numbers as bytes: every pass reads them as they are."""
    for batch in batches:
        if batch.num_rows:
            lists = [batch.column(n) for n in ("at", "value")]
            sizes = np.diff(lists[0].offsets.to_numpy(zero_copy_only=False)).astype(np.int32)
            side = 2.0 * batch.column("y").to_numpy(zero_copy_only=False) - 1
            arrays = [sizes, *(x.flatten().to_numpy(zero_copy_only=False) for x in lists), side]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=["sizes", "at", "value", "side"])


def parts(start: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(at, sums): total in ranges, from place `start` on, without those of zeros alone."""
    for nth in range(0, len(total), RANGE):
        own = total[nth : nth + RANGE]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([start + nth], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["at", "sums"])


def added(sums: DataFrame, size: int, tasks: int) -> np.ndarray:
    """The parts of all tasks added up; what is much is first added by range."""
    out = np.zeros(size)
    for at, part in (sums.groupBy("at").applyInPandas(_sum_of_range, "at int, sums binary") if tasks * size > NUMBERS // 16 else sums).collect():
        values = np.frombuffer(part)
        out[at : at + len(values)] += values
    return out


def _sum_of_range(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"at": part["at"].iloc[:1], "sums": [reduce(np.add, map(np.frombuffer, part["sums"])).tobytes()]})


def _passes(rows: DataFrame, width: int, c: float, tasks: int):
    """Functions for the loss with its slope at w, and for the product of the second derivatives at w with v; rows are packed."""
    spark = rows.sparkSession

    def summed(vectors: tuple[np.ndarray, ...]) -> tuple[float, np.ndarray]:
        held = spark.sparkContext.broadcast(vectors)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, *other = held.value
            total, loss = np.zeros(width), 0.0
            for batch in batches:
                for nth in range(batch.num_rows):
                    sizes, at, value, side = (np.frombuffer(batch.column(n)[nth].as_buffer(), t) for n, t in (("sizes", np.int32), ("at", np.int32), ("value", float), ("side", float)))
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    dot = lambda u: np.bincount(row, value * u[at], len(sizes)) + u[0]  # noqa: B023, E731
                    margin = side * dot(w)
                    active = margin < 1
                    loss += float(((1 - margin[active]) ** 2).sum())
                    share = 2 * c * active * (dot(other[0]) if other else side * (margin - 1))
                    total += np.bincount(at, value * share[row], width)
                    total[0] += share.sum()
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.array([loss]).tobytes()], pa.binary())], names=["at", "sums"])
            for start in range(0, width, RANGE):
                own = total[start : start + RANGE]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([start], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["at", "sums"])

        schema = "at int, sums binary"
        sums = rows.mapInArrow(work, schema)
        out, loss = np.zeros(width), 0.0
        for at, part in (sums.groupBy("at").applyInPandas(_sum_of_range, schema) if tasks > 1 else sums).collect():
            values = np.frombuffer(part)
            if at < 0:
                loss += float(values[0])
            else:
                out[at : at + len(values)] += values
        held.destroy()
        return loss, out

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope = summed((w,))
        return float(w @ w) / 2 + c * loss, w + slope

    def bend(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v + summed((w, v))[1]

    return value, bend


def _to_edge(s: np.ndarray, d: np.ndarray, radius: float) -> float:
    """How far from s along d the sphere of that radius is."""
    dd, sd = float(d @ d), float(s @ d)
    return (-sd + (sd * sd + dd * (radius * radius - float(s @ s))) ** 0.5) / dd


def minimise(value, bend, width: int, steps: int = STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Where a convex function is least: value(w) gives it and its slope, bend(w, v) its second derivatives times v."""
    w = np.zeros(width)
    f, g = value(w)
    goal = tolerance * max(np.linalg.norm(g), 1e-300)
    radius = np.linalg.norm(g)
    for _ in range(steps):
        if np.linalg.norm(g) <= goal:
            break
        # the step that the quadratic model likes best inside the region
        s, r = np.zeros(width), -g
        d, rr = r.copy(), float(r @ r)
        for _ in range(INNER):
            if rr**0.5 <= 0.1 * np.linalg.norm(g):
                break
            hd = bend(w, d)
            along = rr / float(d @ hd)
            if np.linalg.norm(s + along * d) >= radius:
                along = _to_edge(s, d, radius)
                s, r = s + along * d, r - along * hd
                break
            s, r = s + along * d, r - along * hd
            rr, before = float(r @ r), rr
            d = r + rr / before * d
        expected = (float(s @ r) - float(s @ g)) / 2
        f_new, g_new = value(w + s)
        got = (f - f_new) / expected if expected > 0 else 0.0
        # trust what has proved true
        size = np.linalg.norm(s)
        radius = size / 4 if got < 0.25 else max(radius, 2.5 * size) if got > 0.75 else radius
        if got > 1e-4:
            w, f, g = w + s, f_new, g_new
        elif size <= 1e-12 * max(1.0, np.linalg.norm(w)):
            break
    return w


def fit(rows: DataFrame, width: int, c: float = 1.0) -> np.ndarray:
    """Weights of the components 0 (the intercept) to width - 1 for rows (at array<int>, value array<double>, y 0 or 1)."""
    kept = rows.select(F.col("at").cast("array<int>").alias("at"), F.col("value").cast("array<double>").alias("value"), F.col("y").cast("double").alias("y")).cache()
    n = kept.count()
    tasks = 1 + n // ROWS
    packed = kept.coalesce(tasks).mapInArrow(_packed, "sizes binary, at binary, value binary, side binary").cache()
    packed.count()
    kept.unpersist()
    out = minimise(*_passes(packed, width, c, tasks), width) if n else np.zeros(width)
    packed.unpersist()
    return out


def _least(gram: np.ndarray, margins: np.ndarray, pos: np.ndarray, neg: np.ndarray, z: np.ndarray, goal: float) -> np.ndarray:
    """Where z gram z / 2 + the losses at z margins is least, by Newton's method from z on."""
    def loss(z):
        m = z @ margins
        return z @ gram @ z / 2 + pos @ np.maximum(0, 1 - m) ** 2 + neg @ np.maximum(0, 1 + m) ** 2, m

    f, m = loss(z)
    for _ in range(STEPS):
        slope = gram @ z - margins @ _pull(m, pos, neg)
        if np.linalg.norm(slope) <= goal:
            break
        bend = 2 * (pos * (m < 1) + neg * (m > -1))
        on = np.flatnonzero(bend)
        own = margins[:, on]
        step = np.linalg.lstsq(gram + (own * bend[on]) @ own.T, -slope, rcond=None)[0]
        size, (f_new, m_new) = 1.0, loss(z + step)
        while f_new > f + 1e-4 * size * float(slope @ step) and size > 1e-8:
            size /= 2
            f_new, m_new = loss(z + size * step)
        if f_new >= f:
            break
        z, f, m = z + size * step, f_new, m_new
    return z


def _pull(m: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    return 2 * (pos * np.maximum(0, 1 - m) - neg * np.maximum(0, 1 + m))


def solve(product, pos: np.ndarray, neg: np.ndarray, kept: int | None = None, steps: int = 1000, tolerance: float = TOLERANCE) -> np.ndarray:
    """The numbers of the rows whose sum are the weights; product(a) are the inner products of all rows with such a sum.

    pos and neg: what a row's loss counts as one of label 1 and of label 0.
    """
    n = len(pos)
    kept = kept or max(8, min(KEPT, NUMBERS // max(1, n)))
    sums, margins = np.zeros((kept, n)), np.zeros((kept, n))
    a, m, used, goal = np.zeros(n), np.zeros(n), 0, 0.0
    z = np.zeros(0)
    for _ in range(steps):
        slope = a - _pull(m, pos, neg)
        along = product(slope)
        size = max(float(slope @ along), 0.0) ** 0.5
        goal = goal or tolerance * size
        if size <= goal:
            break
        if used == kept:  # where it is and the later half stay
            half = kept // 2
            length = float(a @ m) ** 0.5
            for held, own in ((sums, a), (margins, m)):
                held[1 : 1 + half] = held[kept - half :].copy()
                held[0] = own / length
            used, z = 1 + half, np.array([length, *[0.0] * half])
        sums[used], margins[used] = slope / size, along / size
        used += 1
        z = _least(sums[:used] @ margins[:used].T, margins[:used], pos, neg, np.append(z, 0.0), 0.1 * goal)
        a, m = z @ sums[:used], z @ margins[:used]
    return a
