"""Centroid clustering of integer vectors with Hamerly bounds.

Every component x becomes the integer floor(scale * x), so all distances are exact integers and ties are real ties. Each
vector carries one upper bound on the distance to its own centroid and one lower bound on the distance to the second
nearest, as columns of its row: the state of a round is written and the next round reads it, so nothing is joined and no
vector is shuffled. When centroids have moved, the upper bound grows by the own centroid's drift and the lower one
shrinks by the largest drift of the others. A vector whose upper bound stays below its lower bound (or below half the way
from its centroid to the next one) keeps its cluster unseen. Otherwise its own distance is measured, and if that does
not settle it either, the vector is ambiguous and gets an exact integer scan of all centroids. Bounds are doubles, loosened
by more than their rounding error, so they only ever cause a scan too many.

New centroids are sums by cluster and component; the driver sees k rows a round (k and the width are parameters).

Defined results: vectors of another width, or null, or holding null or non-finite components take no part; nor do those
with a scaled component over 2^27 in absolute value, whose squared distances a long may not hold. Rows with repeated
ids are vectors of their own; null ids are hashed as empty; among vectors with one hash those with smaller components
seed first. With fewer than k vectors there is a centroid for each. Inertias beyond a long are null. Further columns do
not matter, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, releasing

LIMIT = 1 << 27  # 64 squares of twice this are under 2^63
SLACK = 1e-12  # relative; a hundred times what a few double operations lose
BLOCK = 4096  # vectors scanned at once
FAR = 1.7e308


def integers(vector: Column, width: int, scale: int) -> Column:
    """floor(scale * x) of each component as longs; null unless the vector takes part."""
    whole = F.transform(vector.cast("array<double>"), lambda x: F.when(F.abs(x) <= F.lit(FAR), F.floor(x * F.lit(float(scale)))))
    # an infinite component is over FAR, NaN is larger than all: both become null
    fine = (F.size(vector) == width) & F.forall(whole, lambda x: F.coalesce(F.abs(x) <= LIMIT, F.lit(False)))
    return F.when(F.coalesce(fine, F.lit(False)), whole.cast("array<int>"))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, centroids)."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals), the distance to it and to the second nearest."""
    d = squared(x, centroids)
    best = d.argmin(axis=1)
    rows = np.arange(len(x))
    first = d[rows, best]
    if len(centroids) == 1:
        return best, np.sqrt(first.astype(float)), np.full(len(x), np.inf)
    d[rows, best] = np.iinfo(np.int64).max
    return best, np.sqrt(first.astype(float)), np.sqrt(d.min(axis=1).astype(float))


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bounds after the centroids have moved from `before`, and which vectors were scanned."""
    moved = centroids - before
    drift = np.sqrt((moved * moved).sum(axis=1).astype(float)) * (1 + SLACK)
    others = np.array([np.delete(drift, j).max(initial=0.0) for j in range(len(drift))])
    apart = squared(centroids, centroids).astype(float)
    np.fill_diagonal(apart, np.inf)
    half = np.sqrt(apart.min(axis=1)) / 2 * (1 - SLACK)
    cluster, upper = cluster.copy(), (upper + drift[cluster]) * (1 + SLACK)
    lower = np.maximum((lower - others[cluster]) * (1 - SLACK), 0.0)
    scanned = np.zeros(len(x), bool)
    for a in range(0, len(x), BLOCK):
        at = a + np.flatnonzero(~(upper[a : a + BLOCK] < np.maximum(lower[a : a + BLOCK], half[cluster[a : a + BLOCK]])))
        own = x[at] - centroids[cluster[at]]
        upper[at] = np.sqrt(np.einsum("ij,ij->i", own, own).astype(float)) * (1 + SLACK)
        at = at[~(upper[at] < np.maximum(lower[at], half[cluster[at]]))]
        if len(at):
            cluster[at], upper[at], lower[at] = scan(x[at], centroids)
            scanned[at] = True
    return cluster, upper, lower, scanned


def _rounds(centroids: np.ndarray, before: np.ndarray | None, last: bool):
    made = ("cluster", "upper", "lower", "scans", "distance")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, centroids.shape[1]).astype(np.int64)
            if before is None:
                parts = [scan(x[a : a + BLOCK], centroids) for a in range(0, len(x), BLOCK)] or [scan(x, centroids)]
                cluster, upper, lower = (np.concatenate(p) for p in zip(*parts, strict=True))
                scans = np.ones(len(x), np.int32)
            else:
                old = [batch.column(c).to_numpy(zero_copy_only=False) for c in made[:4]]
                cluster, upper, lower, scanned = reassign(x, old[0].astype(np.int64), old[1], old[2], before, centroids)
                scans = old[3] + scanned.astype(np.int32)
            own = x - centroids[cluster] if last else x[:0]
            distance = pa.array(np.einsum("ij,ij->i", own, own)) if last else pa.nulls(len(x), pa.int64())
            columns = [pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scans.astype(np.int32)), distance]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_x"), *columns], names=["_row", "_x", *made])

    return work


def cluster_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1, carry: list[str] | None = None) -> DataFrame:
    """df's vectors that take part as _row (a struct of the columns `carry`, all by default) with cluster, distance
    (squared), cluster_inertia, inertia, centroid_sha256 and scans (how many rounds have measured all distances)."""
    col = lambda c: F.col(f"`{c}`")
    picked = df.select(F.struct(*[col(c) for c in carry or df.columns]).alias("_row"), col(key).cast("string").alias("_key"), integers(col(vector), width, scale).alias("_x"))
    vectors = materialise(picked.filter("_x is not null"), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("_key", F.lit(""))), 256)
    centroids = np.array([r._x for r in vectors.orderBy(order, "_x").limit(k).select("_x").collect()], np.int64).reshape(-1, width)
    fields = [*vectors.select("_row", "_x").schema, *T.StructType.fromDDL("cluster int, upper double, lower double, scans int, distance long")]
    schema = T.StructType(fields)
    state, before = vectors.drop("_key"), None
    for nth in range(rounds + 1 if len(centroids) else 0):
        moved = materialise(state.mapInArrow(releasing(_rounds(centroids, before, nth == rounds)), schema), "clusters")
        discard(state if nth else vectors)
        state = moved
        if nth < rounds:
            sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("_x", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(width)]).collect()
            before, centroids = centroids, centroids.copy()
            for r in sums:
                centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(width)]
    if not len(centroids):
        state = state.select("_row", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("scans", "int"))])
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = [(r["cluster"], r["inertia"]) for r in state.groupBy("cluster").agg(exact.alias("inertia")).collect()]  # k rows
    total = sum(int(w or 0) for _, w in per)
    held = lambda v: v if v < 1 << 63 else None
    table = [(c, held(int(w)), held(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, w in per]
    facts = df.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select("_row", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
