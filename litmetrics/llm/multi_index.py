"""Approximate nearest neighbours by multi-index hashing.

Codes: the vectors are centred and turned by a learned rotation (principal axes, then alternating Procrustes steps
towards the nearest corner of the cube); the signs are the code. Mean, rotation and search radius are fitted on at most
`sample` rows (the smallest hashes of the id); every row is indexed.

Index: codes are cut into `parts` substrings, each with an index of its own over a block of at most `block` different
vectors. Two codes within distance r = parts * s + a differ by at most s in one of the first a + 1 substrings or by at
most s - 1 in one of the others (pigeonhole), so probing those neighbourhoods and checking the whole codes finds every
code within r. The floats of what is found are compared in double precision.

The radius is the `coverage` quantile of the code distance between sampled queries and their true neighbours within the
sample; in the whole table true neighbours are nearer still. Where a block holds fewer than k codes within the radius,
the radius grows for that query until it has k or the whole block, so no query comes back short.

Equal vectors are indexed once with their k + 1 smallest ids, which is all that k neighbours can need. Queries meet
the blocks of the index in blocks of at most `queries` rows; each meeting is one task with k rows per query.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components take no part, nor do those
whose length is not the most frequent one (ties: the longer); repeated ids count as rows; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def learn_rotation(x: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation (columns are code directions) of the rows of x."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    projected = centred @ axes
    d = x.shape[1]
    turn = np.linalg.qr(np.random.default_rng(0).standard_normal((d, d)))[0]
    for _ in range(steps):
        corners = np.where(projected @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(projected.T @ corners)
        turn = u @ v
    return mean, axes @ turn


def encode(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray, parts: int) -> np.ndarray:
    """Substring values (rows x parts) of the codes; substrings have equal widths, the last one may be narrower."""
    bits = ((x - mean) @ rotation >= 0).astype(np.int64)
    width = -(-bits.shape[1] // parts)
    return np.stack([bits[:, i * width : (i + 1) * width] @ (1 << np.arange(bits[:, i * width : (i + 1) * width].shape[1])) for i in range(parts)], axis=1)


def masks(width: int, radius: int) -> np.ndarray:
    """All numbers of `width` bits with at most `radius` ones."""
    if radius < 0:
        return np.zeros(0, np.int64)
    return np.array([sum(1 << b for b in c) for n in range(min(radius, width) + 1) for c in combinations(range(width), n)], np.int64)


class MultiIndex:
    """One index per substring over the codes of a block."""

    def __init__(self, codes: np.ndarray, width: int):
        self.codes, self.width = codes, width
        self.order = [np.argsort(codes[:, i], kind="stable") for i in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, i], np.arange((1 << width) + 1)) for i, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose code is within the radius."""
        parts = len(code)
        s, a = divmod(radius, parts)
        found = np.zeros(len(self.codes), bool)
        for i in range(parts):
            probes = masks(self.width, s if i <= a else s - 1) ^ code[i]
            begin, end = self.starts[i][probes], self.starts[i][probes + 1]
            size = end - begin
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            found[self.order[i][at]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def _sound(column: str):
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def fit(vectors: DataFrame, sample: int, parts: int, k: int, coverage: float) -> tuple[np.ndarray, np.ndarray, int] | None:
    rows = vectors.groupBy("_vector").agg(F.min("_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_vector").toPandas()
    if not len(rows):
        return None
    x = np.stack(rows["_vector"].to_numpy()).astype(np.float64)
    mean, rotation = learn_rotation(x)
    codes = encode(x, mean, rotation, parts)
    distances = []
    for i in range(0, min(len(x), 512)):
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        near = np.argsort(far, kind="stable")[: min(k, len(x) - 1)]
        distances += np.bitwise_count(codes[near] ^ codes[i]).sum(axis=1).tolist()
    radius = int(np.quantile(distances, coverage)) if distances else 0
    return mean, rotation, radius


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", query_every: int = 100, k: int = 10, parts: int = 8, sample: int = 4096, coverage: float = 0.99, block: int = 8192, queries: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found rows of every row whose key is divisible by query_every."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_vector")).filter("_id is not null")
    rows = rows.filter(_sound("_vector"))
    dims = rows.groupBy(F.size("_vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dims is None:
        return empty
    d = dims["d"]
    rows = rows.filter(F.size("_vector") == d)
    nth = F.row_number().over(Window.partitionBy("_vector").orderBy("_id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)  # the limit reaches the map side
    kinds = materialise(few.groupBy("_vector").agg(F.sort_array(F.collect_list("_id")).alias("ids")), "vectors")
    asked = materialise(rows.filter(F.col("_id") % query_every == 0), "queries")
    n, q = kinds.count(), asked.count()
    model = fit(kinds.select("_vector", F.col("ids")[0].alias("_id")), sample, parts, k, coverage)
    if model is None or not q:
        return empty
    blocks, shares = max(1, -(-n // block)), max(1, -(-q // queries))
    shared = df.sparkSession.sparkContext.broadcast(model)  # d x d numbers
    width = -(-d // parts)
    left = kinds.select(F.pmod(F.xxhash64("_vector"), F.lit(blocks)).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"), "_vector", "ids")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"), F.pmod(F.xxhash64("_id"), F.lit(shares)).cast("int").alias("_share"), F.col("_id").alias("query_id"), "_vector")

    def work(index: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(index) and len(ask):
            mean, rotation, radius = shared.value
            x, y = np.stack(index["_vector"].to_numpy()).astype(np.float64), np.stack(ask["_vector"].to_numpy()).astype(np.float64)
            ids = index["ids"].tolist()
            table = MultiIndex(encode(x, mean, rotation, parts), width)
            for name, v, code in zip(ask["query_id"], y, encode(y, mean, rotation, parts), strict=True):
                r, most = radius, table.codes.shape[1] * width
                while True:
                    found = table.within(code, r)
                    if len(found) > k or len(found) == len(x) or r >= most:
                        break
                    r += parts
                far = np.sqrt(((x[found] - v) ** 2).sum(axis=1))
                limit = np.partition(far, k)[k] if len(far) > k + 1 else np.inf
                best = sorted((f, int(i)) for f, p in zip(far, found, strict=True) if f <= limit for i in ids[p] if i != name)[:k]
                out["query_id"] += [name] * len(best)
                out["vec_id"] += [i for _, i in best]
                out["score"] += [float(f) for f, _ in best]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("_block", "_share").cogroup(right.groupBy("_block", "_share")).applyInPandas(work, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
