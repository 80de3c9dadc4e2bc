"""Centroid clustering against a plain loop over all centroids."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmetrics.llm import hamerly


def plain(rows, k=16, rounds=3, width=64, scale=64):
    """(id, cluster, distance), inertia by cluster and digests of centroids, from (id, vector) rows, in plain Python."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(x)) for x in v]))
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in seeds]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    return out, [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]


def found(df, **options):
    return [(r._row.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in hamerly.cluster_vectors(df, **options).collect()]


def expected(rows, **options):
    out, digests = plain(rows, **options)
    per = {}
    for _, c, d in out:
        per[c] = per.get(c, 0) + d
    return [(i, c, d, per[c], sum(per.values()), digests[c]) for i, c, d in out]


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_whole_table_agrees_with_a_plain_loop(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert key(found(df)) == key(expected(rows))


@pytest.mark.parametrize("spread", [0.0, 0.05, 0.4])
def test_ties_repeats_and_clumps(spark, spread):
    rng = np.random.default_rng(7)
    middles = rng.integers(-2, 3, (5, 8)) / 4
    rows = [(int(i % 150), [float(x) for x in middles[i % 5] + spread * rng.standard_normal(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert key(found(df, k=6, width=8)) == key(expected(rows, k=6, width=8))


def test_what_takes_no_part(spark):
    fine = [0.5, -0.5]
    rows = [(1, fine), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, []), (None, [0.25, 0.25]), (1, fine), (8, [-0.0, 0.015])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"a.b": F.lit(1), "cluster": F.lit("x"), "_x": F.lit(2)})
    got = found(df, k=3, width=2)
    assert key(got) == key(expected(rows, k=3, width=2))
    assert len(got) == 4


def test_too_large_components_and_empty_tables(spark):
    rows = [(1, [1e300, 0.0]), (2, [3e6, 0.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r[0] for r in found(df, k=2, width=2)] == [3]
    assert found(df.limit(0), k=2, width=2) == []
    assert found(df.select("vec_id", F.lit(None).cast("array<double>").alias("embedding")), k=2, width=2) == []


def test_bounds_spare_scans_and_stay_right():
    rng = np.random.default_rng(3)
    middles = rng.integers(-60, 61, (6, 16))
    x = np.concatenate([m + rng.integers(-9, 10, (500, 16)) for m in middles]).astype(np.int64)
    centroids = middles.astype(np.int64) + rng.integers(-3, 4, middles.shape)
    cluster, upper, lower = hamerly.scan(x, centroids)
    scans = 0
    for _ in range(4):
        before, centroids = centroids, np.array([x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) for j in range(6)])
        cluster, upper, lower, scanned = hamerly.reassign(x, cluster, upper, lower, before, centroids)
        scans += int(scanned.sum())
        d = hamerly.squared(x, centroids)
        assert (cluster == d.argmin(axis=1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(x)), cluster])).all()
        d[np.arange(len(x)), cluster] = np.iinfo(np.int64).max
        assert (lower <= np.sqrt(d.min(axis=1))).all()
    assert scans < len(x) / 10  # of 4 * len(x)
