"""The fits of the learned hybrid against independent solutions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmetrics.operators import hybrid, logistic, metrics

GRID = (0.01, 0.1, 1.0)


def noisy(n: int, seed: int, fixed: bool = False):
    """Rows (fold or id, features, y, w) with two useful features, one constant and one rare; classes overlap."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(3, 5, n), rng.normal(0, 0.1, n), np.full(n, 7.1), (rng.random(n) < 0.05) * 1.0])
    y = (x[:, 0] / 5 + 6 * x[:, 1] + rng.normal(0, 0.7, n) > 0.8).astype(float)
    w = rng.choice([0.5, 1.0, 4.0], n)
    return [(-1 if fixed else i, r.tolist(), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, w, strict=True))]


def reference(train, c):
    """Means, scales and coefficients (the intercept last) by plain gradient descent on rows (features, y, w)."""
    x, y, w = (np.array(v, float) for v in zip(*[(r.features, r.y, r.w) for r in train.collect()], strict=True))
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    xs = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty = np.array([1 / c] * x.shape[1] + [0])
    pace = 1 / (np.linalg.eigvalsh(xs.T @ (xs * w[:, None])).max() / 4 + 1 / c)
    beta = np.zeros(xs.shape[1])
    for _ in range(20_000):
        beta -= pace * (xs.T @ (w * (1 / (1 + np.exp(-xs @ beta)) - y)) + penalty * beta)
    return mean, scale, beta


def scores(df, mean, scale, beta):
    """id -> probability."""
    return {r.id: 1 / (1 + math.exp(-(np.array(r.features) - mean) / scale @ beta[:-1] - beta[-1])) for r in df.collect()}


def test_sets_and_strengths_against_single_fits(spark):
    free = [(i % 3, *r) for i, *r in noisy(240, 1)]
    rows = spark.createDataFrame(free + noisy(30, 2, fixed=True), "fold int, features array<double>, y double, w double").repartition(3).cache()
    fits = logistic.fit_all(rows, 3, GRID, 4)
    for i in (0, 2, 3):
        own = rows.filter(F.col("fold") != i)
        unit = own.filter("fold >= 0").agg(F.avg("w")).first()[0]
        train = own.withColumn("w", F.when(F.col("fold") >= 0, F.col("w") / unit).otherwise(F.col("w")))
        for at, c in enumerate(GRID):
            mean, scale, beta = reference(train, c)
            assert fits.mean[i].tolist() == pytest.approx(mean.tolist()) and fits.scale[i].tolist() == pytest.approx(scale.tolist())
            assert [*fits.beta[i, at]] == pytest.approx([*beta], abs=1e-6)


def test_choice_against_a_sweep_of_each_strength(spark):
    df = spark.createDataFrame(noisy(200, 3), "id int, features array<double>, y double, w double").withColumn("stratum", F.lit("s")).cache()
    got = hybrid.fit_selected(df, "id", "stratum", k=4)
    folds = hybrid.folds(df, ["stratum", "y"], "id", 4, 42).cache()
    tried = []
    for c in GRID:
        scored = []
        for i in range(4):
            train, held = folds.filter(F.col("fold") != i), folds.filter(F.col("fold") == i)
            by_id = scores(held, *reference(train.withColumn("w", F.col("w") / train.agg(F.avg("w")).first()[0]), c))
            scored += [(r.y, r.w, float(by_id[r.id])) for r in held.collect()]
        scored = spark.createDataFrame(scored, "y double, w double, score double")
        best = metrics.best_threshold(metrics.threshold_sweep(scored, F.col("y"), F.col("score"), F.col("w"))).first()
        tried.append((round(best.f1, 9), -c, best.t))
    f1, c, t = max(tried)
    assert (got.c, got.threshold) == (-c, t)
    want = scores(df, *reference(df.withColumn("w", F.col("w") / df.agg(F.avg("w")).first()[0]), got.c))
    assert {r.id: r.hybrid_proba for r in got.predict(df).collect()} == pytest.approx(want, abs=1e-6)


def test_separable_single_class_and_empty_tables(spark):
    schema = "id int, stratum string, features array<double>, y double, w double"
    split = spark.createDataFrame([(i, "s", [float(i + 60 * (i >= 20))], float(i >= 20), 1.0) for i in range(40)], schema)
    assert [r.is_survey for r in hybrid.fit_selected(split, "id", "stratum").predict(split).orderBy("id").collect()] == [0] * 20 + [1] * 20
    one = spark.createDataFrame([(i, "s", [float(i), 2.0], 1.0, 1.0) for i in range(12)], schema)
    assert {r.is_survey for r in hybrid.fit_selected(one, "id", "stratum").predict(one).collect()} == {1}
    assert hybrid.fit_selected(one.filter("false"), "id", "stratum").predict(one.filter("false")).count() == 0


def test_saved_models_predict_the_same(spark, tmp_path):
    df = spark.createDataFrame(noisy(60, 5), "id int, features array<double>, y double, w double").withColumn("stratum", F.lit("s"))
    model = hybrid.fit_selected(df, "id", "stratum", k=2, grid=(0.1,))
    model.save(f"file://{tmp_path}/m")
    assert hybrid.Hybrid.load(f"file://{tmp_path}/m") == model


def test_nested_predictions_are_those_of_single_fits(spark):
    """Every repetition and outer fold fitted by itself, one after the other."""
    rows = noisy(150, 5)
    df = spark.createDataFrame([(*r, "ab"[r[0] % 2]) for r in rows], "id int, features array<double>, y double, w double, stratum string").repartition(3).cache()
    fixed = spark.createDataFrame(noisy(20, 6, fixed=True), "id int, features array<double>, y double, w double").drop("id")
    want = {}
    for rep in range(2):
        parts = hybrid.folds(df, ["stratum", "y"], "id", 3, 42 + rep).withColumnRenamed("fold", "_outer").cache()
        for fold in range(3):
            model = hybrid.fit_selected(parts.filter(F.col("_outer") != fold).drop("_outer"), "id", "stratum", fixed, 3, 42, GRID)
            want |= {(r.id, rep): r.is_survey for r in model.predict(parts.filter(F.col("_outer") == fold)).collect()}
    got = {(r.id, r.rep): r.pred for r in hybrid.nested_cv(df, "id", "stratum", fixed, reps=2, outer=3, inner=3, grid=GRID).collect()}
    assert len(got) == 300 and got == want


def test_sums_of_many_tasks_are_added_in_shares(spark):
    rows = spark.createDataFrame([(i % 3, *r) for i, *r in noisy(200, 8)], "fold int, features array<double>, y double, w double")
    one, many = (logistic.fit_all(rows.repartition(n), 3, GRID, 4, 1, tasks) for n, tasks in ((2, 2), (70, 70)))
    assert np.allclose(one.beta, many.beta, atol=1e-7) and np.allclose(one.mean, many.mean)


def test_equal_rows_are_fitted_as_one(spark):
    """Free, fixed and held-out rows with copies: the same sets, coefficients and thresholds, from one row of each kind."""
    kinds = noisy(20, 9)
    jobs = [[(i * 7) % 3, (i * 5) % 4 - 1] for i in range(600)]  # in the second job a quarter is held out
    rows = [(fold, True, *kinds[i % 20][1:]) for i, fold in enumerate(jobs)] + [([3, 3], False, *kinds[i % 20][1:]) for i in range(40)]
    df = spark.createDataFrame(rows, "folds array<int>, free boolean, features array<double>, y double, w double").coalesce(1).cache()
    few = logistic.patterns(df, 3).cache()
    assert few.count() == 2 * 20
    one, all_of = (logistic.fit_all(x, 3, GRID, 4, 2) for x in (few, df))
    assert np.allclose(one.beta, all_of.beta, atol=1e-7) and np.allclose(one.scale, all_of.scale)
    reached = [logistic.thresholds(x, all_of, 3, 2) for x in (few, df)]
    assert [t for _, t in reached[0]] == [t for _, t in reached[1]]
    assert np.allclose(*([f for f, _ in r] for r in reached))


def test_equal_rows_of_many_batches_are_fitted_as_one(spark):
    """Rows of 20 kinds over 9 tasks become 20, with the same fits; rows that are all different are not shuffled."""
    kinds = noisy(20, 9)
    df = spark.createDataFrame([(i // 20 % 4 - 1, *kinds[i % 20][1:]) for i in range(900)], "fold int, features array<double>, y double, w double").repartition(9).cache()
    few, width, tasks = logistic.gathered(logistic.patterns(df, 3))
    kept = few.collect()
    assert (width, tasks, len(kept)) == (4, 1, 40)  # free and fixed
    assert sum(r.times[3] for r in kept) == 900
    one, all_of = (logistic.fit_all(x, 3, GRID, 4) for x in (few, df))
    assert np.allclose(one.beta, all_of.beta, atol=1e-7) and np.allclose(one.mean, all_of.mean) and np.allclose(one.scale, all_of.scale)
    single = spark.createDataFrame([(i % 3, *r) for i, *r in noisy(200, 8)], "fold int, features array<double>, y double, w double")
    other, _, _ = logistic.gathered(logistic.patterns(single, 3))
    assert other.count() == 200 and "Exchange" not in other._jdf.queryExecution().executedPlan().toString()
    assert logistic.gathered(logistic.patterns(single.limit(0), 3))[1:] == (0, 1)


def test_nested_folds_rank_each_repetition_once(spark):
    df = spark.createDataFrame(noisy(60, 3), "id int, features array<double>, y double, w double").withColumn("stratum", F.lit("s"))
    scans = [hybrid.nested_folds(df, "id", "stratum", reps, 3, 2, 1)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") for reps in (2, 4)]
    assert scans == [6, 10]  # twice a repetition and once, for counting inner folds and for placing rows
