"""The learned hybrid: weighted logistic regression on standardized features, C and threshold chosen by cross-validated weighted F1."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import seeded
from . import logistic
from .sampling import PREFIX, folds

C_GRID = (0.01, 0.1, 1.0)


def _chosen(grid: tuple[float, ...], reached: list[tuple[float, float]]) -> tuple[float, float, float, int]:
    """(F1, -C, threshold, place in the grid) of the largest F1, then of the smallest C."""
    return max((f1, -c, t, at) for at, (c, (f1, t)) in enumerate(zip(grid, reached, strict=True)))


@dataclass
class Hybrid:
    mean: list[float]
    scale: list[float]
    coefficients: list[float]
    intercept: float
    threshold: float
    c: float

    def predict(self, df: DataFrame) -> DataFrame:
        """df with hybrid_proba and is_survey."""
        centre, slope = (F.array(*[F.lit(float(x)) for x in v]) for v in (self.mean, [c / s for c, s in zip(self.coefficients, self.scale, strict=True)]))
        parts = F.zip_with(F.zip_with("features", centre, lambda x, m: x - m), slope, lambda x, b: x * b)
        proba = 1 / (1 + F.exp(-F.aggregate(parts, F.lit(float(self.intercept)), lambda a, x: a + x)))
        return df.withColumn("hybrid_proba", proba).withColumn("is_survey", (F.col("hybrid_proba") >= self.threshold).cast("int"))

    def save(self, path: str) -> None:
        SparkSession.active().createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, path: str) -> Hybrid:
        return cls(**json.loads(SparkSession.active().read.text(f"{path}/config").first().value))


def fit_selected(df: DataFrame, key: str, stratum: str, fixed: DataFrame | None = None, k: int = 5, seed: int = 42, grid: tuple[float, ...] = C_GRID) -> Hybrid:
    """df (key, stratum, features, y, w); fixed rows (features, y, w) join every training part. The weights of df are
    scaled to mean 1 in every training part, and stay as they are where thresholds are compared. All folds and strengths,
    and the fits on all rows, are fitted in the same passes over the table (logistic.fit_all)."""
    columns = [F.col("fold").cast("int").alias("fold"), F.col("features").cast("array<double>").alias("features"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")]
    rows = folds(df, [stratum, "y"], key, k, seed).select(*columns)
    if fixed is not None:
        rows = rows.unionByName(fixed.withColumn("fold", F.lit(-1)).select(*columns))
    kept = logistic.patterns(rows, k).cache()
    parts, width, tasks = logistic.gathered(kept)
    fits = logistic.fit_all(parts, k, grid, width, 1, tasks)
    f1, c, threshold, at = _chosen(grid, logistic.thresholds(parts, fits, k, 1, tasks))
    parts.unpersist()
    kept.unpersist()
    return Hybrid(fits.mean[k].tolist(), fits.scale[k].tolist(), fits.beta[k, at, :-1].tolist(), float(fits.beta[k, at, -1]), threshold, -c)


def source_weights(df: DataFrame, source: str, w: str, fixed: str = "llm", extra: str = "validation", share: float = 0.25) -> DataFrame:
    """df with w set by source: rows of `fixed` scaled to mean 1, rows of `extra` together `share` of their total (which
    is their number), all others as they are."""
    per = df.groupBy(source).agg(F.count(F.lit(1)).alias("_n"), F.avg(w).alias("_mean"))  # one row a source
    of_fixed = per.filter(F.col(source) == fixed).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_fixed"))
    known = df.join(per, source).crossJoin(F.broadcast(of_fixed))
    weight = F.when(F.col(source) == fixed, F.col(w) / F.col("_mean")).when(F.col(source) == extra, share * F.col("_fixed") / F.col("_n")).otherwise(F.col(w))
    return known.withColumn(w, weight).select(*df.columns)


def nested_folds(df: DataFrame, key: str, stratum: str, reps: int, outer: int, inner: int, seed: int) -> DataFrame:
    """df with `outer`, the outer fold of every repetition, and `folds`: for each repetition and outer fold the inner fold
    among the rows outside that fold, OUT for the rows inside.

    Inner folds deal out the rows of a class and stratum in one seeded order, held-out rows left out: a row's place is
    its place among all less the number of held-out ones before it, which is counted in ranges of that order.
    """
    rows = df
    for rep in range(reps):
        rows = folds(rows, [stratum, "y"], key, outer, seed + rep, df).withColumnRenamed("fold", f"_o{rep}")
    hashed = rows.withColumn("_u", seeded(F.col(key), F.lit(seed))).withColumn("_range", F.substring("_u", 1, PREFIX))
    jobs = [(r, o) for r in range(reps) for o in range(outer)]
    inside = [F.count_if(F.col(f"_o{r}") != o) for r, o in jobs]
    counts = hashed.groupBy(stratum, "y", "_range").agg(F.array(*inside).alias("_n"))  # at most 16 ** PREFIX rows a class and stratum
    earlier = Window.partitionBy(stratum, "y").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.array(*[F.coalesce(F.sum(F.get("_n", F.lit(j))).over(earlier), F.lit(0)) for j in range(len(jobs))])
    starts = counts.select(F.col(stratum).alias("_s"), F.col("y").alias("_y"), F.col("_range").alias("_r"), before.alias("_before"))
    sofar = Window.partitionBy(stratum, "y", "_range").orderBy("_u", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hashed.withColumn("_in", F.array(*[c.over(sofar) for c in inside]))
    same = F.col(stratum).eqNullSafe(F.col("_s")) & F.col("y").eqNullSafe(F.col("_y")) & (F.col("_range") == F.col("_r"))
    place = [F.when(F.col(f"_o{r}") == o, logistic.OUT).otherwise((F.get("_before", F.lit(j)) + F.get("_in", F.lit(j)) - 1) % inner).cast("int") for j, (r, o) in enumerate(jobs)]
    return placed.join(starts, same).select(*df.columns, F.array(*[F.col(f"_o{r}") for r in range(reps)]).alias("outer"), F.array(*place).alias("folds"))


def nested_cv(df: DataFrame, key: str, stratum: str, fixed: DataFrame | None = None, reps: int = 5, outer: int = 10, inner: int = 5, seed: int = 42, grid: tuple[float, ...] = C_GRID) -> DataFrame:
    """(key, rep, pred): out-of-fold predictions of every repetition. C and the threshold are chosen anew inside every
    outer training part, so the held-out rows take no part in the choice. All fits of all repetitions, folds and strengths
    go over the rows in the same passes, and the predictions are one join with the table of reps * outer models."""
    jobs = reps * outer
    rows = nested_folds(df, key, stratum, reps, outer, inner, seed).cache()
    columns = [F.col("features").cast("array<double>").alias("features"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")]
    sets = rows.select("folds", F.lit(True).alias("free"), *columns)
    if fixed is not None:
        sets = sets.unionByName(fixed.select(F.array_repeat(F.lit(inner), jobs).alias("folds"), F.lit(False).alias("free"), *columns))
    kept = logistic.patterns(sets, inner).cache()
    parts, width, tasks = logistic.gathered(kept)
    fits = logistic.fit_all(parts, inner, grid, width, jobs, tasks)
    reached = logistic.thresholds(parts, fits, inner, jobs, tasks)
    parts.unpersist()
    kept.unpersist()
    models = []
    for job in range(jobs):
        _, _, threshold, at = _chosen(grid, reached[job * len(grid) : (job + 1) * len(grid)])
        whole = job * (inner + 1) + inner
        slope = fits.beta[whole, at, :-1] / fits.scale[whole]
        models.append((job, slope.tolist(), float(fits.beta[whole, at, -1] - slope @ fits.mean[whole]), threshold))
    table = df.sparkSession.createDataFrame(models, "_job int, _slope array<double>, _start double, _threshold double")
    held = rows.select(key, "features", F.posexplode("outer").alias("rep", "_o")).withColumn("_job", F.col("rep") * outer + F.col("_o"))
    z = F.aggregate(F.zip_with(F.col("features").cast("array<double>"), "_slope", lambda x, b: x * b), F.col("_start"), lambda a, x: a + x)
    pred = (1 / (1 + F.exp(-z)) >= F.col("_threshold")).cast("int")
    return held.join(F.broadcast(table), "_job").select(key, "rep", pred.alias("pred"))  # reps * outer models
