"""Classification metrics as weighted aggregates. y and p are 0/1 columns, 1 meaning survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(y: Column, p: Column, w: Column) -> dict[str, Column]:
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0)).cast("double")
    return {"tp": total((y == 1) & (p == 1)), "fp": total((y == 0) & (p == 1)), "fn": total((y == 1) & (p == 0)), "tn": total((y == 0) & (p == 0))}


def confusion(df: DataFrame, by: list[str], y: Column, p: Column, w: Column | None = None) -> DataFrame:
    """(by, tp, fp, fn, tn, accuracy, precision, recall, f1); divisions by zero give 0."""
    cells = df.groupBy(*by).agg(*[c.alias(n) for n, c in _cells(y, p, F.lit(1.0) if w is None else w).items()])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(*by, "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def weighted(df: DataFrame, by: list[str], y: Column, p: Column, w: Column) -> DataFrame:
    """(by, precision, recall, f1, rate): weighted, denominators not below 1e-12."""
    cells = df.groupBy(*by).agg(*[c.alias(n) for n, c in _cells(y, p, w).items()])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = cells.select(*by, (tp / F.greatest(tp + fp, F.lit(1e-12))).alias("precision"), (tp / F.greatest(tp + fn, F.lit(1e-12))).alias("recall"), F.try_divide(tp + fn, tp + fp + fn + tn).alias("rate"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def threshold_sweep(df: DataFrame, y: Column, score: Column, w: Column, low: int = 5, high: int = 95) -> DataFrame:
    """(t, f1) for thresholds low% .. high%. Rows are first added up by the highest threshold they reach, so the grid
    multiplies at most a hundred rows and not the table."""
    reach = F.least(F.greatest(F.floor(score * 100 + 1e-9), F.lit(low - 1)), F.lit(high)).cast("int")
    bins = df.select(reach.alias("reach"), y.alias("y"), w.alias("w")).groupBy("reach").agg(F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("w"))), F.lit(0.0)).alias("pos"), F.sum("w").alias("all"))
    grid = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("k"))
    # at most high - low + 2 bins
    joined = grid.crossJoin(F.broadcast(bins)).groupBy("k").agg(F.sum(F.when(F.col("reach") >= F.col("k"), F.col("pos")).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col("reach") >= F.col("k"), F.col("all")).otherwise(0.0)).alias("flagged"), F.sum("pos").alias("pos"))
    precision, recall = F.col("tp") / F.greatest(F.col("flagged"), F.lit(1e-12)), F.col("tp") / F.greatest(F.col("pos"), F.lit(1e-12))
    return joined.select((F.col("k") / 100).alias("t"), F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall)).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the largest F1."""
    return sweep.agg(F.min_by(F.struct("t", "f1"), F.struct(-F.col("f1"), F.col("t"))).alias("x")).select("x.*")


def precision_at_rate(tpr: Column, fpr: Column, rate: Column) -> Column:
    return tpr * rate / F.greatest(F.lit(1e-9), tpr * rate + fpr * (1 - rate))


def kappa(df: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """(by, n, agreement, kappa) of two 0/1 labels."""
    m = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((a == b).cast("double")).alias("agreement"), F.avg(a.cast("double")).alias("pa"), F.avg(b.cast("double")).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select(*by, "n", "agreement", F.try_divide(F.col("agreement") - chance, 1 - chance).alias("kappa"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = total / (classes * n)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    return counts.crossJoin(F.broadcast(totals)).select(label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def corrected_shares(q: Column, cites: Column, tpr: Column, fpr: Column) -> tuple[Column, Column]:
    """Shares of papers and citations corrected for the classifier's error rates (adjusted classify and count)."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    share = clip((q - fpr) / F.greatest(tpr - fpr, F.lit(1e-9)))
    found = F.when(q > 0, clip(tpr * share / q)).otherwise(0.0)
    missed = F.when(q < 1, clip((1 - tpr) * share / (1 - q))).otherwise(0.0)
    return share, found * cites + missed * (1 - cites)
