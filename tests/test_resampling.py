"""Bootstrap counts: exact totals, the moments of draws with replacement, paired values, and rates by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmetrics.operators import resampling as R


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "abc"[min(2, i % 5)], float(rng.normal(3, 2)), int(rng.random() < 0.3)) for i in range(700)]
    return spark.createDataFrame([*rows, (700, None, 1.0, 1), (701, None, 2.0, 0)], "id int, s string, x double, y int")


def collected(df):
    rows = df.orderBy("rep").collect()
    return {c: np.array([r[c] for r in rows], float) for c in rows[0].asDict()}


@pytest.mark.parametrize("bits", [None, 0, 3, 12])
def test_totals_and_moments(table, bits):
    values = {"n": F.lit(1)} | {f"n_{s}": (F.col("s") == s).cast("int") for s in "abc"} | {"x": F.col("x"), "xx": F.col("x") * 2, "y": F.col("y")}
    got = collected(R.bootstrap_totals(table, ["s"], "id", values, 1500, 5, bits))
    rows = table.collect()
    assert got["rep"].tolist() == list(range(1, 1501)) and set(got["n"]) == {702.0}
    for s in "abc":  # every replicate draws as many of a stratum as it has
        assert set(got[f"n_{s}"]) == {float(sum(r.s == s for r in rows))}
    assert np.allclose(got["xx"], 2 * got["x"])  # the same draws
    for c in ("x", "y"):
        by = [[r[c] for r in rows if r.s == s] for s in ("a", "b", "c", None)]
        variance = sum(len(v) * np.var(v) for v in by)
        assert abs(got[c].mean() - sum(map(sum, by))) < 4 * (variance / 1500) ** 0.5
        assert got[c].var() == pytest.approx(variance, rel=0.15)


def test_counts_of_single_rows(spark):
    """Each row is drawn once on average with variance 1 - 1/n, and two rows of a stratum repel each other."""
    df = spark.range(40).select("id", F.lit("s").alias("s"))
    values = {f"c{i}": (F.col("id") == i).cast("int") for i in (0, 1, 39)}
    got = collected(R.bootstrap_totals(df, ["s"], "id", values, 4000, 9, 4))
    for c in values:
        assert got[c].mean() == pytest.approx(1, abs=0.07) and got[c].var() == pytest.approx(1 - 1 / 40, rel=0.1)
        assert (got[c] == got[c].astype(int)).all()
    assert abs(np.corrcoef(got["c0"], got["c1"])[0, 1] + 1 / 39) < 0.06


def test_reruns_agree_however_rows_are_dealt_out(table):
    one, two = (collected(R.bootstrap_totals(df, ["s"], "id", {"x": F.col("x")}, 50, 5, 6))["x"] for df in (table.coalesce(1), table.repartition(9)))
    assert np.allclose(one, two)
    assert not np.allclose(one, collected(R.bootstrap_totals(table, ["s"], "id", {"x": F.col("x")}, 50, 6, 6))["x"])
    assert R.bootstrap_totals(table.limit(0), ["s"], "id", {"x": F.col("x")}, 50).collect() == []


def test_rates_by_hand(spark):
    rows = [(i, rep, "ab"[i % 2], int(i % 3 == 0), int((i * (rep + 3)) % 4 == 0), 1.0 + i % 2) for i in range(60) for rep in range(3)]
    df = spark.createDataFrame(rows, "id int, rep int, s string, y int, p int, w double")
    got = collected(R.rate_samples(df, ["s"], "id", "rep", F.col("y"), F.col("p"), F.col("w"), 400, 3))

    def rate(rep, y):
        return sum(r[5] for r in rows if r[1] == rep and r[3] == y and r[4]) / sum(r[5] for r in rows if r[1] == rep and r[3] == y)

    assert got["rep"].tolist() == list(range(401))
    assert got["tpr"][0] == pytest.approx(np.mean([rate(r, 1) for r in range(3)])) and got["fpr"][0] == pytest.approx(np.mean([rate(r, 0) for r in range(3)]))
    assert abs(got["tpr"][1:].mean() - got["tpr"][0]) < 0.03 and 0.02 < got["tpr"][1:].std() < 0.2


def test_rates_bring_repetitions_together_once(spark):
    df = spark.createDataFrame([(i, rep, "a", i % 2, 1, 1.0) for i in range(8) for rep in range(2)], "id int, rep int, s string, y int, p int, w double")
    plan = R.rate_samples(df, ["s"], "id", "rep", F.col("y"), F.col("p"), F.col("w"), 5)._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation") == 3  # for the draws, their ranges and the exact rates


def test_method_intervals_against_drawing_rows(spark):
    from litmetrics.plans import evaluation

    rng = np.random.default_rng(3)
    y = (rng.random(240) < 0.4).astype(int)
    rows = [(i, "ab"[i % 2], int(v), int(v if rng.random() < 0.9 else 1 - v), int(v if rng.random() < 0.7 else 1 - v), 1.0 + i % 2) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "id int, s string, y int, p int, q int, w double")
    got = {r.method: r for r in evaluation.method_intervals(df, {"p": F.col("p"), "q": F.col("q") == 1}, F.col("y"), "id", ("s",), F.col("w")).collect()}
    t = np.array([r[2:] for r in rows])

    def f1(at, c):
        own = t[at]
        tp, miss = (own[:, 3] * (own[:, 0] == 1) * (own[:, c] == 1)).sum(), (own[:, 3] * (own[:, 0] != own[:, c])).sum()
        return 2 * tp / (2 * tp + miss)

    assert got["p"].f1 == pytest.approx(f1(np.arange(240), 1)) and got["q"].delta == pytest.approx(f1(np.arange(240), 2) - f1(np.arange(240), 1))
    parts = [np.arange(0, 240, 2), np.arange(1, 240, 2)]
    draws = [np.concatenate([rng.choice(g, len(g)) for g in parts]) for _ in range(2000)]
    both = np.array([[f1(d, 1), f1(d, 2)] for d in draws])
    for name, values in (("p", both[:, 0]), ("q", both[:, 1])):
        assert (got[name].f1_low, got[name].f1_high) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])), abs=0.012)
    assert (got["q"].delta_low, got["q"].delta_high) == pytest.approx(tuple(np.quantile(both[:, 1] - both[:, 0], [0.025, 0.975])), abs=0.015)
    assert got["p"].delta == got["p"].delta_low == got["p"].delta_high == 0


@pytest.mark.parametrize("at", [0, 5, 7])
def test_draws_of_a_range_by_its_path(at):
    """A range needs the rows of the halves that hold it, a number a level, to draw what all ranges' numbers would give."""
    sizes = np.array([5, 0, 7, 3, 0, 9, 4, 2])
    path = [int(sizes.reshape(-1, w)[at // w].sum()) for w in (8, 4, 2, 1)]
    drawn, low, high = np.full(50, 30), 0, 8
    while high - low > 1:
        middle = (low + high) // 2
        first = np.random.default_rng([3, low, high]).binomial(drawn, sizes[low:middle].sum() / sizes[low:high].sum() if sizes[low:high].any() else 0.0)
        drawn, low, high = (first, low, middle) if at < middle else (drawn - first, middle, high)
    assert (R.halved(path, at, 50, [3]) == drawn).all()
