"""The support vector machine against an independent solver, and the dictionary of terms."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmetrics.operators import baselines, svm
from litmetrics.plans import registry


def descent(x, y, c):
    """Least of |w|^2 / 2 + c sum max(0, 1 - s w x)^2 by accelerated gradient descent on dense rows with a column of ones."""
    s, x = 2.0 * y - 1, np.column_stack([np.ones(len(x)), x])
    pace = 1 / (1 + 2 * c * np.linalg.eigvalsh(x.T @ x).max())
    w = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(20_000):
        slope = z + 2 * c * x.T @ (s * np.minimum(s * (x @ z) - 1, 0))
        new = z - pace * slope
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
        if np.abs(slope).max() < 1e-10:
            break
    return w


@pytest.mark.parametrize("c", [0.05, 1.0, 20.0])
def test_weights_against_gradient_descent(spark, c):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 12)) * (rng.random((150, 12)) < 0.3)
    y = (x @ rng.normal(size=12) + rng.normal(0, 0.8, 150) > 0.2).astype(float)
    x[7] = 0  # a row without components
    rows = [([int(j) + 1 for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]], float(b)) for r, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "at array<int>, value array<double>, y double").repartition(3)
    assert svm.fit(df, 13, c) == pytest.approx(descent(x, y, c), abs=1e-5)


def test_no_rows_and_one_class(spark):
    df = spark.createDataFrame([([1], [1.0], 1.0), ([], [], 1.0)], "at array<int>, value array<double>, y double")
    assert svm.fit(df.limit(0), 3).tolist() == [0, 0, 0]
    w = svm.fit(df, 3)
    assert w[0] > 0 and w[0] + w[1] > 0 and w[2] == 0


def tfidf(texts, fitted):
    """Dense TF-IDF rows over the terms that two of the fitted texts hold, and the terms."""
    def terms(t):
        words = re.findall(r"\w\w+", t.lower())
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    df = Counter(t for x in fitted for t in set(terms(x)))
    names = sorted(t for t, n in df.items() if n >= 2)
    out = np.zeros((len(texts), len(names)))
    for i, x in enumerate(texts):
        for t, n in Counter(terms(x)).items():
            if t in df and df[t] >= 2:
                out[i, names.index(t)] = (1 + math.log(n)) * (math.log((1 + len(fitted)) / (1 + df[t])) + 1)
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None], names


def test_margins_against_an_independent_solver(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[:25] if i % 2 else words[15:], rng.integers(3, 20))) for i in range(90)] + ["nothing known here", ""]
    y = np.array([i % 2 for i in range(92)])
    df = spark.createDataFrame([(i, t, int(v)) for i, (t, v) in enumerate(zip(texts, y))], "id int, text string, y int").repartition(4)
    train, test = df.filter("id < 60 or id = 91"), df.filter("id >= 60")
    fitted = [t for i, t in enumerate(texts) if i < 60 or i == 91]
    x, _ = tfidf(fitted, fitted)
    w = descent(x, np.array([v for i, v in enumerate(y) if i < 60 or i == 91]), 1.0)
    want = {i: m for i, m in zip(range(60, 92), tfidf(texts[60:], fitted)[0] @ w[1:] + w[0], strict=True)}
    got = {r.id: (r.p, r.margin) for r in baselines.tfidf_svm(train, test, "id", F.col("text"), "y").collect()}
    assert got.keys() == want.keys()
    assert all(got[i][1] == pytest.approx(want[i], abs=1e-4) and got[i][0] == int(got[i][1] > 0) for i in want)


def test_the_dictionary_is_dense_and_whole(spark):
    idf = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("term"))
    rows = baselines.dictionary(idf).collect()
    assert sorted(r.i for r in rows) == list(range(1, 3001)) and len({r.term for r in rows}) == 3000
    again = {r.term: r.i for r in baselines.dictionary(idf.repartition(7)).collect()}
    assert again == {r.term: r.i for r in rows}
    weights = spark.createDataFrame([(1, "t5", 0.5), (1, "t9", 0.25), (1, "absent", 0.1), (2, "t5", 1.0)], "id int, term string, weight double")
    got = {r.id: dict(zip(r.at, r.value)) for r in baselines.sparse(weights, "id", baselines.dictionary(idf)).collect()}
    assert got == {1: {again["t5"]: 0.5, again["t9"]: 0.25}, 2: {again["t5"]: 1.0}}


def test_no_python_runs_where_vectors_are_made(spark, sf_dir):
    docs = registry.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = baselines.TfIdf.fit(docs, F.col("text"))
    plan = baselines.sparse(model.transform(docs, "doc_id", F.col("text")), "doc_id", baselines.dictionary(model.idf))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_weights_of_own_frequencies(spark):
    """Fit and transform in one, over several blocks and with two rows of one key."""
    texts = [(i, " ".join(f"w{(i * k) % 7} w{k % 3}" for k in range(1, 2 + i % 5))) for i in range(30)] + [(3, "w1 w1 w2"), (40, None), (41, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    joined = df.groupBy("id").agg(F.concat_ws(" , ", F.collect_list("text")).alias("text")).filter("id <> 3")
    key = lambda r: (r.id, r.term)
    one = {key(r): r.weight for r in baselines.tfidf_weights(df.filter("id <> 3"), "id", F.col("text")).collect()}
    two = {key(r): r.weight for r in baselines.TfIdf.fit(joined, F.col("text")).transform(joined, "id", F.col("text")).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    every = baselines.tfidf_weights(df, "id", F.col("text"))
    assert every.count() == every.select("id", "term").distinct().count()


@pytest.mark.parametrize("kept", [3, 40])
def test_numbers_of_rows_against_gradient_descent(spark, kept):
    """Few passes, and the weights of an independent solver, also where only few slopes are kept and rows count more than once."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 30)) * (rng.random((120, 30)) < 0.3)
    y = (x @ rng.normal(size=30) + rng.normal(0, 0.8, 120) > 0.2).astype(float)
    passes = []
    ones = np.column_stack([np.ones(len(x)), x])
    a = svm.solve(lambda u: passes.append(1) or ones @ (ones.T @ u), 0.5 * y, 0.5 * (1 - y), kept)
    assert ones.T @ a == pytest.approx(descent(x, y, 0.5), abs=1e-5) and len(passes) < 1000
    twice = svm.solve(lambda u: ones @ (ones.T @ u), y, 1 - y)
    every = np.concatenate([ones, ones])
    assert ones.T @ twice == pytest.approx(every.T @ svm.solve(lambda u: every @ (every.T @ u), np.tile(0.5 * y, 2), np.tile(0.5 * (1 - y), 2)), abs=1e-5)
    assert svm.solve(lambda u: u, np.zeros(0), np.zeros(0)).size == 0


def test_a_pass_sends_numbers_of_documents_not_of_terms(spark, monkeypatch):
    """Few passes, none of which sends a number for each of the many terms to the tasks or back."""
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(np.size(x)) or broadcast(self, x))
    words = lambda i: " ".join(f"w{(i * k) % 97}" for k in range(1, 60))
    df = spark.createDataFrame([(i, words(i // 2), i // 2 % 2) for i in range(80)], "id int, text string, y int")
    spark.sparkContext.setJobGroup("svm", "svm")
    got = baselines.tfidf_svm(df.filter("id < 60"), df.filter("id >= 60"), "id", F.col("text"), "y").collect()
    terms = baselines.TfIdf.fit(df.filter("id < 60"), F.col("text")).idf.count()
    assert len(got) == 20 and terms > 1000 and max(sent) <= 80 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("svm")) < 100


def test_rows_of_one_key_are_one_document_in_training(spark):
    """Rows of one key in train share their words, each with its own label; terms are counted by rows; unknown ones are left out."""
    rows = [(1, "deep net deep", 1), (1, "net survey", 1), (2, "circuit gain", 0), (3, "circuit deep", 0), (4, None, 0), (5, "gain survey net", 1)]
    df = spark.createDataFrame(rows, "id int, text string, y int")
    test = spark.createDataFrame([(7, "deep circuit", 0), (8, "unknown", 0), (9, "net", 1), (9, "survey", 1), (None, "net", 1)], "id int, text string, y int")
    got = sorted((r.id or 0, round(r.margin, 4)) for r in baselines.tfidf_svm(df, test, "id", F.col("text"), "y").collect())
    texts = ["deep net deep ! net survey", "circuit gain", "circuit deep", "", "gain survey net"]
    names = {"deep": 2, "net": 3, "survey": 2, "circuit": 2, "gain": 2}  # by rows; no pair is in two

    def vector(t):
        v = np.array([(1 + math.log(t.split().count(w))) * (math.log(7 / (1 + n)) + 1) if w in t.split() else 0 for w, n in names.items()])
        return v / max(np.linalg.norm(v), 1e-300)

    x = np.array([vector(texts[i]) for i in (0, 0, 1, 2, 3, 4)])
    w = descent(x, np.array([1, 1, 0, 0, 0, 1]), 1.0)
    m = lambda t: round(float(vector(t) @ w[1:] + w[0]), 4)
    assert [k for k, _ in got] == [0, 7, 8, 9, 9]
    assert [v for _, v in got] == pytest.approx([w[0], m("deep circuit"), w[0], m("net survey"), m("net survey")], abs=2e-4)


def test_a_terms_text_moves_once_and_compressed(spark):
    """Of documents with many terms little more is shuffled than their texts, and the weights are those of their words."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 900, 120)) for _ in range(2500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    store, lists = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList
    stages = lambda: (x := store.stageList(lists(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), lists())) and {x.apply(i).stageId(): x.apply(i).shuffleWriteBytes() for i in range(x.size())}
    known = stages().keys()
    out = baselines.tfidf_weights(df, "id", F.col("text"))
    got = {(r.id, r.term): r.weight for r in out.filter("id < 5").collect()}
    moved = sum(n for k, n in stages().items() if k not in known)
    assert moved < 2 * sum(map(len, texts))
    want, names = tfidf(texts[:5], texts)
    assert got == {(i, t): pytest.approx(v) for i, row in enumerate(want) for t, v in zip(names, row) if v}
