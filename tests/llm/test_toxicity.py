"""The automaton against edit distances by definition, scores on held-out labels, quotation against abuse."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmetrics.llm import toxicity as X


def distance(a, b):
    """Edits with swapped neighbours, no letter edited twice."""
    d = [[i + j if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def plain(word, terms):
    found = {}
    for n, (term, stem) in enumerate(terms):
        e = min(distance(word[:k], term) for k in range(len(word))) if stem and word else 99 if stem else distance(word, term)
        if e <= X.allowed_edits(term, stem):
            found[n] = e
    return found


def test_automaton_by_definition():
    rng = random.Random(1)
    say = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randrange(a, b)))
    terms = list({(say(4, 12), rng.random() < 0.3) for _ in range(60)})
    automaton = X.Automaton(terms)
    words = {say(1, 14) for _ in range(1500)}
    for term, _ in terms:  # and near ones
        for _ in range(20):
            w = list(term)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(3)] = rng.choice(["", "a", "b", "ca", "d"]) or []
                w = w or ["a"]
            words.add("".join(w))
    for word in words:
        assert dict(automaton.match(word)) == plain(word, terms), word


def test_words_and_edits():
    assert X.words_of("You IDIOOOOT!! m0ron, st*pid id_iot ") == ["you", "idiot", "m0ron", "st*pid", "id", "iot"]
    assert [X.allowed_edits(*t) for t in (("scum", False), ("idiot", False), ("worthless", False), ("lowei", True), ("stemstem", True))] == [0, 1, 2, 0, 1]


def test_terms_that_add_nothing_go():
    rows = [("pathetic", False, 6.0, 104), ("path", True, 6.0, 104), ("lowei", True, 7.0, 249), ("loweient", False, 6.0, 98), ("reux", True, 2.0, 60), ("reuxe", True, 5.0, 26)]
    assert {(t, s) for t, s, _ in X._pruned(rows)} == {("pathetic", False), ("lowei", True), ("reux", True), ("reuxe", True)}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    plainly = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}n" for i in range(300)]
    text = lambda n: [rng.choice(plainly) for _ in range(n)]
    rows, labels = [], []
    for i in range(600):
        words, toxic = text(rng.randrange(15, 120)), int(i % 6 == 0)
        for _ in range(toxic * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "vulgarity", "zumpfer"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    base = text(30)
    planted = {
        "clean": " ".join(base), "exact": " ".join([*base[:9], "you", "grobnik", *base[9:]]), "swapped": " ".join([*base[:9], "gronbik", *base[9:]]), "twice": " ".join([*base[:9], "vulgurty", "zumpfeeeer", *base[9:]]),
        "quoted": " ".join([*base[:9], 'he', 'said', '"you grobnik"', *base[9:]]), "empty": "", "null": None,
    }
    names = {}
    for name, t in planted.items():
        names[name] = 1000 + len(names)
        rows.append((names[name], t))
    return rows, labels, names


@pytest.fixture(scope="module")
def scored(spark, corpus):
    rows, labels, _ = corpus
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "a.b": F.lit(1), "hits": F.lit(0)}).repartition(3)
    out = X.score_documents(df, spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("doc_id.x", F.lit(1)))
    return {r._row.doc_id: r for r in out.collect()}


def test_planted_cases(scored, corpus):
    rows, labels, names = corpus
    assert len(scored) == len(rows)
    got = {n: scored[i] for n, i in names.items()}
    assert [got[n].predicted for n in ("clean", "exact", "swapped", "twice", "empty", "null")] == [0, 1, 1, 1, 0, 0]
    assert got["quoted"].predicted == 0 and got["quoted"].hits[0].quoted == 1 and got["exact"].hits[0].addressed == 1
    assert got["clean"].score == got["null"].score == got["empty"].score
    assert {(h.surface, h.term, h.edits) for h in got["twice"].hits} == {("vulgurty", "vulgarity", 2), ("zumpfer", "zumpfer", 0)}
    wrong = [i for i, y in labels if scored[i].predicted != y]
    assert not wrong
    assert all(scored[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in scored)


def test_held_out_labels_are_not_looked_at(spark, corpus):
    rows, labels, _ = corpus
    df = spark.createDataFrame(rows[:200], "doc_id long, text string")
    turned = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    one, two = ([(r._row.doc_id, r.score) for r in X.score_documents(df, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("_row.doc_id").collect()] for x in (labels, turned))
    assert one == two


def test_common_surfaces_are_words_of_their_own(spark, corpus):
    rows, labels, _ = corpus
    # a word one edit from a term, in every clean document
    near = [(i, f"{t} zumpfen" if i < 600 and not y else t) for (i, t), (_, y) in zip(rows, [*labels, *[(0, 1)] * 9])]
    out = X.score_documents(spark.createDataFrame(near, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r.predicted for r in out.orderBy("_row.doc_id").limit(600).collect()] == [y for _, y in labels]


def test_odd_tables(spark, corpus):
    rows, labels, _ = corpus
    few = spark.createDataFrame([(None, "grobnik"), (1, "x"), (1, "x"), (2, None), (3, "y " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = X.score_documents(few, none).collect()
    assert len(out) == 5 and len({r.score for r in out}) == 1 and [r.held_out for r in out if r._row.doc_id is None] == [True]
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 7), (1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    assert len(X.score_documents(few, odd).collect()) == 5
    assert X.score_documents(few.limit(0), odd).collect() == []


def test_fit_follows_labels_over_the_prior():
    rng = np.random.default_rng(2)
    x = np.zeros((4000, 5))
    x[:, 1] = rng.integers(0, 2, 4000) * 5.0  # quotations that are toxic after all
    y = (x[:, 1] > 0).astype(float)
    beta = X.fit_scores(x, y, np.ones(4000), 0.5)
    assert beta[1] > 0.5 and beta[-1] < -1
    assert abs(X.fit_scores(x[:0], y[:0], y[:0], 0.2)[:-1] - X.PRIOR).max() < 1e-9


def test_held_out_labels_of_the_table(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    out = X.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), carry=["doc_id"])
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, truth[r._row.doc_id]) for r in out.collect() if r.held_out and r._row.doc_id in truth]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.93
