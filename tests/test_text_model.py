"""The trained text model: gradients against differences, passes against a plain loop, held-out quality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmetrics.operators import metrics, profiles, sampling, scoring
from litmetrics.operators import text_model as M
from litmetrics.plans.papers import papers


def some(n=7, buckets=30, seed=1):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 6, n)
    ids = np.concatenate([rng.choice(buckets, s, replace=False) for s in sizes] + [np.zeros(0, int)]).astype(int)
    return M.Texts(ids, sizes, rng.integers(0, 2, n).astype(float), rng.random(n) + 0.5)


def test_gradient_against_finite_differences():
    x, w = some(), M.Weights.start(30, 4, 3)
    touched, by_table, by_head = w.gradient(x)
    dense = np.zeros_like(w.table)
    dense[touched] = by_table
    step = 1e-6
    for array, slope in ((w.table, dense), (w.head, by_head)):
        for at in np.ndindex(array.shape):
            held = array[at]
            array[at] = held + step
            up = w.loss(x)
            array[at] = held - step
            down = w.loss(x)
            array[at] = held
            assert slope[at] == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_parts_and_empty_texts():
    x = some()
    ends = np.cumsum(x.sizes)
    part = x.part(np.array([5, 0, 3]))
    assert part.ids.tolist() == [int(i) for a in (5, 0, 3) for i in x.ids[ends[a] - x.sizes[a] : ends[a]]]
    empty = M.Texts(np.zeros(0, int), np.zeros(2, int), np.zeros(2), np.ones(2))
    assert (M.Weights.start(30, 4, 3).embed(empty) == 0).all()


def plain_pass(start, x, pace, batch, seed):
    """The same pass a text at a time."""
    table, head = start.table.copy(), start.head.copy()
    past, past_head = np.full(len(table), 1e-3), np.full(len(head), 1e-3)
    ends = np.cumsum(x.sizes)
    texts = [x.ids[e - s : e] for e, s in zip(ends, x.sizes)]
    order = np.random.default_rng(seed).permutation(len(texts))
    for step in range(-(-len(order) // batch)):
        mine = order[step * batch : (step + 1) * batch]
        by_table, by_head = np.zeros_like(table), np.zeros_like(head)
        for i in mine:
            h = table[texts[i]].mean(axis=0) if len(texts[i]) else np.zeros(table.shape[1])
            g = x.w[i] * (1 / (1 + np.exp(-(h @ head[:-1] + head[-1]))) - x.y[i])
            by_head += np.append(g * h, g)
            for b in texts[i]:
                by_table[b] += g * head[:-1] / len(texts[i])
        mass = x.w[mine].sum()
        by_table, by_head = by_table / mass, by_head / mass
        past += (by_table**2).mean(axis=1)
        past_head += by_head**2
        table -= pace[step] * by_table / np.sqrt(past)[:, None]
        head -= pace[step] * by_head / np.sqrt(past_head)
    return table, head


def test_a_pass_against_a_plain_loop():
    x, start = some(40, 50), M.Weights.start(50, 3, 9)
    pace = [0.1 + 0.01 * i for i in range(10)]
    after, touches = M.descend(start, x, pace, 6, 4)
    table, head = plain_pass(start, x, pace, 6, 4)
    assert np.allclose(after.table, table) and np.allclose(after.head, head)
    assert set(np.flatnonzero(touches)) == set(x.ids.tolist())


def test_warm_up_and_fall():
    pace = M.paces(160, 16, 10, 1.0)
    assert len(pace) == 100 and max(pace) == pytest.approx(1.0) and pace.index(max(pace)) in (9, 10)
    assert pace[0] == pytest.approx(0.1) and pace[-1] == pytest.approx(1 / 90)


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    df = profiles.normalize(papers(spark, sf_dir.replace("sf0.001", "sf0.01")), keep=("id", "Label")).filter("Label in ('0', '1')")
    return sampling.split(df.withColumn("y", (F.col("Label") == "0").cast("int")), "y", "id", 42).cache()


def f1(df, proba):
    return metrics.confusion(df, [], F.col("y"), (proba >= 0.5).cast("int")).first().f1


def test_held_out_f1_is_above_the_cues(labelled):
    model = M.fit(labelled, "id", F.col("y"))
    test = labelled.filter("Split = 'test'")
    mine, cues = f1(model.score(test), F.col("proba")), f1(test, scoring.cue_score(F.col("Title"), F.col("Abstract")))
    assert mine > cues and mine > 0.93
    assert min(model.losses) < 0.3 * model.losses[0]
    again = M.fit(labelled.repartition(5), "id", F.col("y"))
    assert np.allclose(again.weights.head, model.weights.head) and np.allclose(again.weights.table, model.weights.table)


def test_several_shards_agree_with_their_mean(labelled):
    """One pass over three shards is the mean of three passes from one start, weighted by touches."""
    few = labelled.filter("Split = 'train'").limit(150).cache()
    model = M.fit(few, "id", F.col("y"), passes=1, shard=50, buckets=64, width=3)
    start = M.Weights.start(64, 3, 42)
    rows = few.select(M.seeded(F.col("id"), F.lit(42)).alias("u"), F.col("y").cast("double").alias("y"), M.bag(F.col("Title"), F.col("Abstract"), 64).alias("ids")).withColumn("shard", F.pmod(F.xxhash64("u"), F.lit(3))).collect()
    n1 = sum(r.y for r in rows)
    pace = M.paces(50, 16, 1, 1.0)
    table, head, touched = np.zeros_like(start.table), np.zeros_like(start.head), np.zeros(64)
    for s in range(3):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: (r.u, r.ids))
        x = M.Texts(np.array([i for r in own for i in r.ids], int), np.array([len(r.ids) for r in own]), np.array([r.y for r in own]), np.array([150 / 2 / (n1 if r.y else 150 - n1) for r in own]))
        after, touches = M.descend(start, x, pace + pace[-1:] * 50, 16, 42 * 1_000_003 + s)
        table += (after.table - start.table) * touches[:, None]
        head += (after.head - start.head) * len(own) / 150
        touched += touches
    assert np.allclose(model.weights.head, start.head + head)
    assert np.allclose(model.weights.table, start.table + table / np.maximum(touched, 1)[:, None])


def test_early_stopping_keeps_the_best_pass(labelled):
    wrong = labelled.withColumn("y", F.when(F.col("Split") == "val", 1 - F.col("y")).otherwise(F.col("y")))  # learning can only harm
    model = M.fit(wrong, "id", F.col("y"), buckets=256, width=2)
    assert len(model.losses) < 13 and int(np.argmin(model.losses)) == len(model.losses) - 3


def test_save_load_and_odd_tables(spark, labelled, tmp_path):
    small = labelled.filter("id < 200")
    model = M.fit(small, "id", F.col("y"), passes=2, buckets=128, width=3)
    model.threshold = M.chosen_threshold(model, small.filter("Split = 'val'"), F.col("y"))
    model.save(str(tmp_path / "m"))
    same = M.TextModel.load(str(tmp_path / "m"))
    assert (same.weights.table == model.weights.table).all() and (same.weights.head == model.weights.head).all()
    assert (same.threshold, same.losses) == (model.threshold, model.losses)
    odd = spark.createDataFrame([(None, None, "x"), ("", "", "y"), ("A Survey", None, None)], "Title string, Abstract string, `a.b` string").withColumn("proba", F.lit("old"))
    rows = model.score(odd, embedding="e").collect()
    assert len(rows) == 3 and all(len(r.e) == 3 and 0 < r.proba < 1 for r in rows) and {r["a.b"] for r in rows} == {"x", "y", None}
    assert model.score(odd.limit(0)).collect() == []
    none = M.fit(small.filter("id < 0"), "id", F.col("y"), buckets=8, width=2)
    assert {r.proba for r in none.score(odd).collect()} == {0.5}
    blind = M.fit(small.filter("Split = 'train'"), "id", F.col("y"), passes=2, buckets=128, width=3)
    assert blind.losses == () and blind.threshold == 0.5


def test_scores_and_slices_agree_with_whole_embeddings(monkeypatch):
    """Vectors of the terms are held a slice at a time, and scores need none."""
    rng = np.random.default_rng(2)
    sizes = np.array([3, 0, 50, 7, 0, 120, 1, 0])
    x = M.Texts(rng.integers(0, 40, sizes.sum()), sizes, np.zeros(8), np.ones(8))
    w = M.Weights.start(40, 5, 1)
    monkeypatch.setattr(M, "TERMS", 16)
    assert np.allclose(w.embeddings(x), w.embed(x)) and np.allclose(w.scores(x), w.embed(x) @ w.head[:-1] + w.head[-1])
    assert M.Weights.start(40, 5, 1).embeddings(x.slice(0, 0)).shape == (0, 5)


def test_shards_come_one_by_one():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"shard": s, "v": v}) for s, v in (([0, 0, 2], [1, 2, 3]), ([], []), ([2, 2], [4, 5]), ([5], [6]))]
    batches[1] = batches[0].slice(0, 0)
    assert [(n, b.column("v").to_pylist()) for n, b in M._shards(iter(batches))] == [(0, [1, 2]), (2, [3, 4, 5]), (5, [6])]
