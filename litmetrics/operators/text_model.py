"""A text classifier trained on Spark: an embedding bag of hashed n-grams with a logistic head.

A text is the set of its words and word pairs, and of those of its title once more, filed under `buckets` hashes by the JVM.
The mean of their vectors is the text's embedding; a logistic function of it is the probability.

Training is data parallel and stochastic. Rows are dealt to shards by a hash of their key, about SHARD rows each. In a pass
every shard takes mini-batch steps from the same start and returns what it changed: per bucket the change and how often
it was touched. Spark adds these up by bucket, and the next pass starts from the mean change, weighted by touches. The
loss is weighted by class (all classes count alike), the pace rises over the first tenth of all steps and then falls to
nothing, and training ends when `patience` passes have not lowered the loss on the validation rows; the best pass stays.
The driver and each task hold one model of buckets * width numbers, whatever the number of rows.

Defined results: a text without terms has embedding 0; keys may repeat; rows with a null label take no part; without
training rows all probabilities are 0.5; without validation rows all passes are run and the last one stays.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import paper_text, seeded
from .baselines import terms

BUCKETS, WIDTH, SHARD = 1 << 15, 16, 16_384
TERMS = 1 << 17  # whose vectors are held at once


def bag(title: Column, abstract: Column, buckets: int = BUCKETS) -> Column:
    """The different hashes of a paper's terms."""
    found = F.concat(terms(paper_text(title, abstract)), F.transform(terms(title), lambda t: F.concat(F.lit("title "), t)))
    return F.array_distinct(F.transform(found, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")))


@dataclass
class Texts:
    """A batch: ids of all texts one after the other, how many each has, labels and weights."""

    ids: np.ndarray
    sizes: np.ndarray
    y: np.ndarray
    w: np.ndarray

    def part(self, at: np.ndarray) -> Texts:
        ends = np.cumsum(self.sizes)
        n = self.sizes[at]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[at] - n, n)
        return Texts(self.ids[place], n, self.y[at], self.w[at])

    def slice(self, a: int, b: int) -> Texts:
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        return Texts(self.ids[ends[a] : ends[b]], self.sizes[a:b], self.y[a:b], self.w[a:b])

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Texts:
        lists = batch.column("ids")
        sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
        y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) if c in batch.schema.names else np.zeros(len(sizes)) for c in ("y", "w"))
        return cls(lists.flatten().to_numpy(zero_copy_only=False), sizes, y, w)


@dataclass
class Weights:
    table: np.ndarray  # (buckets, width)
    head: np.ndarray  # (width + 1), the intercept last

    @classmethod
    def start(cls, buckets: int, width: int, seed: int) -> Weights:
        rng = np.random.default_rng(seed)
        return cls((rng.random((buckets, width)) * 2 - 1) / width, np.append((rng.random(width) * 2 - 1) / width, 0.0))

    def embed(self, x: Texts) -> np.ndarray:
        """Mean vector of each text."""
        total = np.zeros((len(x.sizes) + 1, self.table.shape[1]))
        full = np.flatnonzero(x.sizes)
        if len(full):
            starts = np.cumsum(x.sizes) - x.sizes
            total[full] = np.add.reduceat(self.table[x.ids], starts[full], axis=0)
        return total[:-1] / np.maximum(x.sizes, 1)[:, None]

    def scores(self, x: Texts) -> np.ndarray:
        """What the logistic function is of, by one number a term: no vector is looked up."""
        owner = np.repeat(np.arange(len(x.sizes)), x.sizes)
        return np.bincount(owner, (self.table @ self.head[:-1])[x.ids], len(x.sizes)) / np.maximum(x.sizes, 1) + self.head[-1]

    def embeddings(self, x: Texts) -> np.ndarray:
        """embed() by slices of texts with about TERMS terms: what is held of the terms' vectors is bounded."""
        cuts = np.flatnonzero(np.diff(np.cumsum(x.sizes) // TERMS, prepend=0))
        edges = [0, *cuts[cuts > 0].tolist(), len(x.sizes)]
        return np.concatenate([self.embed(x.slice(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    def loss(self, x: Texts) -> float:
        z = self.scores(x)
        return float((x.w * (np.logaddexp(0, z) - x.y * z)).sum())

    def gradient(self, x: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the loss: the buckets touched, by their vectors, and by the head."""
        g = x.w * (1 / (1 + np.exp(-np.clip(self.scores(x), -500, 500))) - x.y)
        there = np.zeros(len(self.table), bool)
        there[x.ids] = True
        touched = np.flatnonzero(there)
        share = np.bincount(x.ids, np.repeat(g / np.maximum(x.sizes, 1), x.sizes), len(self.table))[touched]
        return touched, share[:, None] * self.head[:-1], np.append(share @ self.table[touched], g.sum())


def descend(start: Weights, x: Texts, pace: list[float], batch: int, seed: int) -> tuple[Weights, np.ndarray]:
    """Weights after a pass over x in mini-batches of a seeded order, each with its own pace (Adagrad's steps), and how
    often each bucket was touched."""
    own = Weights(start.table.copy(), start.head.copy())
    touches = np.zeros(len(own.table), np.int64)
    past, past_head = np.full(len(own.table), 1e-3), np.full(len(own.head), 1e-3)
    order = np.random.default_rng(seed).permutation(len(x.sizes))
    for step, a in enumerate(range(0, len(order), batch)):
        part = x.part(order[a : a + batch])
        touched, by_table, by_head = own.gradient(part)
        mass = max(part.w.sum(), 1e-12)
        by_table, by_head = by_table / mass, by_head / mass
        past[touched] += (by_table * by_table).mean(axis=1)
        past_head += by_head * by_head
        own.table[touched] -= pace[step] * by_table / np.sqrt(past[touched])[:, None]
        own.head -= pace[step] * by_head / np.sqrt(past_head)
        touches[touched] += 1
    return own, touches


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The shards of a task, whose rows are sorted by shard, one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = batch.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if held and held[0].column("shard")[0].as_py() != at[a]:
                yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _changes(out: list[tuple[int, float, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([float(o[1]) for o in out], pa.float64()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=["bucket", "n", "change"])


def paces(n: int, batch: int, passes: int, top: float, warm: float = 0.1) -> list[float]:
    """The pace of each step of all passes over n rows: up to `top` over the share `warm` of them, then down to nothing."""
    steps = passes * max(1, -(-n // batch))
    rise = max(1, int(warm * steps))
    return [top * min((s + 1) / rise, (steps - s) / max(1, steps - rise)) for s in range(steps)]


@dataclass
class TextModel:
    weights: Weights
    threshold: float = 0.5
    losses: tuple[float, ...] = ()  # of the validation rows before each pass and after the last

    def score(self, df: DataFrame, title: str = "Title", abstract: str = "Abstract", proba: str = "proba", embedding: str | None = None) -> DataFrame:
        """df with the probability and, where asked for, the embedding: one pass through Arrow, without a shuffle."""
        buckets, held = len(self.weights.table), df.sparkSession.sparkContext.broadcast(self.weights)
        fields = [T.StructField("_row", df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")).schema["_row"].dataType), T.StructField("_p", T.DoubleType()), T.StructField("_e", T.ArrayType(T.FloatType()))]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = held.value
            for batch in batches:
                texts = Texts.of(batch)
                p = 1 / (1 + np.exp(-np.clip(weights.scores(texts), -500, 500)))
                if not embedding:
                    yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(p), pa.nulls(len(p), pa.list_(pa.float32()))], names=["_row", "_p", "_e"])
                    continue
                h = weights.embeddings(texts)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1]), pa.array(h.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(p), vectors], names=["_row", "_p", "_e"])

        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), bag(F.col(title), F.col(abstract), buckets).alias("ids"))
        kept = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in (proba, embedding)]
        return rows.mapInArrow(work, T.StructType(fields)).select(*kept, F.col("_p").alias(proba), *([F.col("_e").alias(embedding)] if embedding else []))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        w = self.weights
        rows = pd.DataFrame({"bucket": np.arange(-1, len(w.table)), "vector": [w.head.tolist(), *w.table.tolist()]})  # the head first
        spark.createDataFrame(rows, "bucket int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        spark.createDataFrame([(json.dumps({"threshold": self.threshold, "losses": self.losses}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, path: str) -> TextModel:
        spark = SparkSession.active()
        rows = spark.read.parquet(f"{path}/weights").orderBy("bucket").toPandas()["vector"].tolist()
        config = json.loads(spark.read.text(f"{path}/config").first().value)
        return cls(Weights(np.array([list(r) for r in rows[1:]]), np.array(list(rows[0]))), config["threshold"], tuple(config["losses"]))


def fit(df: DataFrame, key: str, label: Column, split: str = "Split", title: str = "Title", abstract: str = "Abstract", w: Column | None = None, passes: int = 12, batch: int = 16, top: float = 1.0, patience: int = 2, buckets: int = BUCKETS, width: int = WIDTH, shard: int = SHARD, seed: int = 42) -> TextModel:
    """The model of the rows whose `split` is train, stopped by those whose split is val. label: 1 or 0."""
    spark = df.sparkSession
    picked = df.select(seeded(F.col(key), F.lit(seed)).alias("u"), (F.col(split) == "val").alias("val"), label.cast("double").alias("y"), (F.lit(1.0) if w is None else w.cast("double")).alias("w"), bag(F.col(title), F.col(abstract), buckets).alias("ids"))
    picked = picked.filter(F.col(split).isin("train", "val") & label.isNotNull())
    counts = {(r.val, r.y): (r.n, r.w) for r in picked.groupBy("val", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect()}  # two labels
    n = sum(c for (val, _), (c, _) in counts.items() if not val)
    weights, shards = Weights.start(buckets, width, seed), max(1, -(-n // shard))
    if not n:
        weights.head[:] = 0
        return TextModel(weights)
    mass = {y: m for (val, y), (_, m) in counts.items() if not val}
    balance = F.coalesce(*[F.when(F.col("y") == y, F.lit(sum(mass.values()) / (len(mass) * m))) for y, m in mass.items() if m > 0], F.lit(1.0))
    placed = picked.withColumn("w", F.col("w") * balance).withColumn("shard", F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int"))
    rows = placed.repartition(shards, "shard").sortWithinPartitions("shard", "val", "u", "ids").drop("u").cache()
    per = max(1, -(-n // shards))
    pace = paces(per, batch, passes, top)
    steps = len(pace) // passes
    best, losses = weights, []
    for nth in range(passes + 1):
        held = spark.sparkContext.broadcast(weights)

        def work(batches: Iterator[pa.RecordBatch], held=held, nth=nth) -> Iterator[pa.RecordBatch]:
            out: list[tuple[int, float, np.ndarray]] = []
            for number, own in _shards(batches):
                x, val = Texts.of(own), own.column("val").to_numpy(zero_copy_only=False)
                test = x.part(np.flatnonzero(val))
                out.append((-2, test.w.sum(), np.append(held.value.loss(test), np.zeros(width))))
                train = x.part(np.flatnonzero(~val))
                if nth == passes or not len(train.sizes):
                    continue
                mine = pace[nth * steps : (nth + 1) * steps]
                mine = mine + mine[-1:] * (-(-len(train.sizes) // batch))  # shards are not all of one size
                after, touches = descend(held.value, train, mine, batch, seed * 1_000_003 + nth * 10_007 + int(number))
                out.append((-1, float(len(train.sizes)), (after.head - held.value.head) * len(train.sizes)))
                hit = np.flatnonzero(touches)
                change = (after.table[hit] - held.value.table[hit]) * touches[hit][:, None]
                out += [(int(b), float(t), np.append(c, 0.0)) for b, t, c in zip(hit, touches[hit], change, strict=True)]
                yield _changes(out)
                out = []
            yield _changes(out)

        changes = rows.mapInArrow(work, "bucket int, n double, change array<double>").groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(F.get("change", F.lit(i))).alias(f"c{i}") for i in range(width + 1)]).toPandas()
        held.destroy()
        facts = changes.to_numpy(float)
        found = {int(r[0]): r for r in facts if r[0] < 0}
        tested = found.get(-2)
        if tested is not None and tested[1] > 0:
            losses.append(float(tested[2] / tested[1]))
            if losses[-1] <= min(losses):
                best = weights
            elif len(losses) - 1 - int(np.argmin(losses)) >= patience:
                break
        else:
            best = weights
        if nth == passes:
            break
        weights = Weights(weights.table.copy(), weights.head + found[-1][2:] / found[-1][1])
        facts = facts[facts[:, 0] >= 0]
        weights.table[facts[:, 0].astype(int)] += facts[:, 2:-1] / facts[:, 1:2]
    rows.unpersist()
    return TextModel(best, losses=tuple(losses))


def chosen_threshold(model: TextModel, df: DataFrame, label: Column, title: str = "Title", abstract: str = "Abstract") -> float:
    """The first threshold with the largest F1 over the rows of df and copies of them without abstracts."""
    from . import metrics, sampling

    scored = model.score(sampling.with_title_only_copies(df.select(title, abstract, label.cast("int").alias("_y")), abstract), title, abstract)
    found = metrics.best_threshold(metrics.threshold_sweep(scored, F.col("_y"), F.col("proba"), F.lit(1.0))).first()
    return float(found.t) if found is not None and found.t is not None and not math.isnan(found.f1) else 0.5
