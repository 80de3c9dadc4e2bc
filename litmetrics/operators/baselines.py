"""Text-classification baseline: TF-IDF of words and word pairs, and a linear support vector machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import postings, svm
from .sampling import shuffled


def terms(text: Column) -> Column:
    """Lower-cased words of at least two word characters, then the pairs of neighbouring ones."""
    return F.transform(F.array(postings.words(text)), _with_pairs)[0]


def _with_pairs(words: Column) -> Column:
    """Words and pairs of one array of words, which is named once so that it is built once."""
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.concat(words, pairs)


def term_counts(text: Column) -> Column:
    """array<struct<term, tf>>: the different terms of a text and how often it holds each, from one sort of its terms."""
    return F.transform(F.array(F.sort_array(terms(text))), _runs)[0]


def _runs(ordered: Column) -> Column:
    n = F.size(ordered)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
    run = lambda own: F.transform(own, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(own, k + 1), n) - i).alias("tf")))
    return F.transform(F.array(starts), run)[0]


BLOCK = 2048  # documents of a block, which asks for the frequency of a term once


@dataclass
class _Blocks:
    """Occurrences (_block, key, term, tf) of documents dealt out in blocks, and what is found out about a block's terms.

    Only the texts, a block's different terms and the answers are shuffled. The answers come back to where the
    occurrences are: both lie by block, so neither their union nor the windows over it move them again.
    """

    rows: DataFrame
    number: int
    key: str

    @classmethod
    def of(cls, df: DataFrame, key: str, text: Column, n: int) -> _Blocks:
        number = 1 + n // BLOCK
        dealt = df.select(F.pmod(F.xxhash64(key), F.lit(number)).cast("int").alias("_block"), F.col(key), text.alias("_text")).repartition(number, "_block")
        # rows of one key are one document
        whole = dealt.groupBy("_block", key).agg(F.collect_list("_text").alias("_texts"))
        one = whole.filter(F.size("_texts") == 1).select("_block", key, F.inline(term_counts(F.get("_texts", F.lit(0)))))
        many = whole.filter(F.size("_texts") > 1).select("_block", key, F.explode("_texts").alias("_text")).select("_block", key, F.inline(term_counts(F.col("_text"))))
        return cls(one.unionByName(many.groupBy("_block", key, "term").agg(F.sum("tf").cast("int").alias("tf"))), number, key)

    def asked(self) -> DataFrame:
        """(_block, term, n): in how many of the block's documents a term is."""
        return self.rows.groupBy("_block", "term").agg(F.count(F.lit(1)).alias("n"))

    def weights(self, answers: DataFrame) -> DataFrame:
        """(key, term, weight) by the answers (_block, term, idf), at most one for each."""
        back = answers.select("_block", F.lit(None).cast(self.rows.schema[self.key].dataType).alias(self.key), "term", F.lit(None).cast("int").alias("tf"), "idf").repartition(self.number, "_block")
        both = self.rows.withColumn("idf", F.lit(None).cast("double")).unionByName(back)
        known = both.withColumn("idf", F.max("idf").over(Window.partitionBy("_block", "term"))).filter("tf is not null and idf is not null")
        raw = known.select("_block", self.key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("_raw"))
        length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy("_block", self.key)))
        return raw.select(self.key, "term", (F.col("_raw") / length).alias("weight"))


@dataclass
class TfIdf:
    """Inverse document frequencies (term, idf) of the terms that at least `min_df` documents of the fitted rows hold."""

    idf: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, text: Column, min_df: int = 2) -> TfIdf:
        total = df.agg(F.count(F.lit(1)).alias("_n"))  # one row
        per = df.select(F.explode(F.array_distinct(terms(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
        return cls(per.crossJoin(F.broadcast(total)).select("term", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf")))

    def transform(self, df: DataFrame, key: str, text: Column) -> DataFrame:
        """(key, term, weight): (1 + ln tf) * idf, scaled to length 1 by document; unknown terms are left out."""
        blocks = _Blocks.of(df, key, text, df.count())
        return blocks.weights(blocks.asked().join(self.idf, "term").select("_block", "term", "idf"))


def tfidf_weights(df: DataFrame, key: str, text: Column, min_df: int = 2) -> DataFrame:
    """(key, term, weight) of the documents by their own frequencies: fit and transform in one, a term's frequency being the
    sum over the blocks that ask for it. Questions go compressed, answers as numbers in the questions' order."""
    n = df.count()
    number = postings.blocks_of(n)
    rows = postings.dealt(df, key, number, text)
    answers = postings.answered(postings.asked(rows, number, False))
    return postings.weighed(rows, answers, key, number, number, n, min_df)


def dictionary(idf: DataFrame) -> DataFrame:
    """(term, i): the terms numbered from 1 on, by ranges of their hashes and the counts before: no vocabulary is collected."""
    return shuffled(idf.select("term"), "term", 0, "i")


def sparse(weights: DataFrame, key: str, numbers: DataFrame) -> DataFrame:
    """(key, at, value): the weights of a document by the numbers of their terms, ascending."""
    cells = F.sort_array(F.collect_list(F.struct("i", "weight")))
    return weights.join(numbers, "term").groupBy(key).agg(cells.alias("_c")).select(key, F.col("_c.i").alias("at"), F.col("_c.weight").alias("value"))


def _passes(posts: DataFrame, tasks: int, total: int, n: int, all_n: int):
    """Functions over the postings: the squared lengths of all documents, and of numbers of the fitted ones (each document's times
    its value in a term, added up by term) the sums over the terms of each fitted, or of each other, document."""
    spark, held = posts.sparkSession, posts.coalesce(tasks)
    own, other = ["df", "sizes", "rows", "places", "tf"], ["others", "other_rows", "other_places", "other_tf"]

    def summed(numbers: np.ndarray | None, others: bool) -> np.ndarray:
        sent = spark.sparkContext.broadcast(numbers)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given, out = sent.value, np.zeros(all_n)
            waiting, many = [], 0

            def add():
                if waiting:
                    rows, values = waiting[0] if len(waiting) == 1 else (np.concatenate(x) for x in zip(*waiting))
                    out[:] += np.bincount(rows, values, all_n)
                    waiting.clear()

            for batch in batches:
                for nth in range(batch.num_rows):
                    df, *ints = (np.frombuffer(batch.column(x)[nth].as_buffer(), np.int32) for x in range(batch.num_columns))
                    idf = np.log((1 + total) / (1 + df)) + 1
                    by_term = idf * idf
                    if given is not None and len(df):
                        sizes, rows, places, tf = ints[:4]
                        own = given[rows]
                        own[places] *= 1 + np.log(tf)
                        by_term *= np.add.reduceat(own, np.cumsum(sizes) - sizes)
                    for first in (0, 4) if given is None else (4,) if others else (0,):
                        sizes, rows, places, tf = ints[first : first + 4]
                        values = np.repeat(by_term, sizes)
                        values[places] *= (1 + np.log(tf)) ** (2 if given is None else 1)
                        waiting.append((rows, values))
                        many += len(rows)
                    if many > all_n:
                        add()
                        many = 0
            add()
            yield from svm.parts(0, out)

        out = svm.added(held.select(*own, *(other if others else [])).mapInArrow(work, "at int, sums binary"), all_n, tasks)
        sent.destroy()
        return out

    return lambda: summed(None, True), lambda a: summed(a, False)[:n], lambda a: summed(a, True)[n:]


def tfidf_svm(train: DataFrame, test: DataFrame, key: str, text: Column, label: str, c: float = 1.0) -> DataFrame:
    """(key, p, margin) for the rows of test; train holds the 0/1 column `label`. Rows without known terms get p 0 or 1 by the intercept.

    The machine with squared hinge loss over the terms that two rows of train hold, of TF-IDF rows. Postings are read term by
    term: a task holds all of a term's documents, so a pass sends a number for each document, and none for a term.
    """
    spark = train.sparkSession
    context = spark.sparkContext
    rows = [x.count() for x in (train, test)]
    numbers = [postings.blocks_of(x) for x in rows]
    fitted, first = numbers[0], (0, numbers[0])
    labels = postings.dealt(train, key, fitted, extra=(label,)).groupBy("_block", "_at").agg(F.sum(F.col(label) * 1.0).alias("pos"), F.count(label).alias("n")).toArrow()
    places = postings.dealt(test, key, numbers[1], first=fitted).select("_block", "_at", key).distinct()
    starts = np.zeros(sum(numbers) + 1, np.int64)
    np.add.at(starts, labels["_block"].to_numpy() + 1, 1)
    for block, held in places.groupBy("_block").count().collect():
        starts[block + 1] = held
    starts = np.cumsum(starts)
    n, all_n = int(starts[fitted]), int(starts[-1])
    pos, neg = np.zeros(n), np.zeros(n)
    at = starts[labels["_block"].to_numpy()] + labels["_at"].to_numpy()
    pos[at] = c * labels["pos"].to_numpy()
    neg[at] = c * labels["n"].to_numpy() - pos[at]
    ranges = postings.blocks_of(sum(rows))
    both = [postings.dealt(x, key, k, text, first=f) for x, k, f in zip((train, test), numbers, first)]
    posts = postings.posted(postings.asked(both[0].unionByName(both[1]), ranges, True), starts, fitted).cache()
    lengths, product, others = _passes(posts, min(ranges, context.defaultParallelism), rows[0], n, all_n)
    length = lengths() ** 0.5
    inverse = np.divide(1, length, out=np.zeros(all_n), where=length > 0)
    a = svm.solve(lambda a: inverse[:n] * product(inverse[:n] * a) + a.sum(), pos, neg)
    intercept = float(a.sum())
    margins = context.broadcast(inverse[n:] * others(inverse[:n] * a) + intercept)
    posts.unpersist()

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = starts[batch.column("_block").to_numpy()] - n + batch.column("_at").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(margins.value[at])], names=[key, "margin"])

    scored = places.mapInArrow(looked_up, StructType([places.schema[key], StructField("margin", DoubleType())]))
    margin = F.coalesce("margin", F.lit(intercept))
    return test.select(key).join(scored, key, "left").select(key, (margin > 0).cast("int").alias("p"), margin.alias("margin"))
