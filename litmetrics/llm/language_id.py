"""Language ID by Bayesian evidence fusion.

posterior(l) ~ likelihood(text | l)^temper * P(declared | l) * prior(l | host)

* Text: hashed byte trigrams with additive smoothing, learned from at most `per_language` documents of each declared
  language (a bounded sample, the smallest hashes of the row key; whole texts). One more class, `und`, spreads its
  probability evenly over the trigram space: text that no language explains falls to it.
* Declared language (a markup `lang` attribute or a column): right with probability `reliability`.
* Host prior: counts of declared languages by grouped aggregation over all rows, smoothed hierarchically from all rows
  to the address suffix (last label of the host, if it has a dot) and from the suffix to the host.

A row is rejected if `und` wins, if the best posterior is below `min_posterior`, or if there is no text to judge.

Defined results: null or blank text is `und` and rejected; null hosts share one prior, null declarations tell nothing;
declarations count by their primary subtag (`en-us` is `en`); every declared language is known; a table without
declarations knows no language and rejects all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, materialise, pieces, releasing, utf8_column, with_uid

BUCKETS = 1 << 14
UNKNOWN = "und"
BLOCK = 1 << 18
SHARES = 16
TOGETHER = 64  # languages scored at a time


def trigrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of texts and how many each text has; a blank stands before and after every text."""
    low = data.astype(np.uint32)
    low = np.where((low >= 65) & (low <= 90), low + 32, low)
    low = np.where((low == 32) | ((low >= 9) & (low <= 13)), 32, low)
    padded = np.insert(low, np.repeat(offsets, 1), 32)  # one blank before each text and one at the end
    code = (padded[:-2] * np.uint32(0x9E3779B1)) ^ (padded[1:-1] * np.uint32(0x85EBCA77)) ^ (padded[2:] * np.uint32(0xC2B2AE3D))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    size = np.diff(offsets)
    begin = offsets[:-1] + np.arange(len(size))
    inside = np.repeat(size > 0, size)
    at = np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(offsets[:-1], size)
    return (code[at[inside]] >> np.uint32(18)).astype(np.int64), size


def _counting(languages: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        index = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            declared = batch.column("_declared").to_pylist()
            offsets, data = utf8_column(batch, "_text")
            for i, j in pieces(offsets, BLOCK):
                code, size = trigrams(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                which = np.repeat([index[x] for x in declared[i:j]], size)
                cells, n = np.unique(which * BUCKETS + code, return_counts=True)
                total.reshape(-1)[cells] += n
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    return work


def train(docs: DataFrame, per_language: int) -> tuple[list[str], np.ndarray]:
    """docs (_uid, _text, _declared): languages, and log probabilities of trigrams for each and for `und`."""
    counts = docs.filter("_declared is not null").groupBy("_declared").agg(F.count(F.lit(1)).alias("n"))
    languages = [r["_declared"] for r in counts.orderBy(F.desc("n"), "_declared").collect()]
    if not languages:
        return [], np.full((1, BUCKETS), -math.log(BUCKETS), np.float32)
    known = docs.filter("_declared is not null")
    # ranked in shares first, so that no task ranks more than SHARES * per_language rows of a language in the end
    chosen = known.select("_uid", "_declared", (F.spark_partition_id() % SHARES).alias("_share"))
    for group in (["_declared", "_share"], ["_declared"]):
        nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64("_uid"), "_uid"))
        chosen = chosen.withColumn("nth", nth).filter(F.col("nth") <= per_language).drop("nth")
    chosen = chosen.select("_uid")
    # at most per_language keys a language, of eight bytes
    sample = known.join(F.broadcast(chosen), "_uid", "left_semi").select("_text", "_declared")
    parts = sample.mapInArrow(releasing(_counting(languages)), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages) + 1, BUCKETS))
    cells = parts.toArrow()  # at most languages * buckets rows
    table[cells["lang"].to_numpy(), cells["bucket"].to_numpy()] = cells["n"].to_numpy()
    smooth = 0.5
    logs = np.log((table + smooth) / (table.sum(axis=1, keepdims=True) + smooth * BUCKETS))
    return languages, logs.astype(np.float32)


def _scoring(table: np.ndarray, passed: list[str], inner: str | None):
    """Scores of `_text`, or of the field `inner` of `_row`: no text travels twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [np.ascontiguousarray(table[i : i + TOGETHER].T) for i in range(0, len(table), TOGETHER)]
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column("_row").field(inner) if inner else batch.column("_text")], names=["_text"])
            offsets, data = utf8_column(texts, "_text")
            scores, grams = [], []
            for i, j in pieces(offsets, BLOCK):
                code, size = trigrams(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                edge = np.concatenate([[0], np.cumsum(size)])
                some = []
                for flat in blocks:
                    sums = np.zeros((len(code) + 1, flat.shape[1]))
                    np.cumsum(flat[code], axis=0, out=sums[1:], dtype=np.float64)
                    some.append(sums[edge[1:]] - sums[edge[:-1]])
                scores.append(np.hstack(some))
                grams.append(size)
            score = np.concatenate(scores) if scores else np.zeros((0, len(table)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(score) + 1, dtype=np.int32) * len(table)), pa.array(score.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), lists, pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64))], names=[*passed, "_scores", "_grams"])

    return work


def host_priors(docs: DataFrame, languages: list[str], strength: float = 20.0) -> DataFrame:
    """(_host, _prior): P(language | host) for each language in turn, smoothed host <- suffix <- all rows."""
    k = len(languages)
    said = docs.groupBy("_host", "_suffix", "_declared").agg(F.count(F.lit(1)).cast("double").alias("n"))
    places = docs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(languages)], "_declared string, i int")
    said = said.join(F.broadcast(places), "_declared", "left")  # one row a language

    def spread(df: DataFrame, by: list[str]) -> DataFrame:
        """by, and the counts of the languages in turn."""
        found = F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "n"))))
        return df.groupBy(*by, "i").agg(F.sum("n").alias("n")).groupBy(*by).agg(found.alias("_found")).select(*by, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("_found", i), F.lit(0.0))).alias("_n"))

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    hosts, suffixes = spread(said, ["_host", "_suffix"]), spread(said, ["_suffix"])
    whole = {r.i: r.n for r in said.filter("i is not null").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    number = sum(whole.values())
    top = F.array(*[F.lit(strength * (whole.get(i, 0.0) + 1) / (number + k)) for i in range(k)])
    suffixes = suffixes.select(F.col("_suffix").alias("_s"), F.zip_with("_n", top, lambda n, t: (n + t) / (total(F.col("_n")) + strength)).alias("_above"))
    joined = hosts.join(suffixes, F.col("_suffix") == F.col("_s"))
    return joined.select(F.col("_host").alias("_h"), F.zip_with("_n", "_above", lambda n, s: (n + strength * s) / (total(F.col("_n")) + strength)).alias("_prior"))


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", declared: str | None = "lang", host: str | None = "source", per_language: int = 500, reliability: float = 0.9, temper: float = 0.2, min_posterior: float = 0.5, unknown_prior: float = 0.01, carry: list[str] | None = None) -> DataFrame:
    """df's rows as _row (a struct of the columns `carry`, all by default) with language, posterior and accepted."""
    col = lambda c: F.col(f"`{c}`")
    picked = df.select(
        F.struct(*[col(c) for c in carry or df.columns]).alias("_row"), col(key).alias("_key"), col(text).alias("_text"),
        (F.nullif(F.substring_index(F.translate(F.lower(F.trim(col(declared).cast("string"))), "_", "-"), "-", 1), F.lit("")) if declared else F.lit(None).cast("string")).alias("_declared"),
        (F.coalesce(F.lower(col(host).cast("string")), F.lit("")) if host else F.lit("")).alias("_host"),
    )
    docs = with_uid(picked, "_key", ["_row", "_text", "_declared", "_host"]).withColumn("_suffix", F.when(F.col("_host").contains("."), F.element_at(F.split("_host", r"\."), -1)).otherwise(F.lit("")))
    languages, table = train(docs, per_language)
    k = len(languages)
    kinds = ["_row", "_declared", "_host"]
    inner = text if text in (carry or df.columns) else None
    scored = docs.select(*kinds, *([] if inner else ["_text"])).mapInArrow(releasing(_scoring(table, kinds, inner)), fields(docs, kinds, "_scores array<double>, _grams long"))
    if not k:
        return scored.select("_row", F.lit(UNKNOWN).alias("language"), F.lit(1.0).alias("posterior"), F.lit(False).alias("accepted"))
    # one row per host, written so that its size is known: Spark broadcasts it if it is small, without a shuffle of the
    # texts, else joins by sorting and splits hot hosts
    priors = materialise(host_priors(docs, languages), "priors")
    fused = scored.join(priors, F.col("_host") == F.col("_h"), "left")
    wrong = (1 - reliability) / max(1, k - 1)

    # null where nothing is declared: every declared language is known
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("_declared")).cast("int") - 1
    fused = fused.withColumn("_place", place)

    def evidence(both, i):
        said = F.when(F.col("_place") == i, math.log(reliability)).when(F.col("_place").isNotNull(), math.log(wrong) if wrong > 0 else -50.0).otherwise(0.0)
        return both["_scores"] * temper + said + F.log(both["_prior"]) + math.log(1 - unknown_prior)

    unknown = F.element_at("_scores", k + 1) * temper + math.log(unknown_prior)
    known = F.arrays_zip(F.slice("_scores", 1, k).alias("_scores"), F.col("_prior"))
    fused = fused.withColumn("_log", F.concat(F.transform(known, evidence), F.array(unknown)))
    fused = fused.withColumn("_best", F.array_max("_log"))
    mass = F.aggregate("_log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best")))
    names = F.array(*[F.lit(x) for x in [*languages, UNKNOWN]])
    empty = F.col("_grams") == 0
    named = fused.select("_row", F.when(empty, F.lit(UNKNOWN)).otherwise(F.element_at(names, F.array_position("_log", F.col("_best")).cast("int"))).alias("language"), F.when(empty, 1.0).otherwise(1 / mass).alias("posterior"))
    return named.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= min_posterior))


def identify_pages(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", **options) -> DataFrame:
    """identify() for web pages: what the markup declares (`lang` of the html element) and the host of the URL are the evidence."""
    col = lambda c: F.col(f"`{c}`")
    said = F.regexp_extract(F.coalesce(col(page), F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1)
    host = F.regexp_replace(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[^/?#]*://([^/?#]*)", 1), r"^.*@|:\d*$", "")
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("_row"), col(key).alias("_id"), col(page).alias("_page"), F.nullif(said, F.lit("")).alias("_said"), host.alias("_from"))
    return identify(rows, "_id", "_page", "_said", "_from", carry=["_row"], **options).select("_row._row", "language", "posterior", "accepted")


def keep_identified(df: DataFrame, **options) -> DataFrame:
    """df without the rows that identify() rejects, all columns kept."""
    return identify(df, **options).filter("accepted").select("_row.*")
