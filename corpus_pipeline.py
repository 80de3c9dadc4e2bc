"""From raw documents to packed training sequences.

language ID -> one document of each class of near duplicates -> repeated passages removed -> mixing to target weights ->
packing. Every stage works on all rows that its predecessor kept and, but for the last, returns the columns of documents.

Defined results: a document with a null or blank text has no language and goes at the first stage; rows with repeated or
null ids are documents of their own; null sources are one source; further columns are carried along; an empty table
gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmetrics.llm import dart_minhash, language_id, mixing, packing, suffix_dedup
from litmetrics.llm.common import discard, materialise
from litmetrics.llm.queries import vocabulary

#: language likelihoods, the random pairing of the mix and tokens cannot be stated in SQL
ORACLE_SQL = None

#: passages of over 50 words are repeats wherever they begin; 50 leaves a word that a neighbour's punctuation changes
PASSAGE = 50


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language; `lang` becomes the language found."""
    found = language_id.identify(docs).filter("accepted")
    return found.select(*[F.col("language").alias(c) if c == "lang" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id."""
    return dart_minhash.near_dedup(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE words or more that stand in another document too; `n_chars` counts what is left.

    Documents of which no word is left go.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_body"))
    cut = suffix_dedup.suffix_dedup(rows, "_id", "_body", min_words=PASSAGE, across=True, keep="text", carry=["_row"])
    clean = cut.filter(F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    left = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return clean.select(*[left.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and where they stand in the sequences; a document taken twice is packed twice."""
    return packing.pack_documents(docs, *vocabulary())


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("suffix_dedup", remove_repeats), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
