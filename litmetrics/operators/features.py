"""Features of the learned hybrid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import capped_count, clean_text, has, has_part, has_words, logit, text_of

BASE = ("bert_logit", "title_terms", "abstract_survey_cues", "abstract_research_cues", "abstract_missing", "log_refs", "refs_missing")
FLAGS = ("magazine", "arxiv", "type_review", "this_article")


def cleaned(df: DataFrame, title: str = "Title", abstract: str = "Abstract") -> DataFrame:
    """df with `_title` and `_abstract`, cleaned once for all that reads them."""
    return df.withColumn("_title", clean_text(F.col(title))).withColumn("_abstract", clean_text(F.col(abstract)))


def cues(title: Column, abstract: Column) -> dict[str, Column]:
    """What is counted in the cleaned texts."""
    return {
        "title_terms": has(title, V.TITLE_TERMS).cast("int"),
        "abstract_survey_cues": capped_count(abstract, V.ABSTRACT_SURVEY, stems=V.ABSTRACT_SURVEY_STEMS),
        "abstract_research_cues": capped_count(abstract, V.ABSTRACT_RESEARCH, stems=V.ABSTRACT_RESEARCH_STEMS),
    }


def cue_proba(title_terms: Column, abstract_survey_cues: Column, abstract_research_cues: Column) -> Column:
    """Logistic in title terms, survey cues and research cues."""
    z = -2.0 + 3.0 * title_terms + 1.0 * abstract_survey_cues - 1.0 * abstract_research_cues
    return 1 / (1 + F.exp(-z))


def base_features(title: Column, abstract: Column, refs: Column, proba: Column, clean: bool = False, counted: dict[str, Column] | None = None) -> dict[str, Column]:
    """clean: title and abstract have been cleaned already; counted: so have the cues been counted."""
    t, a = (title, abstract) if clean else (clean_text(title), clean_text(abstract))
    refs = F.coalesce(refs, F.lit(0))
    return {
        "bert_logit": logit(proba),
        **(counted or cues(t, a)),
        "abstract_missing": (~has_words(a, V.MIN_WORDS_MISSING)).cast("int"),
        "log_refs": F.when(refs > 0, F.log1p(refs)).otherwise(0.0),
        "refs_missing": (refs <= 0).cast("int"),
    }


def flag_features(abstract: Column, venue: Column, kind: Column) -> dict[str, Column]:
    """Flags read the raw texts."""
    return {
        "magazine": text_of(venue).rlike(f"(?iU){V.MAGAZINES}").cast("int"),
        "arxiv": has_part(venue, "arxiv").cast("int"),
        "type_review": has(kind, "review").cast("int"),
        "this_article": has(abstract, V.THIS_ARTICLE, V.THIS_ARTICLE_STEMS).cast("int"),
    }


def hybrid_features(df: DataFrame, proba: str | None, embedding: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns and `features`, an array of the base features, the flags and the embedding. Without the column of a
    probability it is that of the cues, which are counted once for both."""
    df = cleaned(df)
    counted = None
    if proba is None:
        df = df.withColumns({f"_{n}": c for n, c in cues(F.col("_title"), F.col("_abstract")).items()})
        counted = {n: F.col(f"_{n}") for n in ("title_terms", "abstract_survey_cues", "abstract_research_cues")}
        proba, df = "_proba", df.withColumn("_proba", cue_proba(**counted))
    cols = base_features(F.col("_title"), F.col("_abstract"), F.col("ReferenceCount"), F.col(proba), clean=True, counted=counted) | flag_features(F.col("Abstract"), F.col("Venue"), F.col("Type"))
    vector = F.array(*[c.cast("double") for c in cols.values()])
    if embedding:
        vector = F.concat(vector, F.col(embedding).cast("array<double>"))
    return df.select(*keep, vector.alias("features"))
