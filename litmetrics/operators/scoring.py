"""Scorers of texts: the trained text model, or a deterministic stand-in made of cues where none has been trained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from .features import cue_proba, cues
from .text_model import TextModel


def cue_score(title: Column, abstract: Column) -> Column:
    """Stand-in probability from cues: logistic in title terms, survey cues and research cues."""
    return cue_proba(**cues(clean_text(title), clean_text(abstract)))


def with_proba(df: DataFrame, model: TextModel | None = None, embedding: str | None = None, proba: str = "proba") -> DataFrame:
    """df (Title, Abstract) with the survey probability: by the trained text model where there is one, whose embedding may be
    asked for as well, else by the cues."""
    if model is not None:
        return model.score(df, proba=proba, embedding=embedding)
    return df.withColumn(proba, cue_score(F.col("Title"), F.col("Abstract")))
