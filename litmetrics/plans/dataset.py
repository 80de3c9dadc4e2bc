"""Labelled datasets: projections, routing, exclusion and year-matched negatives as one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_record_text, norm_title, paper_text
from ..operators import matching, profiles, rules, sampling

SURVEY, RESEARCH = 0, 1
SURVEY_TYPES = ("article", "review")
SHORTEST_TEXT = 20


def labelled_rows(works: DataFrame, venues: DataFrame) -> DataFrame:
    """Rows of the index (profiles.work_to_row, with `source`, the venue's id) of the venues (source, Venue, Group, Label)."""
    rows = works.drop("venue").join(venues, "source")  # the venue's own name, not the index's
    return rows.select(
        clean_record_text(F.col("title")).alias("Title"), clean_record_text(F.col("abstract")).alias("Abstract"), "Label", "Venue", "Group",
        F.col("year").alias("Year"), F.col("citationCount").alias("Citation"), "ReferenceCount", F.col("type").alias("Type"), F.col("id").alias("OpenAlexId"), F.col("doi").alias("DOI"),
    )


def routed(rows: DataFrame) -> DataFrame:
    """rows with `Route`: unusable, no survey type, hard case (its label is for a human to say), or kept."""
    survey = F.col("Label") == SURVEY
    return matching.first_reason(rows, {
        "unusable": ~rules.usable_record(F.col("Title"), F.col("Abstract")),
        "no survey type": survey & ~F.coalesce(F.col("Type").isin(*SURVEY_TYPES), F.lit(False)),
        "hard case": ~survey & F.coalesce(rules.is_hard_case(F.col("Title"), F.col("Type")), F.lit(True)),
    }).withColumnRenamed("reason", "Route")


def assemble(rows: DataFrame, excluded: list[DataFrame], groups: list[str], key: str = "OpenAlexId", seed: int = 42) -> DataFrame:
    """Surveys of the kept rows and as many research papers of the same group and years, with `Place`, a global random order.

    Titles count once within a class (the smallest id), titles of both classes and those of the excluded tables (one
    column of keys each) go. groups: the names of the groups; each is matched by itself.
    """
    keyed = rows.withColumn("_key", norm_title(F.col("Title")))
    single = profiles.first_per(keyed, ["Label", "_key"], F.col(key))
    clean = matching.without_keys(matching.without_clashes(single, "_key", "Label"), "_key", *excluded)
    parts = []
    for group in groups:
        own = clean.filter(F.col("Group") == group)
        surveys, pool = own.filter(F.col("Label") == SURVEY), own.filter(F.col("Label") == RESEARCH)
        need = surveys.groupBy("Year").agg(F.count(F.lit(1)).alias("need"))
        parts += [surveys, sampling.year_matched(pool, need, key, "Year", seed)]
    return sampling.shuffled(reduce(DataFrame.unionByName, parts).drop("_key"), key, seed, "Place")


def build(works: DataFrame, venues: DataFrame, excluded: list[DataFrame], groups: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The dataset, and the hard cases for a human to label (one row a title)."""
    rows = routed(labelled_rows(works, venues))
    hard = profiles.first_per(rows.filter("Route = 'hard case'"), ["Title"], F.col("OpenAlexId")).withColumn("Label", F.lit(None).cast("int"))
    return assemble(rows.filter("Route = 'kept'").drop("Route"), excluded, groups, seed=seed), hard.drop("Route")


def matched_records(works: DataFrame, records: DataFrame, title: str = "title", record_id: str = "record") -> DataFrame:
    """works with the record of the same title key, if there is one; of several records of a key the smallest id."""
    keyed = records.withColumn("_key", norm_title(F.col(title))).filter("_key <> ''").groupBy("_key").agg(F.min(record_id).alias(record_id))
    return works.withColumn("_key", norm_title(F.col(title))).join(keyed, "_key")


def load(df: DataFrame, key: str) -> DataFrame:
    """Rows labelled 0 or 1 with title and abstract and `Text` of more than SHORTEST_TEXT characters, each text once."""
    known = df.filter(F.col("Label").cast("string").isin("0", "1") & F.col("Title").isNotNull() & F.col("Abstract").isNotNull())
    texts = known.withColumn("Label", F.col("Label").cast("int")).withColumn("Text", paper_text(F.col("Title"), F.col("Abstract")))
    return profiles.first_per(texts.filter(F.length("Text") > SHORTEST_TEXT), ["Text"], F.col(key))


def with_copies(df: DataFrame, score) -> DataFrame:
    """Rows and their title-only copies with `proba` by score(title, abstract): what a threshold is chosen on."""
    both = sampling.with_title_only_copies(df.withColumn("Abstract", F.coalesce("Abstract", F.lit(""))), "Abstract")
    return both.withColumn("proba", score(F.col("Title"), F.col("Abstract")))

