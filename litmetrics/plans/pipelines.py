"""Composite plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_is_survey, last_segment, paper_text
from ..operators import baselines, features, hybrid, indices, metrics, profiles, rules, sampling, scoring, text_model
from ..operators.text_model import TextModel
from . import evaluation

VECTOR = "_embedding"

WORK = "struct<id:string,title:string,doi:string,abstract_inverted_index:map<string,array<int>>,primary_location:struct<source:struct<id:string,display_name:string>>,authorships:array<struct<author:struct<id:string,display_name:string>,institutions:array<struct<display_name:string>>>>,cited_by_count:long,referenced_works_count:long,publication_year:int,type:string>"


RECORD = "struct<paperId:string,title:string,abstract:string,authors:array<struct<name:string>>,citationCount:long,references:array<struct<paperId:string>>,venue:string,year:int,publicationTypes:array<string>>"


def scored(df: DataFrame, model: hybrid.Hybrid | None = None, embedding: str | None = None, threshold: float = 0.5, scorer: TextModel | None = None) -> DataFrame:
    """A profile with `_score`, the survey probability, and `_survey`: by the fitted hybrid where there is one, else by the
    trained text model alone, else by the cues alone. embedding: a column of df that the hybrid was fitted with."""
    profiles.require_columns(df, "title", "citationCount")
    text = lambda *names: F.coalesce(profiles.pick(df, *names).cast("string"), F.lit(""))
    title, abstract = text("Title", "title"), text("Abstract", "abstract")
    if model is None and scorer is None:
        score = scoring.cue_score(title, abstract)
        return df.withColumn("_score", score).withColumn("_survey", score >= threshold)
    frame = df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    keep = ("_row", *([embedding] if embedding else []))
    frame = scoring.with_proba(profiles.normalize(frame, keep=keep), scorer, None if embedding or model is None else VECTOR)
    if model is None:
        return frame.select("_row.*", F.col("proba").alias("_score"), (F.col("proba") >= scorer.threshold).alias("_survey"))
    embedding = embedding or (VECTOR if scorer is not None else None)
    found = model.predict(features.hybrid_features(frame, "proba", embedding, keep=("_row",)))
    return found.select("_row.*", F.col("hybrid_proba").alias("_score"), (F.col("is_survey") == 1).alias("_survey"))


def classify(df: DataFrame, threshold: float = 0.5, model: hybrid.Hybrid | None = None, embedding: str | None = None, scorer: TextModel | None = None) -> DataFrame:
    """A profile with Category, SurveyScore (four decimals, half to even) and Keep; model: a fitted hybrid decides; scorer: a
    trained text model gives the probability (and the embedding) in place of the cues."""
    rows = scored(df, model, embedding, threshold, scorer)
    text = lambda *names: F.coalesce(profiles.pick(df, *names).cast("string"), F.lit(""))
    title, abstract, venue, kind = (text(n, n.lower()) for n in ("Title", "Abstract", "Venue", "Type"))
    category = rules.categorize(title, abstract, venue, kind, F.col("_survey"))
    rows = rows.withColumn("SurveyScore", F.bround("_score", 4)).withColumn("Category", category).withColumn("Keep", F.col("Category") != "survey")
    return rows.drop("_score", "_survey")


def works_from_json(raw: DataFrame, keep_source: bool = False) -> DataFrame:
    """Flat rows of works as JSON (column `record`); keep_source adds `source`, the id of the venue."""
    works = raw.select(F.from_json("record", WORK).alias("w")).select("w.*")
    return profiles.work_to_row(works, **({"source": last_segment(F.col("primary_location.source.id"))} if keep_source else {}))


def records_from_json(raw: DataFrame) -> DataFrame:
    """Flat rows of paper records as JSON (column `record`)."""
    return profiles.record_to_row(raw.select(F.from_json("record", RECORD).alias("r")).select("r.*"))


def method_flags(title, abstract, venue, kind) -> dict:
    """Rule methods side by side."""
    return {
        "Keyword only": keyword_is_survey(title),
        "Title phrases": rules.title_phrase_tool(title),
        "Indexer type": rules.indexer_is_review(kind),
        "Strict phrases": rules.strict_phrase_rule(title, abstract, venue, kind),
    }


def evaluate_methods(df: DataFrame, model: hybrid.Hybrid | None = None, svm: bool = False, scorer: TextModel | None = None) -> DataFrame:
    """Metrics of all methods on labelled papers (Label 0 is a survey, 1 research): the rules, the cues, the text model and the
    hybrid where one is given, and the linear SVM, trained on the rows whose Split is train, where asked for."""
    frame = profiles.normalize(df, keep=tuple(c for c in ("id", "Label", "Split") if c in df.columns)).filter("Label in ('0', '1')")
    frame = scoring.with_proba(frame, scorer, VECTOR if scorer is not None else None)
    cues = F.col("proba") if scorer is None else scoring.cue_score(F.col("Title"), F.col("Abstract"))
    flags = method_flags(*(F.col(c) for c in ("Title", "Abstract", "Venue", "Type"))) | {"Scorer": cues >= 0.5}
    if scorer is not None:
        flags["Text model"] = F.col("proba") >= scorer.threshold
    y = (F.col("Label") == "0").cast("int").alias("y")
    rows = frame.select(y, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), c.cast("int").alias("p")) for m, c in flags.items()])).alias("f")).select("y", "f.*")
    if model is not None:
        found = model.predict(features.hybrid_features(frame, "proba", VECTOR if scorer is not None else None, keep=("Label",)))
        rows = rows.unionByName(found.select(y, F.lit("Learned hybrid").alias("method"), F.col("is_survey").alias("p")))
    if svm:
        profiles.require_columns(df, "id", "Split")
        texts = frame.select("id", "Split", paper_text(F.col("Title"), F.col("Abstract")).alias("text"), y)
        test = texts.filter("Split <> 'train'")
        found = baselines.tfidf_svm(texts.filter("Split = 'train'"), test, "id", F.col("text"), "y")
        rows = rows.unionByName(test.select("id", "y").join(found.select("id", "p"), "id").select("y", F.lit("TF-IDF + SVM").alias("method"), F.col("p").cast("int").alias("p")))
    return metrics.confusion(rows, ["method"], F.col("y"), F.col("p")).orderBy("method")


def evaluate_rules(df: DataFrame) -> DataFrame:
    """evaluate_methods with the rules alone."""
    names = list(method_flags(*(F.lit("") for _ in range(4))))
    return evaluate_methods(df).filter(F.col("method").isin(names))


def _intervals(labelled: DataFrame, model: hybrid.Hybrid | None, scorer: TextModel | None) -> DataFrame:
    """Weighted F1 of all methods with intervals, against the hybrid where there is one; papers are resampled within `Stratum`
    and weigh `StratumWeight` where they have one."""
    extra = [c for c in ("Stratum", "StratumWeight") if c in labelled.columns]
    rows = labelled if "id" in labelled.columns else sampling.numbered(labelled, "id")
    frame = scoring.with_proba(profiles.normalize(rows, keep=("id", "Label", *extra)).filter("Label in ('0', '1')"), scorer, VECTOR if scorer is not None else None)
    flags = method_flags(*(F.col(c) for c in ("Title", "Abstract", "Venue", "Type"))) | {"Scorer": F.col("proba") >= (0.5 if scorer is None else scorer.threshold)}
    reference = "Scorer"
    if model is not None:
        found = model.predict(features.hybrid_features(frame, "proba", VECTOR if scorer is not None else None, keep=("id",)))
        frame = frame.join(found.select("id", "is_survey"), "id")
        flags, reference = flags | {"Learned hybrid": F.col("is_survey")}, "Learned hybrid"
    w = F.coalesce(F.col("StratumWeight").cast("string").try_cast("double"), F.lit(1.0)) if "StratumWeight" in extra else None
    out = evaluation.method_intervals(frame, flags, (F.col("Label") == "0").cast("int"), "id", tuple(c for c in extra if c == "Stratum"), w, reference)
    return out.orderBy("method")


def evaluation_report(labelled: DataFrame, authors: DataFrame | None = None, comparison: DataFrame | None = None, model: hybrid.Hybrid | None = None, trained: DataFrame | None = None, by: str = "SourceFile", scorer: TextModel | None = None) -> dict[str, DataFrame]:
    """The tables of the report: methods on labelled papers; for profiles (column `by` names the author's file) the impact of
    leaving out surveys and the methods by author; with a second cohort the comparison of both."""
    tables = {"Methods": evaluate_methods(labelled, model, scorer=scorer), "Intervals": _intervals(labelled, model, scorer)}
    if authors is None:
        return tables

    def prepared(df: DataFrame) -> DataFrame:
        typed = df.withColumn("citationCount", F.coalesce(F.col("citationCount").cast("string").try_cast("double"), F.lit(0.0)))
        return classify(typed.withColumn("authors", profiles.pick(df, "authors")), model=model, scorer=scorer)

    def compared(df: DataFrame) -> DataFrame:
        flags = method_flags(*(F.coalesce(F.col(c), F.lit("")) for c in ("title", "abstract", "venue", "type")))
        return indices.by_method(df, by, {"Main": F.col("Category") == "survey"} | flags)

    own = prepared(authors)
    titles = labelled.select(profiles.pick(labelled, "Title", "title").alias("t")) if trained is None else trained
    impact = evaluation.author_report(own, by, F.col("Category"), titles)
    tables["Authors"] = indices.with_average(impact.drop("name"), by)
    tables["Methods by author"] = compared(own)
    if comparison is not None:
        tables["Cohorts"] = evaluation.cohort_comparison(tables["Methods by author"], compared(prepared(comparison)))
    return tables


def train_text_model(labelled: DataFrame, seed: int = 42, share: float = 0.25, **options) -> tuple[TextModel, DataFrame]:
    """The text model of papers in normal form with id and Label, and the papers with `Split`: a fifth is test, a tenth of
    the rest stops the training and chooses the threshold, and of what is trained on a share loses its abstracts."""
    y = (F.col("Label") == "0").cast("int")
    parts = sampling.split(labelled, "Label", "id", seed)
    train = sampling.title_only(parts.filter("Split = 'train'"), "Abstract", "id", share, seed)
    model = text_model.fit(train.unionByName(parts.filter("Split = 'val'")), "id", y, seed=seed, **options)
    model.threshold = text_model.chosen_threshold(model, parts.filter("Split = 'val'"), y)
    return model, parts


def train_hybrid(labelled: DataFrame, embedding: str | None = None):
    """labelled: normal form with id, Label and proba."""
    rows = features.hybrid_features(labelled, "proba", embedding, keep=("id", "Label"))
    rows = rows.select("id", F.lit("all").alias("stratum"), "features", (F.col("Label") == "0").cast("double").alias("y"), F.lit(1.0).alias("w"))
    return hybrid.fit_selected(rows, "id", "stratum")


def cross_validated(labelled: DataFrame, embedding: str | None = None, **options) -> DataFrame:
    """Metrics of out-of-fold predictions by nested cross-validation, averaged over its repetitions."""
    rows = features.hybrid_features(labelled, "proba", embedding, keep=("id", "Label"))
    rows = rows.select("id", F.lit("all").alias("stratum"), "features", (F.col("Label") == "0").cast("double").alias("y"), F.lit(1.0).alias("w"))
    found = hybrid.nested_cv(rows, "id", "stratum", **options).join(rows.select("id", "y"), "id")
    each = metrics.confusion(found, ["rep"], F.col("y").cast("int"), F.col("pred"))
    return each.agg(*[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
