"""Command line: classify, combine, evaluate, make-eval-set, build-dataset, extract, train."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import norm_title, word_count
from .operators import hybrid, indices, profiles, rules, sampling, scoring, text_model
from .plans import dataset, evaluation, pipelines
from .report import markdown, to_json
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="litmetrics")
    sub = p.add_subparsers(dest="command")
    c = sub.add_parser("classify", help="split a profile into research and the rest, with indices before and after")
    c.add_argument("--input", required=True)
    c.add_argument("--output", default="research_only")
    c.add_argument("--surveys", default="surveys")
    c.add_argument("--threshold", type=float, default=0.5)
    c.add_argument("--model", help="folder of a fitted hybrid; it decides in place of the cues")
    c = sub.add_parser("combine", help="merge profiles of several sources")
    c.add_argument("--source", action="append", required=True, metavar="NAME=PATH")
    c.add_argument("--output", required=True)
    c = sub.add_parser("extract", help="flatten works fetched from a paged service")
    c.add_argument("--source", choices=("index", "scholar"), default="index", help="kind of records")
    c.add_argument("--url", help="address of the service, or else --fixtures")
    c.add_argument("--fixtures")
    c.add_argument("--author", required=True, help="ids, separated by commas")
    c.add_argument("--cache", help="folder of kept pages: a run that failed goes on where it stopped, a second one asks for nothing")
    c.add_argument("--types", help="CSV with id and type to add")
    c.add_argument("--output", required=True)
    c = sub.add_parser("make-eval-set", help="stratified sample for labelling")
    c.add_argument("--input", required=True)
    c.add_argument("--training")
    c.add_argument("--output", required=True)
    c.add_argument("--per-stratum", type=int, default=120)
    c.add_argument("--seed", type=int, default=42)
    c = sub.add_parser("evaluate", help="methods on labelled papers, and the impact on authors' profiles")
    c.add_argument("--eval-set", required=True)
    c.add_argument("--model")
    c.add_argument("--authors", help="glob of profiles")
    c.add_argument("--comparison", help="glob of a second cohort's profiles")
    c.add_argument("--report", help="folder for report.md and tables.json; without it the report is printed")
    c = sub.add_parser("build-dataset", help="surveys and year-matched research papers from fetched works")
    c.add_argument("--works", required=True, help="JSON lines of works")
    c.add_argument("--venues", required=True, help="CSV: source, Venue, Group, Label (0 survey, 1 research)")
    c.add_argument("--exclude", action="append", default=[], help="CSV with a title column; its papers stay out")
    c.add_argument("--output", required=True)
    c.add_argument("--hard-cases", required=True)
    c.add_argument("--seed", type=int, default=42)
    c = sub.add_parser("train", help="train the text model on labelled papers, and fit the hybrid on others with its scores")
    c.add_argument("--dataset", required=True)
    c.add_argument("--labelled", help="CSV of papers to fit the hybrid on; without it the dataset's test part")
    c.add_argument("--hybrid-only", action="store_true", help="keep the text model that is in the folder")
    c.add_argument("--output-dir", required=True)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--cv", action="store_true", help="also report out-of-fold metrics by nested cross-validation")
    return p


def load_models(spark: SparkSession, path: str | None) -> tuple[hybrid.Hybrid | None, text_model.TextModel | None]:
    """The hybrid of a folder, and the text model beside it if there is one."""
    if not path:
        return None, None
    return hybrid.Hybrid.load(path), text_model.TextModel.load(f"{path}/text") if files.exists(spark, f"{path}/text/config") else None


def normal_form(raw: DataFrame) -> DataFrame:
    """Labelled papers with an id of their own."""
    raw = raw if "id" in raw.columns else sampling.numbered(raw, "id")
    return profiles.normalize(raw, keep=("id", "Label")).filter("Label in ('0', '1')")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 1
    spark = SparkSession.builder.appName("litmetrics").getOrCreate()
    if args.command == "classify":
        model, scorer = load_models(spark, args.model)
        df = pipelines.classify(files.read_csv(spark, args.input), args.threshold, model, scorer=scorer)
        files.write_routed(df, {args.output: F.col("Category") == "research", args.surveys: F.col("Category") != "research"})
        print(markdown(indices.impact(df.withColumn("all", F.lit("all")).withColumn("citationCount", F.col("citationCount").try_cast("double")), "all", F.col("Category") == "survey")))
    elif args.command == "combine":
        frames = {name: files.read_csv(spark, path) for name, _, path in (s.partition("=") for s in args.source)}
        files.write_csv(profiles.combine(frames).drop("_key"), args.output)
    elif args.command == "extract":
        from .sources import rest

        paging = "offset" if args.source == "scholar" else "cursor"
        if args.cache:
            names = spark.createDataFrame([(a,) for a in args.author.split(",") if a], "entity string")
            send = (lambda: rest.folder_transport(args.fixtures)) if args.fixtures else (lambda: rest.http)
            raw = rest.resumed(names, args.cache, args.url or "file://fixtures", {}, paging, send)
        else:
            spark.dataSource.register(rest.PagedSource)
            options = {"entities": args.author, "paging": paging} | {k: v for k, v in (("url", args.url), ("fixtures", args.fixtures)) if v}
            raw = spark.read.format("paged_rest").options(**options).load()
        rows = profiles.merge_versions(pipelines.works_from_json(raw)) if args.source == "index" else profiles.most_cited(profiles.first_per(pipelines.records_from_json(raw), ["id"], F.col("citationCount").desc_nulls_last(), F.col("title")))
        if args.types:
            extra = profiles.first_per(files.read_csv(spark, args.types).select("id", F.col("type").alias("_type")), ["id"], F.col("_type").asc_nulls_last())
            rows = rows.join(extra, "id", "left").withColumn("type", F.coalesce("_type", "type")).drop("_type")
        files.write_csv(rows, args.output)
    elif args.command == "make-eval-set":
        papers = files.read_csv(spark, args.input, provenance=True)
        papers = profiles.first_per(papers.withColumn("_key", norm_title(F.col("title"))).filter(word_count(F.col("abstract")) >= 30).filter("_key <> ''"), ["_key"], F.col("id"))
        if args.training:
            from .operators.matching import without_keys

            papers = without_keys(papers, "_key", files.read_csv(spark, args.training).select(norm_title(F.col("Title")).alias("_key")))
        papers = papers.withColumn("Stratum", rules.stratum(F.col("title"), F.col("abstract")))
        files.write_csv(sampling.per_stratum(papers, "Stratum", args.per_stratum, "id", args.seed).drop("_key").withColumn("Label", F.lit("")).withColumn("Notes", F.lit("")), args.output)
    elif args.command == "evaluate":
        model, scorer = load_models(spark, args.model)
        profiles_of = lambda glob: files.read_csv(spark, glob, provenance=True) if glob else None
        tables = pipelines.evaluation_report(files.read_csv(spark, args.eval_set), profiles_of(args.authors), profiles_of(args.comparison), model, scorer=scorer)
        text = evaluation.report(tables, digits=3)
        if args.report:
            files.write_text(spark, text, f"{args.report}/report.md")
            files.write_text(spark, to_json(tables), f"{args.report}/tables.json")
        else:
            print(text)
    elif args.command == "build-dataset":
        venues = files.read_csv(spark, args.venues).withColumn("Label", F.col("Label").cast("int"))
        works = pipelines.works_from_json(spark.read.text(args.works).select(F.col("value").alias("record")), keep_source=True)
        excluded = [t.select(norm_title(profiles.pick(t, "Title", "title")).alias("_key")) for t in (files.read_csv(spark, x) for x in args.exclude)]
        groups = sorted(r.Group for r in venues.select("Group").distinct().collect())  # a configuration, one row a group
        built, hard = dataset.build(works, venues, excluded, groups, args.seed)
        files.write_csv(built.orderBy("Place").drop("Place"), args.output)
        files.write_csv(hard, args.hard_cases)
    elif args.command == "train":
        papers = normal_form(files.read_csv(spark, args.dataset))
        if args.hybrid_only:
            scorer, parts = text_model.TextModel.load(f"{args.output_dir}/text"), sampling.split(papers, "Label", "id", args.seed)
        else:
            scorer, parts = pipelines.train_text_model(papers, args.seed)
            scorer.save(f"{args.output_dir}/text")
            print(f"text model: {len(scorer.losses)} passes tested, threshold {scorer.threshold:.2f}")
        rows = normal_form(files.read_csv(spark, args.labelled)) if args.labelled else parts.filter("Split = 'test'").drop("Split")
        labelled = scoring.with_proba(rows, scorer, pipelines.VECTOR)
        model = pipelines.train_hybrid(labelled, pipelines.VECTOR)
        model.save(args.output_dir)
        print(f"C {model.c:g}, threshold {model.threshold:.2f}")
        if args.cv:
            print(markdown(pipelines.cross_validated(labelled, pipelines.VECTOR), 3))
    return 0


if __name__ == "__main__":
    sys.exit(main())
