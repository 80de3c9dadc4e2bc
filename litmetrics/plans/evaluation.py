"""Evaluation tables: methods on labelled papers, author impact, methods by author, cohorts, and the report of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_title, spaced_title
from ..operators import indices, matching, metrics, resampling, rules, verification
from ..report import markdown


def method_rows(df: DataFrame, methods: dict[str, Column], keep: tuple[str, ...]) -> DataFrame:
    """(keep, method, p): one row for each method, 1 where it says survey."""
    flags = F.array(*[F.struct(F.lit(m).alias("method"), F.coalesce(c.cast("int"), F.lit(0)).alias("p")) for m, c in methods.items()])
    return df.select(*keep, F.explode(flags).alias("_f")).select(*keep, "_f.*")


def survey_rates(rows: DataFrame, by: list[str], y: Column, p: Column, w: Column) -> DataFrame:
    """(by, true_rate, predicted_rate): reweighted shares of surveys."""
    return rows.groupBy(*by).agg(F.try_divide(F.sum(y * w), F.sum(w)).alias("true_rate"), F.try_divide(F.sum(p * w), F.sum(w)).alias("predicted_rate"))


def method_intervals(df: DataFrame, methods: dict[str, Column], y: Column, key: str, strata: tuple[str, ...] = (), w: Column | None = None, reference: str | None = None, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(method, f1, f1_low, f1_high, delta, delta_low, delta_high): weighted F1 of each method with its 95 % interval over
    stratified bootstrap replicates, and how much better it is than the reference method (the first by default) in the
    same replicates."""
    names, weight = list(methods), F.lit(1.0) if w is None else w.cast("double")
    cells = {"tp": lambda p: (y == 1) & (p == 1), "fp": lambda p: (y == 0) & (p == 1), "fn": lambda p: (y == 1) & (p == 0)}
    flags = [F.coalesce(methods[m].cast("int"), F.lit(0)) for m in names]
    values = {f"{c}{i}": F.when(test(p), weight).otherwise(0.0) for i, p in enumerate(flags) for c, test in cells.items()}
    drawn = resampling.bootstrap_totals(df, list(strata), key, values, replicates, seed)
    every = drawn.unionByName(df.agg(F.lit(0).alias("rep"), *[F.coalesce(F.sum(v), F.lit(0.0)).alias(c) for c, v in values.items()]))
    f1 = [F.coalesce(F.try_divide(2 * F.col(f"tp{i}"), 2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}")), F.lit(0.0)) for i in range(len(names))]
    base = f1[names.index(reference) if reference else 0]
    rows = every.select("rep", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), x.alias("f1"), (x - base).alias("delta")) for m, x in zip(names, f1, strict=True)])).alias("x")).select("rep", "x.*")
    ends = lambda c: F.percentile(F.when(F.col("rep") > 0, F.col(c)), F.array(F.lit(0.025), F.lit(0.975)))
    per = rows.groupBy("method").agg(*[x for c in ("f1", "delta") for x in (F.max(F.when(F.col("rep") == 0, F.col(c))).alias(c), ends(c).alias(f"_{c}"))])
    return per.select("method", *[x for c in ("f1", "delta") for x in (c, F.col(f"_{c}")[0].alias(f"{c}_low"), F.col(f"_{c}")[1].alias(f"{c}_high"))])


def confident_f1(rows: DataFrame, by: list[str], y: Column, p: Column, confidence: str) -> DataFrame:
    """(by, f1, f1_confident): over all rows and over those labelled with high or medium confidence."""
    sure = F.coalesce(F.col(confidence).isin("H", "M"), F.lit(False)).cast("double")
    every = metrics.confusion(rows, by, y, p).select(*by, "f1")
    return every.join(metrics.confusion(rows, by, y, p, sure).select(*by, F.col("f1").alias("f1_confident")), by)


def author_report(papers: DataFrame, by: str, category: Column, labelled: DataFrame, authors: str = "authors", title: str = "title") -> DataFrame:
    """indices.impact with the author's most frequent name, the non-papers and the papers that a model was fitted on (labelled: one column of titles)."""
    marked = papers.withColumn("_category", category).withColumn("_key", spaced_title(F.col(title)))
    seen = labelled.select(spaced_title(F.col(labelled.columns[0])).alias("_key")).distinct().withColumn("_seen", F.lit(1))
    counts = marked.join(seen, "_key", "left").groupBy(by).agg(F.count_if(F.col("_category") == "non-paper").alias("non_papers"), F.count("_seen").alias("in_training"))
    names = indices.modal_name(papers, by, authors).select(by, "name")
    return indices.impact(marked, by, F.col("_category") == "survey").join(counts, by).join(names, by, "left")


def method_table(comparison: DataFrame, by: str, names: list[str] | None = None) -> DataFrame:
    """indices.by_method pivoted: means over authors for each method, and each author's drop of the h-index."""
    drops = comparison.groupBy("method").pivot(by, names).agg(F.first("h_drop"))
    means = comparison.groupBy("method").agg(F.avg("excluded").alias("excluded"), F.avg("citations").alias("citations"), F.avg("h_drop").alias("h_drop"))
    return means.join(drops, "method")


def cohort_comparison(first: DataFrame, second: DataFrame) -> DataFrame:
    """Means over authors of two cohorts (indices.by_method each) for the methods that both have."""
    mean = lambda df, tag: df.groupBy("method").agg(*[F.avg(c).alias(f"{c}_{tag}") for c in ("excluded", "citations", "h_drop")])
    return mean(first, "a").join(mean(second, "b"), "method")


def select_cohort(candidates: DataFrame, cohort: DataFrame, key: str, value: str, rank: str, few: str, most_few: int, slice_to: int = 60, take: int = 5) -> DataFrame:
    """The first `take` of the `slice_to` candidates with the largest rank column that are not of the cohort (key, value), whose
    value lies in the cohort's range and whose `few` is at most most_few."""
    span = cohort.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))  # one row
    ranged = candidates.crossJoin(F.broadcast(span))
    fine = F.col(value).between(F.col("_low"), F.col("_high")) & (F.col(few) <= most_few)
    return matching.first_eligible(ranged, [F.desc(rank), F.col(key)], cohort.select(key), key, fine, slice_to, take).drop("_low", "_high")


def ids_by_doi(works: DataFrame, records: DataFrame, person: str, name: str, most: int = 300) -> DataFrame:
    """(person, author_id, author_name): the ids of authors who bear the person's name on the records of the person's most
    cited works with a DOI. works (person, name, doi, citationCount), records (doi, authors: array of id and name)."""
    dois = works.filter(F.col("doi").isNotNull())
    top = matching.top_k(dois, [person], [F.coalesce("citationCount", F.lit(0)).desc(), F.col("doi")], most).select(person, name, "doi")
    found = top.join(records, "doi").select(person, name, F.explode("authors").alias("a"))
    mine = found.filter(F.col("a.id").isNotNull() & rules.same_person(F.col(name), F.col("a.name")))
    return mine.groupBy(person, F.col("a.id").alias("author_id")).agg(F.min("a.name").alias("author_name"))


def record_check(affiliations: DataFrame, fields: DataFrame, by: str, inside: tuple[str, ...]) -> DataFrame:
    """(by, institution, share, outside): the leading affiliation of an author's works and the share of works outside the fields."""
    top = affiliations.filter("rank = 1").select(F.col("author").alias(by), "institution", "share")
    return top.join(verification.outside_share(fields, by, "field", "n", inside), by, "left")


def unseen(rows: DataFrame, title: str, *trained: DataFrame) -> DataFrame:
    """rows whose title key is in none of the tables of titles that a model was trained on."""
    keyed = rows.withColumn("_key", norm_title(F.col(title)))
    return matching.without_keys(keyed, "_key", *[t.select(norm_title(F.col(t.columns[0])).alias("_key")) for t in trained]).drop("_key")


def report(tables: dict[str, DataFrame], title: str = "Evaluation", digits: int = 1) -> str:
    """Markdown with a section for each table."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown(df, digits)}" for name, df in tables.items())]) + "\n"
