"""Publication lists: typed normal form, versions, and the merge of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import item_count, norm_title, rebuild_abstract, text_of, unicode_title


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def pick(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """The first of the names that df has, by presence and not by value."""
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    return F.lit(None).cast("string") if default is None else default


def reference_count(df: DataFrame) -> Column:
    if "ReferenceCount" in df.columns:
        return F.coalesce(F.col("ReferenceCount").cast("string").try_cast("double"), F.lit(0.0)).cast("long")
    if "references" in df.columns:
        return item_count(F.col("references"))
    return F.lit(0).cast("long")


def normalize(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Title, Abstract, ReferenceCount, Venue and Type from their aliases, after the columns to keep."""
    return df.select(*keep, *[text_of(pick(df, n, n.lower())).alias(n) for n in ("Title", "Abstract")], reference_count(df).alias("ReferenceCount"), *[text_of(pick(df, n, n.lower())).alias(n) for n in ("Venue", "Type")])


def first_per(df: DataFrame, keys: list[str | Column], *order: Column) -> DataFrame:
    """The first row of each key under a total order; a rank limit that Spark applies before the shuffle as well."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def most_cited(df: DataFrame, title: str = "title", cites: str = "citationCount", id_col: str = "id") -> DataFrame:
    """One row per title, by letters and digits of every script: the most cited, then the smallest id; rows without either go."""
    keyed = df.withColumn("_key", unicode_title(F.col(title))).filter("_key <> ''")
    return first_per(keyed, ["_key"], F.coalesce(F.col(cites), F.lit(0)).desc(), F.col(id_col)).drop("_key")


def merge_versions(df: DataFrame, id_col: str = "id", strict: bool = False) -> DataFrame:
    """One row per normalized title: no preprint before a preprint, then the most cited, then the smallest id.

    Blank titles go; titles without ASCII letters or digits share the empty key (strict: each stays by itself).
    """
    named = df.filter(F.trim(text_of(F.col("title"))) != "")
    key = norm_title(F.col("title"))
    key = F.when(key == "", F.concat(F.lit("#"), F.col(id_col).cast("string"))).otherwise(key) if strict else key
    preprint = (F.lower(text_of(F.col("type"))) == "preprint").cast("int")
    return first_per(named.withColumn("_key", key), ["_key"], preprint, F.coalesce(F.col("citationCount"), F.lit(0)).desc(), F.col(id_col)).drop("_key")


def load_source(df: DataFrame, source: str) -> DataFrame:
    """Typed columns of one source with its name and the join key; rows without a key go."""
    texts = ["title", "abstract", "authors", "venue", "type"]
    out = df.select(
        *[text_of(pick(df, n)).alias(n) for n in texts],
        F.coalesce(pick(df, "citationCount").cast("string").try_cast("double"), F.lit(0.0)).cast("long").alias("citationCount"),
        pick(df, "year").cast("string").try_cast("double").cast("int").alias("year"),
        reference_count(df).alias("ReferenceCount"),
        F.lit(source).alias("Sources"),
    )
    return out.withColumn("_key", norm_title(F.col("title"))).filter("_key <> ''")


def combine(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per key over all sources: the most cited version names the paper, other fields take what is best known.

    Order among versions: citations descending, source, title, abstract. Partial aggregation keeps the shuffle narrow.
    """
    both = None
    for source, df in frames.items():
        rows = load_source(df, source)
        both = rows if both is None else both.unionByName(rows)
    if both is None:
        raise ValueError("no source")
    order = F.struct(-F.col("citationCount"), "Sources", "title", "abstract")
    best = lambda c: F.min_by(c, order)
    known = lambda c: F.coalesce(F.min_by(F.col(c), F.when(F.trim(F.col(c)) != "", order)), F.lit(""))
    longest = F.min_by("abstract", F.struct(-F.length("abstract"), F.col("abstract")))
    parts = F.filter(F.transform(F.split(F.array_join(F.collect_set("type"), ";"), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return both.groupBy("_key").agg(
        best("title").alias("title"), longest.alias("abstract"), known("authors").alias("authors"),
        F.max("citationCount").alias("citationCount"), F.max("ReferenceCount").alias("ReferenceCount"), known("venue").alias("venue"),
        F.min_by("year", F.when(F.col("year").isNotNull(), order)).alias("year"),
        F.array_join(F.array_sort(F.array_distinct(parts)), "; ").alias("type"),
        F.array_join(F.array_sort(F.collect_set("Sources")), ", ").alias("Sources"),
    )


def work_to_row(works: DataFrame, **more: Column) -> DataFrame:
    """Flat row of a nested index record; what is missing in it is blank or 0, a missing year null. more: further columns."""
    has = {f.name for f in works.schema.fields}
    part = lambda name, c: c if name in has else F.lit("")
    return works.select(
        F.regexp_replace("id", "^https?://[^/]*/", "").alias("id"), F.coalesce("title", F.lit("")).alias("title"),
        part("abstract_inverted_index", F.coalesce(rebuild_abstract(F.col("abstract_inverted_index")), F.lit("")) if "abstract_inverted_index" in has else None).alias("abstract"),
        F.coalesce(F.array_join(F.transform("authorships", lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), "; "), F.lit("")).alias("authors"),
        F.coalesce("cited_by_count", F.lit(0)).cast("long").alias("citationCount"),
        F.coalesce("referenced_works_count", F.lit(0)).cast("long").alias("ReferenceCount"),
        part("primary_location", F.coalesce(F.col("primary_location.source.display_name"), F.lit("")) if "primary_location" in has else None).alias("venue"),
        F.col("publication_year").cast("int").alias("year"), F.coalesce("type", F.lit("")).alias("type"),
        part("doi", F.coalesce("doi", F.lit("")) if "doi" in has else None).alias("doi"), *[c.alias(n) for n, c in more.items()],
    )


def record_to_row(papers: DataFrame) -> DataFrame:
    """Flat row of a paper record whose references and authors are arrays of structs; references without an id go."""
    ids = F.filter(F.transform("references", lambda r: r["paperId"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return papers.select(
        F.col("paperId").alias("id"), "title", "abstract",
        F.coalesce(F.array_join(F.transform("authors", lambda a: a["name"]), "; "), F.lit("")).alias("authors"), "citationCount",
        F.coalesce(F.array_join(ids, "; "), F.lit("")).alias("references"), "venue", "year",
        F.coalesce(F.array_join("publicationTypes", "; "), F.lit("")).alias("type"),
    )
