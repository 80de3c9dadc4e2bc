"""h-index and friends, before and after leaving out a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def h_index(df: DataFrame, by: list[str], cites: str = "citationCount") -> DataFrame:
    """(by, papers, citations, h_index, i10_index). Citations of one author are first counted by value, so the ranking
    works on distinct values and not on papers."""
    c = F.coalesce(F.col(cites), F.lit(0)).cast("long")
    values = df.select(*by, c.alias("_c")).groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n"))
    seen = F.sum("_n").over(Window.partitionBy(*by).orderBy(F.desc("_c")))
    ranked = values.withColumn("_seen", seen)
    # within a value v the ranks run from seen - n + 1 to seen; those up to v count
    part = F.greatest(F.lit(0), F.least(F.col("_seen"), F.col("_c")) - (F.col("_seen") - F.col("_n")))
    return ranked.groupBy(*by).agg(F.sum("_n").alias("papers"), F.sum(F.col("_c") * F.col("_n")).alias("citations"), F.sum(part).cast("long").alias("h_index"), F.coalesce(F.sum(F.when(F.col("_c") >= 10, F.col("_n"))), F.lit(0)).alias("i10_index"))


def impact(df: DataFrame, by: str, excluded: Column, cites: str = "citationCount") -> DataFrame:
    """Per author: papers, citations, h and i10 with and without the excluded rows, and the relative changes."""
    rows = df.select(F.col(by), F.col(cites), F.coalesce(excluded, F.lit(False)).alias("_out"))
    both = h_index(rows, [by], cites)
    kept = h_index(rows.filter("not _out"), [by], cites).select(F.col(by), *[F.col(c).alias(f"{c}_kept") for c in ("papers", "citations", "h_index", "i10_index")])
    out = both.join(kept, by, "left").na.fill(0)
    most = lambda c: F.greatest(F.lit(1), F.col(c))
    return out.select(
        by, "papers", (F.col("papers") - F.col("papers_kept")).alias("surveys"), "citations", "citations_kept",
        (100 * (F.col("papers") - F.col("papers_kept")) / most("papers")).alias("papers_excluded"),
        (100 * (F.col("citations") - F.col("citations_kept")) / most("citations")).alias("citation_reduction"),
        "h_index", "h_index_kept", (F.col("h_index") - F.col("h_index_kept")).alias("h_drop"),
        (100 * (F.col("h_index_kept") - F.col("h_index")) / most("h_index")).alias("h_change"),
        (100 * (1 - F.col("i10_index_kept") / most("i10_index"))).alias("i10_reduction"),
    )


def with_average(table: DataFrame, by: str) -> DataFrame:
    """The table and a row of unweighted means over its rows."""
    numbers = [f.name for f in table.schema.fields if f.name != by]
    typed = table.select(F.col(by).cast("string").alias(by), *[F.col(c).cast("double").alias(c) for c in numbers])
    return typed.unionByName(typed.agg(F.lit("Average").alias(by), *[F.avg(c).alias(c) for c in numbers]))


def by_method(df: DataFrame, by: str, methods: dict[str, Column], cites: str = "citationCount") -> DataFrame:
    """(method, by, excluded, citations, h_drop) for several exclusion rules over one scan."""
    flags = F.array(*[F.struct(F.lit(m).alias("method"), F.coalesce(c, F.lit(False)).alias("out")) for m, c in methods.items()])
    rows = df.select(by, cites, F.explode(flags).alias("_f")).select(by, cites, "_f.*")
    both, kept = h_index(rows, ["method", by], cites), h_index(rows.filter("not out"), ["method", by], cites)
    kept = kept.select("method", by, F.col("papers").alias("p"), F.col("citations").alias("c"), F.col("h_index").alias("h"))
    out = both.join(kept, ["method", by], "left").na.fill(0)
    return out.select("method", by, (100 * (F.col("papers") - F.col("p")) / F.col("papers")).alias("excluded"), (100 * (F.col("citations") - F.col("c")) / F.greatest(F.lit(1), F.col("citations"))).alias("citations"), (F.col("h_index") - F.col("h")).alias("h_drop"))


def modal_name(df: DataFrame, by: str, authors: str) -> DataFrame:
    """(by, name, n): the most frequent of the semicolon-separated names; ties to the alphabetically first."""
    names = df.select(by, F.explode(F.split(authors, ";")).alias("name")).select(by, F.trim("name").alias("name")).filter("name <> ''")
    return names.groupBy(by, "name").agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.min_by(F.struct("name", "n"), F.struct(-F.col("n"), F.col("name"))).alias("x")).select(by, "x.name", "x.n")
