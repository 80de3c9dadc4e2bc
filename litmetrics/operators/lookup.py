"""What a paged index answers on its server, over a table: samples, counts, lookups and name searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seeded


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows at random; every partition keeps its n smallest hashes before they meet."""
    return df.orderBy(seeded(F.col(key), F.lit(seed)), key).limit(n)


def group_count(df: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """(by, count), the largest groups first, ties by name."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.col(by).asc_nulls_last())
    return out if most is None else out.limit(most)


def filtered_count(df: DataFrame, test: Column) -> DataFrame:
    """(count): how many rows pass; one row, also for an empty table."""
    return df.agg(F.count_if(test).alias("count"))


def by_ids(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted ids (first column) in any number with what df knows of them; unknown ids stay, with nulls."""
    return wanted.select(F.col(wanted.columns[0]).alias(key)).distinct().join(df, key, "left")


def find_author(authors: DataFrame, search: str, name: str = "name", works: str = "works", key: str = "id", candidates: int = 5) -> DataFrame:
    """The `candidates` authors with most works whose name contains all words searched, and `chosen`: the one with most; ties to the smaller key."""
    test = F.lit(True)
    for word in search.lower().split():
        test &= F.lower(F.col(name)).contains(word)
    top = authors.filter(test).orderBy(F.desc(works), key).limit(candidates)
    best = top.orderBy(F.desc(works), key).limit(1).select(F.col(key).alias("_best"))
    return top.join(F.broadcast(best), F.col(key) == F.col("_best"), "left").withColumn("chosen", F.col("_best").isNotNull()).drop("_best")  # one row


def value_range(df: DataFrame, value: str) -> DataFrame:
    """(low, high) of a column."""
    return df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
