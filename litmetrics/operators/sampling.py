"""Samples, splits, folds and resampling, all by seeded hashes so that reruns and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded


def per_stratum(df: DataFrame, stratum: str, n: int, key: str, seed: int) -> DataFrame:
    """At most n rows of each stratum, with StratumWeight = rows / sampled, three decimals, half to even."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_pool"))
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(seeded(F.col(key), F.lit(seed)), key))
    few = df.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")
    weighted = few.join(sizes, stratum)
    return weighted.withColumn("StratumWeight", F.bround(F.col("_pool") / F.least(F.col("_pool"), F.lit(n)), 3)).drop("_pool")


PREFIX = 3  # hexadecimal digits: up to 4096 ranges of a stratum


def _rank(df: DataFrame, by: list[str], key: str, seed: int, name: str, base: DataFrame | None = None) -> DataFrame:
    """df with its rows' places (from 1) within `by`, in the order of their seeded hashes.

    No task sees a whole stratum: rows are counted by the first digits of the hash, the counts before give each range
    its first place, and only the rows of a range are ranked together. base: a table of the same rows to count in, for a df
    that has been ranked before, which would be ranked twice.
    """
    ranged = lambda x: x.withColumn("_u", seeded(F.col(key), F.lit(seed))).withColumn("_range", F.substring("_u", 1, PREFIX))
    hashed = ranged(df)
    counts = ranged(df if base is None else base).groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))  # at most 16 ** PREFIX rows a stratum
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")
    starts = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), before.alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    nth = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_u", key))
    placed = hashed.withColumn("_nth", nth).join(starts, same)
    return placed.select(*df.columns, (F.col("_before") + F.col("_nth")).cast("int").alias(name))


def shuffled(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """df with each row's place in a global random order."""
    return _rank(df.withColumn("_all", F.lit(0)), ["_all"], key, seed, name).drop("_all")


def split(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Split = test (20 % of each label), val (10 % of the rest) or train; exact counts by label."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = _rank(df, [label], key, seed, "_r").join(sizes, label)
    test = F.floor(F.col("_n") * 0.2 + 0.5)
    val = F.floor((F.col("_n") - test) * 0.1 + 0.5)
    return ranked.withColumn("Split", F.when(F.col("_r") <= test, "test").when(F.col("_r") <= test + val, "val").otherwise("train")).drop("_r", "_n")


def folds(df: DataFrame, by: list[str], key: str, k: int, seed: int, base: DataFrame | None = None) -> DataFrame:
    return _rank(df, by, key, seed, "_r", base).withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def year_matched(pool: DataFrame, targets: DataFrame, key: str, year: str, seed: int) -> DataFrame:
    """Rows of pool by the year counts of targets (year, need); what years lack is filled with the nearest years' rest."""
    need = targets.select(F.col(year), F.col("need").cast("long").alias("need"))
    ranked = _rank(pool, [year], key, seed, "_r").join(need, year, "left").withColumn("_first", F.col("_r") <= F.coalesce("need", F.lit(0)))
    have = pool.groupBy(year).agg(F.count(F.lit(1)).alias("_have"))
    facts = need.join(have, year, "left").agg(F.sum(F.greatest(F.lit(0), F.col("need") - F.coalesce("_have", F.lit(0)))).alias("_short"), (F.sum(F.col(year) * F.col("need")) / F.greatest(F.lit(1), F.sum("need"))).alias("_mean"))
    rest = ranked.filter("not _first").crossJoin(F.broadcast(facts))  # one row of facts
    away = F.abs(F.col(year) - F.col("_mean"))
    # counting rows by distance first tells which distances are taken whole; only the last one is ranked
    steps = rest.groupBy(away.alias("_away"), "_short").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_away").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.select(F.col("_away").alias("_d"), before.alias("_before"))  # one row per year
    filled = rest.withColumn("_away", away).join(steps, F.col("_away") == F.col("_d")).filter(F.col("_before") < F.col("_short"))
    nth = F.row_number().over(Window.partitionBy("_away").orderBy(seeded(F.col(key), F.lit(seed)), key))
    filled = filled.withColumn("_k", nth).filter(F.col("_k") <= F.col("_short") - F.col("_before"))
    return ranked.filter("_first").select(*pool.columns).unionByName(filled.select(*pool.columns))


FEW, BLOCK = 1 << 15, 50  # rows that every task may hold; replicates drawn from one row of the dealt-out table


def bootstrap_draws(df: DataFrame, strata: list[str], key: str, replicates: int, seed: int) -> DataFrame:
    """(rep, row columns): as many draws with replacement in every stratum and replicate as it has rows.

    Draws are hashes of replicate, stratum and place, joined to rows by their place: an equi-join, no cross product. Places
    are dealt out with blocks of replicates before they multiply. Up to FEW rows go to the draws, counted before; beyond,
    both sides are shuffled.
    """
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    placed = _rank(df, strata, key, seed, "_place").join(sizes, strata)
    first = F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(BLOCK))).alias("_first")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as few bytes become many draws
    dealt = placed.select(*strata, "_n", "_place", first).repartition(tasks, "_place", "_first")
    draws = dealt.withColumn("rep", F.explode(F.sequence("_first", F.least(F.col("_first") + (BLOCK - 1), F.lit(replicates)))))
    hashed = F.conv(F.substring(seeded(F.lit(seed), F.col("rep"), F.col("_place"), *[F.col(s) for s in strata]), 1, 8), 16, 10).cast("long")
    draws = draws.select(*strata, "rep", (F.lit(1) + hashed % F.col("_n")).cast("int").alias("_place"))
    rows = placed.drop("_n")
    return draws.join(F.broadcast(rows) if df.count() <= FEW else rows, [*strata, "_place"]).drop("_place")


def interval(df: DataFrame, by: list[str], value: Column, level: float = 0.95) -> DataFrame:
    """(by, low, high): percentile interval of a value over replicates."""
    edge = (1 - level) / 2
    p = F.percentile(value, F.array(F.lit(edge), F.lit(1 - edge)))
    return df.groupBy(*by).agg(p.alias("_p")).select(*by, F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def title_only(df: DataFrame, abstract: str, key: str, rate: float, seed: int) -> DataFrame:
    """Blanks the abstract of a share of the rows."""
    u = F.conv(F.substring(seeded(F.col(key), F.lit(seed)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return df.withColumn(abstract, F.when(u < rate, F.lit("")).otherwise(F.col(abstract)))


def with_title_only_copies(df: DataFrame, abstract: str) -> DataFrame:
    return df.unionByName(df.withColumn(abstract, F.lit("")))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, from 1 on, by the hash of its columns; equal rows get numbers of their own."""
    marked = df.withColumn("_c", F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    single = marked.groupBy("_c").agg(F.count(F.lit(1)).alias("_copies"))
    rows = single.select(F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"), "_c").withColumn("_key", F.concat_ws("-", "_copy", "_c"))
    placed = shuffled(rows, "_key", 0, name)
    one = df.schema
    return placed.select(name, F.from_json("_c", one).alias("_r")).select(name, *[F.col(f"_r.`{c}`").alias(c) for c in df.columns])
