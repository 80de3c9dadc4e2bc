"""Joins by title keys, candidate checks and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 20  # prefixes of shorter titles say nothing


def without_keys(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """df less the rows whose key occurs in any of the other tables' first columns."""
    for other in others:
        df = df.join(other.select(F.col(other.columns[0]).alias(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return df


def without_clashes(df: DataFrame, key: str, label: str) -> DataFrame:
    """df less the keys that occur with more than one label."""
    clash = df.groupBy(key).agg(F.min(label).alias("a"), F.max(label).alias("b")).filter("a <> b").select(key)
    return df.join(clash, key, "left_anti")


SALT, HOT = 32, 4096  # shares of a head that more rows have


def beginnings(rows: DataFrame, key: str, refs: DataFrame, ref_key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows, once for each beginning of their key that some reference key of PREFIX characters or more (and of the same
    `by`) may be, as `_r`.

    A head, the first PREFIX characters, has a row for each length of its references; a row of the table is cut at these,
    so it multiplies by the lengths of its head and not by the references. Lengths are rows and no sets, as an aggregate of
    sets is sorted where there are many heads. Heads of more than HOT rows are salted: one that half of the rows share is
    dealt out. The others are not multiplied, as there may be as many of them as references.
    """
    head = F.substring(key, 1, PREFIX)
    hot = rows.groupBy(*[F.col(c).alias(f"_hot_{c}") for c in by], head.alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT)
    hot = F.broadcast(hot.withColumn("_shares", F.lit(SALT)).drop("_n"))  # one row in HOT at most

    def shared(df: DataFrame, head: Column, named: str) -> DataFrame:
        same = head == F.col("_hot")
        for c in by:
            same &= F.col(f"{named}{c}") == F.col(f"_hot_{c}")
        return df.join(hot, same, "left").withColumn("_shares", F.coalesce("_shares", F.lit(1)))

    long = refs.filter(F.length(ref_key) >= PREFIX)
    lengths = long.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.substring(ref_key, 1, PREFIX).alias("_head"), F.length(ref_key).alias("_length")).distinct()
    heads = shared(lengths, F.col("_head"), "_by_").select(*lengths.columns, F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_salt"))
    salted = shared(rows, head, "").select(*rows.columns, F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.col("_shares")).cast("int").alias("_share"))
    meet = (head == F.col("_head")) & (F.col("_share") == F.col("_salt"))
    for c in by:
        meet &= F.col(c) == F.col(f"_by_{c}")
    meet &= F.length(key) >= F.col("_length")
    return salted.join(heads, meet).select(*rows.columns, F.substr(F.col(key), F.lit(1), F.col("_length")).alias("_r"))


def prefix_match(refs: DataFrame, profile: DataFrame, ref_id: str, ref_key: str, key: str, cites: str, row_id: str) -> DataFrame:
    """(ref_id, row_id, exact): the profile row for each reference title. An exact key wins; else, for keys of at least
    20 characters, profile keys that begin with it; most cited first, ties to the smaller id.

    The best row of every key and of every beginning is found before references come in, so they meet one row each.
    """
    r = refs.select(F.col(ref_id), F.col(ref_key).alias("_r"))
    p = profile.select(F.col(row_id), F.col(key).alias("_p"), F.col(cites).alias("_c"))
    best = F.max_by(F.struct(row_id, F.coalesce("_c", F.lit(0)).alias("_c")), F.struct(F.coalesce("_c", F.lit(0)), -F.col(row_id))).alias("x")
    exact = p.filter("_p <> ''").groupBy(F.col("_p").alias("_r")).agg(best).withColumn("exact", F.lit(1))
    begun = beginnings(p, "_p", r, "_r").filter("_p <> _r").groupBy("_r").agg(best).withColumn("exact", F.lit(0))
    found = exact.unionByName(begun).groupBy("_r").agg(F.max_by(F.struct(F.col(f"x.{row_id}"), "exact"), F.struct(F.col("exact"), F.col("x._c"), -F.col(f"x.{row_id}"))).alias("y"))
    return r.join(found, "_r").groupBy(ref_id).agg(F.max_by("y", F.struct(F.col("y.exact"), -F.col(f"y.{row_id}"))).alias("y")).select(ref_id, f"y.{row_id}", "y.exact")


def candidate_overlap(titles: DataFrame, candidate: str, key: str, known: DataFrame, min_common: int = 2, min_share: float = 0.5) -> DataFrame:
    """(candidate, papers, common, share, accepted): how many of a candidate's titles are among the known keys."""
    marks = known.select(F.col(known.columns[0]).alias(key)).filter(F.col(key) != "").distinct().withColumn("_in", F.lit(1))
    counted = titles.join(marks, key, "left").groupBy(candidate).agg(F.count(F.lit(1)).alias("papers"), F.count("_in").alias("common"))
    share = F.bround(F.col("common") / F.greatest(F.lit(1), F.col("papers")), 3)
    return counted.select(candidate, "papers", "common", share.alias("share"), ((F.col("common") >= min_common) & (F.col("common") / F.greatest(F.lit(1), F.col("papers")) >= min_share)).alias("accepted"))


def first_eligible(candidates: DataFrame, order: list[Column], excluded: DataFrame, key: str, eligible: Column, slice_to: int = 60, take: int = 5) -> DataFrame:
    """The first `take` eligible of the first `slice_to` candidates; exclusion comes after the slice."""
    top = candidates.orderBy(*order).limit(slice_to)
    return top.join(excluded, key, "left_anti").filter(eligible).orderBy(*order).limit(take)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", nth).filter(F.col("rank") <= k)


def first_reason(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """df with `reason`: the first that applies, else kept."""
    c = None
    for name, test in reasons.items():
        c = F.when(test, name) if c is None else c.when(test, name)
    return df.withColumn("reason", F.lit("kept") if c is None else c.otherwise("kept"))


def affiliations(works: DataFrame, author: Column, authorships: str = "authorships", k: int = 3) -> DataFrame:
    """Per author: the k institutions with the largest share of works, each counted once a work, and the share without."""
    mine = F.flatten(F.transform(F.filter(authorships, lambda a: a["author"]["id"] == author), lambda a: F.transform(a["institutions"], lambda i: i["display_name"])))
    rows = works.select(author.alias("author"), F.explode_outer(F.array_distinct(mine)).alias("institution"))
    totals = works.groupBy(author.alias("author")).agg(F.count(F.lit(1)).alias("works"))
    shares = rows.groupBy("author", "institution").agg(F.count(F.lit(1)).alias("n")).join(totals, "author").withColumn("share", F.col("n") / F.col("works"))
    return top_k(shares, ["author"], [F.desc("n"), F.col("institution").asc_nulls_last()], k)
