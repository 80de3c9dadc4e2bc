"""Checks of author profiles against reference lists, and estimates with their error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indices import h_index
from .matching import PREFIX, beginnings
from .metrics import corrected_shares

#: fixed values: which categories are right for a reference label
EXPECTED = {"S": ("survey",), "M": ("survey",), "R": ("research",), "B": ("research", "non-paper")}


def coverage(refs: DataFrame, profile: DataFrame, by: str, key: str) -> DataFrame:
    """(by, found, total): reference titles that a profile covers. A long title is covered by any key that begins with
    it, a short one by an equal key. Both kinds meet by equality, the long ones with the beginnings of the keys."""
    r = refs.select(by, F.col(key).alias("_r"), F.monotonically_increasing_id().alias("_id"))
    p = profile.select(by, F.col(key).alias("_p")).distinct()
    long = F.length("_r") >= PREFIX
    short_hits = r.filter(~long).join(p, (r[by] == p[by]) & (F.col("_r") == F.col("_p")), "left_semi")
    begun = beginnings(p, "_p", r, "_r", (by,)).select(by, "_r").distinct()
    hits = short_hits.unionByName(r.filter(long).join(begun, [by, "_r"], "left_semi").select(*r.columns)).groupBy(by).agg(F.count(F.lit(1)).alias("found"))
    total = refs.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    return total.join(hits, by, "left").select(by, F.coalesce("found", F.lit(0)).alias("found"), "total")


def outside_share(counts: DataFrame, by: str, group: str, n: str, inside: tuple[str, ...]) -> DataFrame:
    """(by, outside): percentage of works outside the groups named; 0 without works."""
    out = F.sum(F.when(F.coalesce(F.col(group).isin(*inside), F.lit(False)), 0).otherwise(F.col(n)))
    return counts.groupBy(by).agg((100 * F.coalesce(out, F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum(n), F.lit(0)))).alias("outside"))


def agreement(checked: DataFrame, by: str, truth: str, category: str, seen: str) -> DataFrame:
    """(by, correct, total, unseen_correct, unseen_total) and a row Total. Titles not found (null category) do not count;
    `seen` marks those that a model was trained on. Without any title found there are no rows."""
    right = F.lit(False)
    for name, fine in EXPECTED.items():
        right = right | ((F.col(truth) == name) & F.col(category).isin(*fine))
    rows = checked.filter(F.col(category).isNotNull()).select(by, right.alias("ok"), (~F.coalesce(F.col(seen), F.lit(False))).alias("new"))
    counts = rows.rollup(by).agg(F.count_if("ok").alias("correct"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("ok") & F.col("new")).alias("unseen_correct"), F.count_if("new").alias("unseen_total"), F.grouping(by).alias("_all"))
    return counts.select(F.when(F.col("_all") == 1, "Total").otherwise(F.col(by).cast("string")).alias(by), "correct", "total", "unseen_correct", "unseen_total")


def completeness(profiles: DataFrame, hits: DataFrame, by: str, source: str, cites: str = "citationCount") -> DataFrame:
    """(by, source, papers, citations, h_index, i10_index, found): sizes of profiles by source; hits (by, source) has a row for each reference title found."""
    found = hits.groupBy(by, source).agg(F.count(F.lit(1)).alias("found"))
    return h_index(profiles, [by, source], cites).join(found, [by, source], "left").na.fill(0, ["found"])


def preferred_source(table: DataFrame, by: str, source: str, preferred: str, found: str = "found") -> DataFrame:
    """(by, source): the preferred source where there is one, else that with most titles found; ties by name."""
    order = F.struct((F.col(source) != preferred).cast("int"), -F.col(found), F.col(source))
    return table.groupBy(by).agg(F.min_by(source, order).alias(source))


def name_variants(df: DataFrame, key: str, name: str, others: str, n: int = 4) -> DataFrame:
    """(key, variant, place): the name and its other spellings (two words at least, no initials with a point), each once
    up to case and hyphens, the first n."""
    fine = F.filter(F.coalesce(F.col(others), F.array().cast("array<string>")), lambda x: ~x.contains(".") & (F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) >= 2))
    spelled = df.select(key, F.posexplode(F.concat(F.array(name), fine)).alias("_at", "variant")).filter("variant is not null")
    folded = F.translate(F.lower("variant"), "-‐", "  ")
    first = spelled.groupBy(key, folded.alias("_f")).agg(F.min(F.struct("_at", "variant")).alias("_v")).select(key, "_v.*")
    place = F.row_number().over(Window.partitionBy(key).orderBy("_at"))
    return first.select(key, "variant", place.alias("place")).filter(F.col("place") <= n)


def aligned(rows: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """rows with the columns of predictions (at least one row a key); no rows at all if any of them has no prediction."""
    marked = predictions.withColumn("_has", F.lit(True))
    lacking = rows.join(predictions, key, "left_anti").limit(1).agg(F.count(F.lit(1)).alias("_lacking"))  # one row
    return rows.join(marked, key).crossJoin(F.broadcast(lacking)).filter("_lacking = 0").drop("_has", "_lacking")


def error_rates(df: DataFrame, by: list[str], rep: str, y: Column, p: Column, w: Column) -> DataFrame:
    """(by, tpr, fpr): weighted rates of each repetition of cross-validation, averaged over the repetitions."""
    total = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    each = df.groupBy(*by, rep).agg(F.try_divide(total((y == 1) & (p == 1)), total(y == 1)).alias("tpr"), F.try_divide(total((y == 0) & (p == 1)), total(y == 0)).alias("fpr"))
    return each.groupBy(*by).agg(F.avg("tpr").alias("tpr"), F.avg("fpr").alias("fpr"))


def corrected_table(shares: DataFrame, by: str, rates: tuple[float, float], samples: DataFrame, level: float = 0.95) -> DataFrame:
    """(by, papers, papers_low, papers_high, citations, ...): corrected shares of every author with percentile intervals
    over samples (rep, tpr, fpr), and a row Average whose interval is that of the mean over authors in each sample.

    shares (by, flagged, cites). The samples are one row with an array of some thousand rates, spread over the authors.
    """
    edge = (1 - level) / 2
    names = ("papers", "citations")
    point = lambda tpr, fpr: [c.alias(n) for n, c in zip(names, corrected_shares(F.col("flagged"), F.col("cites"), tpr, fpr), strict=True)]
    exact = shares.select(F.col(by).cast("string").alias(by), "flagged", "cites", *point(F.lit(rates[0]), F.lit(rates[1])))
    exact = exact.unionByName(exact.agg(F.lit("Average").alias(by), *[F.avg(c).alias(c) for c in ("flagged", "cites", *names)]))
    packed = samples.agg(F.collect_list(F.struct("rep", "tpr", "fpr")).alias("_s"))  # one row
    drawn = shares.crossJoin(F.broadcast(packed)).select(F.col(by).cast("string").alias(by), "flagged", "cites", F.explode("_s").alias("_d")).select(by, F.col("_d.rep").alias("rep"), *point(F.col("_d.tpr"), F.col("_d.fpr")))
    mean = drawn.groupBy("rep").agg(F.lit("Average").alias(by), *[F.avg(c).alias(c) for c in names])
    ends = drawn.unionByName(mean).groupBy(by).agg(*[F.percentile(c, F.array(F.lit(edge), F.lit(1 - edge))).alias(f"_{c}") for c in names])
    wide = ends.select(by, *[F.col(f"_{c}")[i].alias(f"{c}_{side}") for c in names for i, side in enumerate(("low", "high"))])
    return exact.join(wide, by).select(by, "flagged", "cites", *[f"{c}{s}" for c in names for s in ("", "_low", "_high")])
