"""Stratified bootstrap by counts: how often each row occurs in each replicate, without a row for any draw.

Drawing n rows of a stratum of n with replacement gives its rows multinomial counts. They are drawn from the whole to the
parts: a stratum is halved again and again by the first bits of its rows' hashes, and of the draws that fall into a part a
binomial number falls into its half; inside the last ranges it goes on block by block and row by row. Every task draws
the halvings above its own ranges anew from the same seeds, so all agree and the draws of a stratum are exactly n. A
replicate's total of any value is the sum of counts times values: each task returns one row a replicate with all its
totals, and Spark adds these up. All totals asked for are of the same draws, so methods and repetitions are paired.

Defined results: a null value counts as 0; null strata are one stratum; an empty table has no replicates.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded

BITS, ROWS, BLOCK = 12, 4096, 64


def halved(path: list[int], at: int, replicates: int, seed: list[int]) -> np.ndarray:
    """How many draws of each replicate fall into range `at` of a stratum of a power of two of ranges. path: the rows of the
    whole stratum, of the half that holds the range, of its half that does, and so on down to the range."""
    low, high = 0, 1 << (len(path) - 1)
    drawn = np.full(replicates, path[0], np.int64)
    for whole, own in zip(path[:-1], path[1:], strict=True):
        middle = (low + high) // 2
        left = own if at < middle else whole - own
        first = np.random.default_rng([*seed, low, high]).binomial(drawn, left / whole if whole else 0.0)
        drawn, low, high = (first, low, middle) if at < middle else (drawn - first, middle, high)
    return drawn


def counted(rows: int, drawn: np.ndarray, seed: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks (first, last + 1, counts by replicate and row) of a range's rows, of which so many are drawn."""
    rng = np.random.default_rng(seed)
    for a in range(0, rows, BLOCK):
        b = min(a + BLOCK, rows)
        own = rng.binomial(drawn, (b - a) / (rows - a))
        drawn = drawn - own
        yield a, b, rng.multinomial(own, np.full(b - a, 1 / (b - a)))


def bootstrap_totals(df: DataFrame, strata: list[str], key: str, values: dict[str, Column], replicates: int = 2000, seed: int = 42, bits: int | None = None) -> DataFrame:
    """(rep, totals of the values): for each replicate, 1 to replicates. bits: a stratum has 2 ** bits ranges; by default
    as many as leave about ROWS rows to each."""
    names = list(values)
    picked = df.select(F.to_json(F.struct(*strata), {"ignoreNullFields": "false"}).alias("_s") if strata else F.lit("").alias("_s"), seeded(F.col(key), F.lit(seed)).alias("_u"), F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values.values()]).alias("_v"))
    if bits is None:
        bits = min(BITS, max(0, (picked.count() // ROWS).bit_length()))
    ranged = picked.withColumn("_range", F.shiftright(F.conv(F.substring("_u", 1, 3), 16, 10).cast("int"), 12 - bits))
    per = ranged.groupBy("_s", "_range").agg(F.count(F.lit(1)).alias("_n"))
    path = F.array(*[F.sum("_n").over(Window.partitionBy("_s", F.shiftright("_range", bits - level))) for level in range(bits + 1)])
    # a row a range, with BITS + 1 numbers at most: what a row of the table bears must not grow with the number of ranges
    facts = F.broadcast(per.select(F.col("_s").alias("_t"), F.col("_range").alias("_r"), path.alias("_path")))
    # sorted after the join, beneath which a sort would be dropped
    same = (F.col("_s") == F.col("_t")) & (F.col("_range") == F.col("_r"))
    dealt = ranged.repartition("_s", "_range").join(facts, same).select("_s", "_range", "_u", "_v", "_path").sortWithinPartitions("_s", "_range", "_u", "_v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, held, last = np.zeros((replicates, len(names))), [], None
        seen = False

        def close() -> None:
            stratum, at, path = last
            own = [seed, zlib.crc32(stratum.encode())]
            x = np.concatenate(held)
            for a, b, counts in counted(len(x), halved(path, at, replicates, own), [*own, at, 1 << 20]):
                totals[:] += counts @ x[a:b]
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            x = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(names))
            groups = list(zip(batch.column("_s").to_pylist(), batch.column("_range").to_pylist(), strict=True))
            edges = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1]], len(groups)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if last is not None and last[:2] != groups[a]:
                    close()
                if last is None or last[:2] != groups[a]:
                    last = (*groups[a], batch.column("_path")[a].as_py())
                held.append(x[a:b])
        if seen:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1, dtype=np.int32)), pa.array(list(totals), pa.list_(pa.float64()))], names=["rep", "v"])

    sums = dealt.mapInArrow(work, "rep int, v array<double>")
    return sums.groupBy("rep").agg(*[F.sum(F.get("v", F.lit(i))).alias(c) for i, c in enumerate(names)])


def rate_samples(df: DataFrame, strata: list[str], key: str, rep: str, y: Column, p: Column, w: Column, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(rep, tpr, fpr): in each replicate the weighted rates of every repetition of cross-validation, averaged over the
    repetitions; rep 0 is the table itself. df: a row for each key and repetition; a repetition without positives or
    negatives in a replicate is left out there."""
    known = sorted(r[0] for r in df.select(rep).distinct().collect())  # the repetitions of a cross-validation
    named = df.select(*strata, F.col(key).alias("_k"), F.col(rep).alias("_rep"), y.alias("_y"), p.alias("_p"), w.cast("double").alias("_w"))
    flags = [F.max(F.when(F.col("_rep") == r, F.col("_p"))).alias(f"_p{i}") for i, r in enumerate(known)]
    there = [F.max(F.when(F.col("_rep") == r, 1)).alias(f"_h{i}") for i, r in enumerate(known)]
    wide = named.groupBy(*strata, "_k").agg(F.max("_y").alias("_y"), F.max("_w").alias("_w"), *flags, *there).cache()  # a row a key, read several times
    values = {}
    for i in range(len(known)):
        for name, own in (("t", F.col("_y") == 1), ("f", F.col("_y") == 0)):
            values[f"{name}{i}"] = F.when(own & (F.col(f"_h{i}") == 1), F.col("_w"))
            values[f"{name}{i}p"] = F.when(own & (F.col(f"_p{i}") == 1), F.col("_w"))
    drawn = bootstrap_totals(wide, strata, "_k", values, replicates, seed)
    exact = wide.agg(F.lit(0).alias("rep"), *[F.coalesce(F.sum(v), F.lit(0.0)).alias(c) for c, v in values.items()])
    every = drawn.unionByName(exact)

    def mean(name: str) -> Column:
        rates = F.filter(F.array(*[F.try_divide(f"{name}{i}p", f"{name}{i}") for i in range(len(known))]), lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(rates, F.lit(0.0), lambda a, x: a + x), F.size(rates))

    return every.select("rep", mean("t").alias("tpr"), mean("f").alias("fpr"))
