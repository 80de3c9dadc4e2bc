"""Quality rules by host, in DataFrame expressions only.

Each text gets counts (words, symbols, repeated lines, words in repeated three-word windows) and a few rules over them.
Failures are added up by host for every rule; a host's rate is shrunk towards the rate of all rows with a beta prior
whose strength is fitted to the spread of the hosts' rates (moments), so that small hosts need more evidence. A host
with a shrunk rate above `max_rate` in any rule is rejected, and with it all its rows; rows that fail the base rule
themselves are rejected anyhow.

Three-word windows are compared by 64-bit hashes within one text. Counting needs no window of one text in another's
row: everything of a text stays in its row.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; null text has none; rows with a null host form one host; ratios of
texts without words fail no ratio rule; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"  # none is special between brackets of an expression, as they stand
MIN_WORDS, MAX_REPEATED = 50, 50  # words, per cent
#: name -> (numerator, denominator, limit): a text fails where numerator > limit * denominator
RATIO_RULES = {"symbols": ("n_symbols", "n_words", 0.5), "lines": ("n_dup_lines", "n_lines", 0.5), "long_words": ("word_chars", "n_words", 15.0)}
MAX_RATE = 0.5
STRENGTH = (1.0, 10000.0)


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words of the column `text`.

    Every step is a projection of its own, so that arrays used several times are built once; only texts in which some
    window occurs twice pay for sorting their windows.
    """
    blanks = " \t\n\x0b\x0c\r"
    held = F.col("_r")
    step = df.select("*", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_b"))
    step = step.select("*", F.btrim("_b", F.lit(blanks)).alias("_t"))
    step = step.select("*", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", r"[\x20\x09-\x0D]+", -1)).alias("_w"), F.filter(F.split("_b", "\n", -1), lambda x: x.rlike(WORD)).alias("_l"))
    step = step.select("*", F.size("_w").alias("_n"))
    triple = F.arrays_zip(F.slice("_w", F.lit(1), F.col("_n") - 2).alias("x"), F.slice("_w", F.lit(2), F.col("_n") - 2).alias("y"), F.slice("_w", F.lit(3), F.col("_n") - 2).alias("z"))
    step = step.select("*", F.when(F.col("_n") >= 3, F.transform(triple, lambda t: F.xxhash64(t["x"], t["y"], t["z"]))).alias("_h"))
    step = step.select("*", (F.size(F.array_distinct("_h")) < F.size("_h")).alias("_twice"))
    step = step.select("*", F.when(F.col("_twice"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_r"))
    none = F.array(F.lit(None).cast("struct<h: bigint, i: int>"))
    near = F.filter(
        F.arrays_zip(F.concat(none, held).alias("b"), F.concat(held, none).alias("o"), F.concat(F.slice(held, F.lit(2), F.size(held)), none, none).alias("a")),
        lambda x: F.coalesce(x["b"]["h"] == x["o"]["h"], F.lit(False)) | F.coalesce(x["a"]["h"] == x["o"]["h"], F.lit(False)),
    )
    step = step.select("*", F.when(F.col("_twice"), F.transform(near, lambda x: x["o"]["i"])).alias("_p"))
    covered = F.size(F.array_distinct(F.concat(F.col("_p"), F.transform("_p", lambda p: p + 1), F.transform("_p", lambda p: p + 2))))
    return step.select(
        *df.columns,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.when(F.col("_b").rlike(f"[{SYMBOLS}]"), F.length("_b") - F.length(F.translate("_b", SYMBOLS, ""))).otherwise(F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.when(F.col("_twice"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def host_verdicts(rows: DataFrame, failures: list[str], max_rate: float = MAX_RATE) -> DataFrame:
    """rows (_host, failures as 0/1): (_host, host_failed), one row per host, null host included."""
    hosts = rows.groupBy("_host").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f).cast("double").alias(f) for f in failures])
    mean = hosts.agg(*[(F.sum(f) / F.sum("n")).alias(f"m_{f}") for f in failures])
    spread = hosts.crossJoin(F.broadcast(mean)).agg(*[F.avg((F.col(f) / F.col("n") - F.col(f"m_{f}")) * (F.col(f) / F.col("n") - F.col(f"m_{f}"))).alias(f"v_{f}") for f in failures], *[F.first(f"m_{f}").alias(f"m_{f}") for f in failures])
    low, high = STRENGTH

    def shrunk(f: str) -> Column:
        m, v = F.col(f"m_{f}"), F.col(f"v_{f}")
        strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(low)), F.lit(high))).otherwise(F.lit(high))
        return (F.col(f) + m * strength) / (F.col("n") + strength)

    failed = F.lit(False)
    for f in failures:
        failed = failed | (shrunk(f) > max_rate)
    # one row of means joins the hosts
    return hosts.crossJoin(F.broadcast(spread)).select("_host", failed.alias("host_failed"))


def quality_verdicts(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Per row: key, the counts, base_failed, and kept."""
    picked = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("_text"))
    counted = text_counts(picked, "_text").drop("_text")
    counted = counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    counts = materialise(counted, "counts")
    failing = counts.select("_host", F.col("base_failed").cast("int").alias("f_base"), *[(F.col(a) > F.lit(limit) * F.col(b)).cast("int").alias(f"f_{name}") for name, (a, b, limit) in RATIO_RULES.items()])
    # written, so that its size is known and the join can deal out a hot host
    verdicts = materialise(host_verdicts(failing, ["f_base", *[f"f_{name}" for name in RATIO_RULES]], max_rate), "hosts")
    joined = counts.join(verdicts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h")))
    return joined.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
