"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources in the order of their names (nulls last) weigh 1, 2, 3, 1, 2, 3, ... and share the total size by weight;
no target exceeds `most` times its source, what it would have had more is shared again by weight until none exceeds.
Sources are a table: they are numbered in ranges, and each round of sharing is one aggregate over them.

Every document of a source is to be taken target / source_size times: the integral part is certain, the fraction is
rounded dependently. Two documents with fractions p and q and sizes s and t trade words: either the first gains
d = min((1 - p) s, q t) or it loses g = min(p s, (1 - q) t), with probabilities g / (d + g) and d / (d + g), so each keeps
its expectation, the words of the pair stay the same, and one of the two becomes integral. What remains of a bucket of
about `bucket` documents is one document with a fraction, and with it a reserve of the bucket's smallest documents, not yet
rounded, large enough to make up for the bucket's longest document if half of the bucket can. Both go up a reduction
tree, `fan` buckets at a time, to one group per source.

There the longest documents trade with all smaller ones at once, strictly from the longest to the shortest: one with
fraction p becomes 1 with probability p, and the words so won or lost are shared among the smaller ones in proportion to
what they can give and take in either case, so all keep their expectations and the words stay the same. The rest is paired,
and the last residual and the smallest documents are settled in the same order. Where all smaller documents together cannot
make up for one (a long one in a source of few), chance decides if that misses the total by no more than a thousandth of
the target; otherwise the outcome is taken after which less is owed, and the smaller ones take over what they can. Of the last
14 chance decides while the best choice of the others still comes within a hundredth of the target; otherwise the outcome
is taken from which it comes nearer. For such documents the expectation shifts: target and expectation cannot both be kept.
Random numbers are hashes of seed and document, so reruns agree.

Defined results: null text has size 0; documents without words are taken as often as the integral part says; sources
without words have target 0; rows with repeated or null keys are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, growing, materialise, numbered, with_uid

WORD = r"[^\x20\x09-\x0D]+"
BUCKET, FAN, RESERVE, LONGEST, EXACT = 4096, 64, 256, 128, 14


def source_targets(sources: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sources (_source, words, ...) with `target`, written: the total shared by weight below the limits.

    Every round finds the share of a unit of weight among the sources not yet at their limit; it only grows, so a source
    at its limit stays there. A round gives the driver one row.
    """
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = numbered(sources, F.col("_source").asc_nulls_last())
    limit, weight = F.col("words") * F.lit(float(most)), F.element_at(kinds, (F.col("_nth") % len(weights) + 1).cast("int"))
    rows = materialise(ranked.withColumn("_limit", limit).withColumn("_weight", weight).drop("_nth"), "sources")
    total = float(rows.agg(F.sum("words")).first()[0] or 0)
    part, over = 0.0, -1
    while True:
        full = F.col("_limit") < F.lit(part) * F.col("_weight")
        found = rows.agg(F.sum(F.when(full, F.col("_limit")).otherwise(0.0)).alias("limits"), F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("free"), F.count_if(full).alias("n")).first()
        if found.n == over or not found.free:
            break
        over, part = found.n, (total - found.limits) / found.free
    goal = F.when(full, F.col("_limit")).otherwise(F.least(F.lit(part) * F.col("_weight"), F.col("_limit")))
    return rows.withColumn("target", goal).drop("_limit", "_weight")


def chance(*parts: object) -> float:
    """A number in [0, 1) that depends on the parts alone."""
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=7).digest(), "big") / (1 << 56)


def reserve(sizes: np.ndarray, parts: np.ndarray) -> int:
    """How many of the smallest documents (sizes descend) can take over what rounding the longest one wins or loses; half of all or of a bucket at most."""
    if not len(sizes):
        return 0
    part = float(np.median(parts))
    need = 2 * sizes[0] / max(min(part, 1 - part), 1e-6)
    return min(len(sizes) // 2, BUCKET // 2, max(RESERVE, int(np.searchsorted(np.cumsum(sizes[::-1]), need)) + 1))


def pivotal(ids: list, sizes: list[float], parts: list[float], seed: int) -> tuple[list[int | None], int | None, float]:
    """Rounds the fractions of one bucket: bits (None for the residual), the residual's index and its fraction."""
    bits: list[int | None] = [None] * len(ids)
    held, p = None, 0.0
    for j, q in enumerate(parts):
        if q <= 1e-12 or q >= 1 - 1e-12 or sizes[j] <= 0:
            bits[j] = int(q > 0.5) if sizes[j] > 0 else 0
            continue
        if held is None:
            held, p = j, q
            continue
        s, t = sizes[held], sizes[j]
        gain, loss = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        move = gain if chance(seed, ids[held], ids[j]) * (gain + loss) < loss else -loss
        p, q = p + move / s, q - move / t
        done = [x <= 1e-9 or x >= 1 - 1e-9 for x in (p, q)]
        if done[1]:
            bits[j] = int(q > 0.5)
        if done[0]:
            bits[held] = int(p > 0.5)
            held, p = (None, 0.0) if done[1] else (j, q)
    return bits, held, p


def subset_sums(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(1)
    for x in sizes:
        out = np.concatenate([out, out + x])
    return out


def settle(ids: list, sizes: list[float], parts: list[float], seed: int, goal: float, count: int | None = None) -> list[int | None]:
    """Bits of documents in descending size: each trades with all later ones at once, as far as they can make up for it.

    count: only the first so many; the others get None. parts is updated.
    """
    s, p = np.asarray(sizes, float), np.clip(np.asarray(parts, float), 0.0, 1.0)
    bits: list[int | None] = [None] * len(ids)
    off = 0.0  # words still owed by what could not be made up for
    for i in range(len(ids) if count is None else min(count, len(ids))):
        if s[i] <= 0 or p[i] <= 1e-12 or p[i] >= 1 - 1e-12:
            bits[i] = int(p[i] > 0.5) if s[i] > 0 else 0
            continue
        rest = slice(i + 1, None)
        room = s[rest] * np.minimum(p[rest] / ((1 - p[i]) * s[i]), (1 - p[rest]) / (p[i] * s[i]))
        total = float(room.sum())
        bit = int(chance(seed, "last", ids[i]) < p[i])
        if len(ids) - i - 1 <= EXACT:
            # what each outcome leaves over when the others are taken as fits best
            sums, due = subset_sums(s[rest]), off + float((p[i:] * s[i:]).sum())
            lacks = [float(np.abs(due - b * s[i] - sums).min()) for b in (0, 1)]
            if lacks[bit] > max(lacks[1 - bit], goal / 100):
                bit = 1 - bit
        if total >= 1 and not off and (p[i] - bit) * s[i] <= float(((1 - p[rest]) * s[rest]).sum()) and (bit - p[i]) * s[i] <= float((p[rest] * s[rest]).sum()):
            p[rest] += np.divide((p[i] - bit) * s[i] * room / total, s[rest], out=np.zeros(len(room)), where=s[rest] > 0)
        else:
            up, down = float(((1 - p[rest]) * s[rest]).sum()), float((p[rest] * s[rest]).sum())
            if len(ids) - i - 1 > EXACT:
                lacks = [max(off + p[i] * s[i] - up, 0.0), max((1 - p[i]) * s[i] - off - down, 0.0)]
                if lacks[bit] > max(lacks[1 - bit], goal / 1000):
                    bit = 1 - bit
            owed = off + (p[i] - bit) * s[i]
            if owed > 0:
                p[rest] += (1 - p[rest]) * min(1.0, owed / up if up else 0.0)
            else:
                p[rest] *= 1 - min(1.0, -owed / down if down else 0.0)
            off = max(owed - up, 0.0) if owed > 0 else min(owed + down, 0.0)
        p[rest] = np.clip(p[rest], 0.0, 1.0)
        bits[i] = p[i] = bit
    parts[:] = p.tolist()
    return bits


def round_group(ids: list, sizes: list[float], parts: list[float], seed: int, goal: float, final: bool) -> tuple[list[int | None], list[float]]:
    """Bits (None: still open) and fractions of a group whose sizes descend; final leaves nothing open."""
    full = sum(x > 0 for x in sizes)
    bits: list[int | None] = [None] * full + [0] * (len(ids) - full)
    parts = list(parts)
    if final:
        head = settle(ids[:full], sizes[:full], (mine := parts[:full]), seed, goal, LONGEST)
        parts[:full], bits[:full] = mine, head
    spare = min(full, 2 * RESERVE) if final else reserve(np.array(sizes[:full]), np.array(parts[:full]))
    open_ones = sorted((i for i in range(full - spare) if bits[i] is None), key=lambda i: chance(seed, "t", ids[i]))
    pick = lambda at: ([ids[i] for i in at], [sizes[i] for i in at], [parts[i] for i in at])
    got, held, p = pivotal(*pick(open_ones), seed)
    for i, x in zip(open_ones, got, strict=True):
        bits[i] = x
    if held is not None:
        parts[open_ones[held]] = p
    if final:
        rest = [i for i in range(full) if bits[i] is None]
        for i, x in zip(rest, settle(*pick(rest), seed, goal), strict=True):
            bits[i] = x
    return bits, parts


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 20, bucket: int = BUCKET, fan: int = FAN, carry: list[str] | None = None) -> DataFrame:
    """df's rows as _row (a struct of the columns `carry`, all by default) with size, source_size, target, copies and taken (copies * size)."""
    col = lambda c: F.col(f"`{c}`")
    picked = df.select(F.struct(*[col(c) for c in carry or df.columns]).alias("_row"), col(key).alias("_key"), col(source).cast("string").alias("_source"), F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"))
    docs = with_uid(picked, "_key", ["_row", "_source", "_size"])
    narrow = materialise(docs.select("_uid", "_source", "_size"), "sizes")
    per = narrow.groupBy("_source").agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("docs"))
    share = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    # an integral part within rounding error of the next whole number counts as that number
    whole = F.floor(share + 1e-9)
    goals = source_targets(per, most, weights)
    goals = goals.select(F.col("_source").alias("_name"), F.col("words").alias("source_size"), "target", whole.alias("_whole"), F.greatest(F.lit(0.0), share - whole).alias("_part"), F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket)).cast("long").alias("_buckets"))
    table = materialise(goals, "goals")
    rows = narrow.join(table, F.col("_source").eqNullSafe(F.col("_name"))).select("_uid", "_source", "_size", "_part", F.col("target").alias("_goal"), F.pmod(F.xxhash64("_uid"), F.col("_buckets")).alias("_bucket"))
    schema = "_uid long, _source string, _size long, _part double, _goal double, _bucket long, _bit int"

    def work_at(final: bool):
        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            # the order decides who trades with whom, so it must not depend on how the rows arrived
            pdf = pdf.assign(_o=[chance(seed, "o", u) for u in pdf["_uid"]]).sort_values(["_size", "_o", "_uid"], ascending=False).drop(columns="_o").reset_index(drop=True)
            bits, parts = round_group(pdf["_uid"].tolist(), pdf["_size"].tolist(), pdf["_part"].tolist(), seed, float(pdf["_goal"].iloc[0]), final)
            return pdf.assign(_bit=pd.array(bits, dtype="Int32"), _part=parts)[["_uid", "_source", "_size", "_part", "_goal", "_bucket", "_bit"]]

        return work

    level, decided, at = table.agg(F.max("_buckets")).first()[0] or 1, [], rows
    while True:
        done = materialise(at.groupBy("_source", "_bucket").applyInPandas(work_at(level == 1), schema), "rounded")
        decided.append(done.filter("_bit is not null").select("_uid", "_bit"))
        if level == 1:
            break
        level = -(-level // fan)
        at = done.filter("_bit is null").select("_uid", "_source", "_size", "_part", "_goal", F.floor(F.col("_bucket") / fan).alias("_bucket"))
    bits = decided[0]
    for x in decided[1:]:
        bits = bits.unionByName(x)
    discard(narrow)
    joined = docs.join(growing(bits), "_uid").join(table, F.col("_source").eqNullSafe(F.col("_name")))
    copies = (F.col("_whole") + F.col("_bit")).cast("long")
    return joined.select("_row", F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """df's rows as often as the mix takes them, all columns kept; rows it takes no time are gone."""
    return _repeated(mix(df, **options))


def _repeated(taken: DataFrame) -> DataFrame:
    return taken.filter("copies > 0").select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
