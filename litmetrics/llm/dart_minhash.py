"""MinHash near-dedup with DartMinHash signatures.

The elements of a text are its word shingles, their weights how often they occur in it. Every element of such a
weighted set owns a region: `weight` wide and as high as needed. Darts fall on the plane of
(element, weight, time) as a Poisson process of rate 1 that depends only on hashes, so a dart is the same for every text
whose region holds it. Each dart names one of `bands * rows` coordinates; a coordinate keeps its earliest dart. Two
texts agree in a coordinate with the probability of their weighted Jaccard similarity. About k ln k + 2k darts fill a
signature of k coordinates, however large the set is; texts with an empty coordinate throw again over twice the time.

Stages: equal texts are one representative; signatures are cut into bands; the texts of a band bucket are compared with
the one among them that shares most buckets with others, and those that fail with all others of its buckets not yet in their class, in blocks where
there are many, so that groups of thousands give thousands of pairs, not millions; the comparison is exact (sum of the
smaller weights over the sum of the larger ones, at least the threshold); classes are connected components.

At similarity 0.8 a pair shares no band with probability (1 - 0.8^6)^40 = 5e-6.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a text with 1 to 4 words has one shingle of all its words; texts without
words (null, empty, white space) are classes of their own; rows with repeated or null ids are documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, growing, materialise, mix64, pieces, releasing, utf8_column, with_uid, word_places
from .graph import components

BANDS, ROWS = 40, 6
WORDS = 5
BLOCK = 1 << 18
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def shingles(offsets: np.ndarray, data: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of each distinct word shingle of the texts data[offsets[i]:offsets[i + 1]], by text and hash."""
    none = np.zeros(0, np.int64)
    text, _, _, word = word_places(offsets, data)
    if not len(word):
        return none, none.astype(np.uint64), none
    size = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(size) - size
    at = np.arange(len(word)) - first[text]
    span = np.minimum(size, words)
    starts = np.flatnonzero(at <= (size - span)[text])
    code = np.zeros(len(starts), np.uint64)
    for i in range(words):
        inside = i < span[text[starts]]
        code = mix64(code * _ODD[0] + np.where(inside, word[np.minimum(starts + i, len(word) - 1)], np.uint64(i)))
    who = text[starts]
    order = np.lexsort((code, who))
    who, code = who[order], code[order]
    heads = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (code[1:] != code[:-1])]))
    return who[heads], code[heads], np.diff(np.append(heads, len(who)))


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k signatures (bits of the earliest dart's time) of n weighted sets; the owners ascend, sets without weight keep the largest value."""
    out = np.full(n * k, np.inf)
    total = np.bincount(owner, weights=weight, minlength=n)
    need = k * math.log(k) + 2 * k
    until = np.divide(need, total, out=np.zeros(n), where=total > 0)
    active = total > 0
    while active.any():
        use = np.flatnonzero(active[owner])
        units = np.ceil(weight[use]).astype(np.int64)
        high = np.ceil(until[owner[use]]).astype(np.int64)
        cells = units * high
        edges = np.concatenate([[0], np.cumsum(cells)])
        at = 0
        while at < len(use):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + BLOCK, "right")) - 1)
            # a single element may own more cells than a block: its cells are cut as well
            for lo in range(int(edges[at]), int(edges[to]), BLOCK if to == at + 1 else int(edges[to] - edges[at]) or 1):
                hi = min(int(edges[to]), lo + BLOCK) if to == at + 1 else int(edges[to])
                cell = np.arange(lo, hi)
                e = np.searchsorted(edges[at : to + 1], cell, "right") - 1 + at if to > at + 1 else np.full(hi - lo, at)
                inner = cell - edges[e]
                time, unit = inner % high[e], inner // high[e]
                seed = mix64(element[use[e]] + time.astype(np.uint64) * _ODD[1] + unit.astype(np.uint64) * _ODD[2])
                thrown = np.searchsorted(_POISSON, (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53, "right")
                cell = np.repeat(np.arange(hi - lo), thrown)
                nth = np.arange(len(cell)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
                dart = mix64(seed[cell] + (nth + 1).astype(np.uint64) * _ODD[0])
                when = time[cell] + (dart >> np.uint64(11)).astype(np.float64) * 2.0**-53
                dart = mix64(dart)
                who = use[e[cell]]
                keep = when < until[owner[who]]
                across = unit[cell] + (mix64(dart + _ODD[1]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                keep &= across < weight[who]
                np.minimum.at(out, owner[who[keep]] * k + (dart[keep] % np.uint64(k)).astype(np.int64), when[keep])
            at = to
        active &= np.isinf(out.reshape(n, k)).any(axis=1)
        until[active] *= 2
    return out.reshape(n, k).view(np.uint64)


def _signing(bands: int, rows: int, words: int, weighted: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            offsets, data = utf8_column(batch, "_text")
            for i, j in pieces(offsets, BLOCK):
                own = offsets[i : j + 1] - offsets[i]
                who, code, count = shingles(own, data[offsets[i] : offsets[j]], words)
                weight = count.astype(np.float64) if weighted else np.ones(len(code))
                sig = dart_signatures(who, code, weight, j - i, bands * rows).reshape(j - i, bands, rows)
                keys = np.broadcast_to(salt, (j - i, bands)).copy()
                for r in range(rows):
                    keys = mix64(keys * _ODD[0] + sig[:, :, r])
                size = np.bincount(who, minlength=j - i)
                flat = pa.array(keys.view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([batch.column("_uid").slice(i, j - i), batch.column("digest").slice(i, j - i), pa.array(size.astype(np.int64)), lists], names=["_uid", "digest", "size", "keys"])

    return work


def _sets(words: int, weighted: bool):
    """Weights as sets: the i-th occurrence of a shingle is an element of its own, so the similarity of two such sets is the weighted one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8_column(batch, "_text")
            for i, j in pieces(offsets, BLOCK):
                who, code, count = shingles(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], words)
                if weighted:
                    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    who, code = np.repeat(who, count), np.repeat(code, count)
                    code = np.where(nth > 0, mix64(code + nth.astype(np.uint64) * _ODD[0]), code)
                    order = np.lexsort((code, who))  # who ascends already
                    code = code[order]
                marks = np.searchsorted(who, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(marks), pa.array(code.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("_uid").slice(i, j - i), lists], names=["_uid", "set"])

    return work


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b, ...) with `similar`: the sets' Jaccard similarity reaches the threshold."""
    one = sets.select(F.col("_uid").alias("b"), F.col("set").alias("set_b"))
    two = sets.select(F.col("_uid").alias("a"), F.col("set").alias("set_a"))
    sized = growing(growing(pairs).join(one, "b")).join(two, "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    possible = F.least(F.size("set_a"), F.size("set_b")) >= F.lit(threshold) * F.greatest(F.size("set_a"), F.size("set_b")) - 1e-9
    return sized.select(*pairs.columns, F.when(possible, both >= F.lit(threshold) * either - 1e-9).otherwise(F.lit(False)).alias("similar"))


def spanning_links(x: list[np.ndarray], cx: np.ndarray, y: list[np.ndarray], cy: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Places (i, j) of similar sets x[i], y[j] of different classes, only so many as join all classes that links join."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    ax, ay = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(ax, ay)
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    both = np.zeros((len(x), len(y)), np.float32)
    at_x, at_y = np.searchsorted(common, ax), np.searchsorted(common, ay)
    of_x, of_y = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    for lo in range(0, len(common), 4096):  # so many columns at once
        part = common[lo : lo + 4096]
        mx, my = np.zeros((len(x), len(part)), np.float32), np.zeros((len(y), len(part)), np.float32)
        for m, values, at, of in ((mx, ax, at_x, of_x), (my, ay, at_y, of_y)):
            use = (at >= lo) & (at < lo + len(part))
            use[use] = common[at[use]] == values[use]
            m[of[use], at[use] - lo] = 1
        both += mx @ my.T
    similar = both >= threshold * (nx[:, None] + ny[None, :] - both) - 1e-6 * np.maximum(1, both)
    out = []
    for i, j in zip(*np.nonzero(similar & (cx[:, None] != cy[None, :])), strict=True):
        p, q = root(int(cx[i])), root(int(cy[j]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(i), int(j)))
    return out


def _second_links(checked: DataFrame, known: DataFrame, sets: DataFrame, threshold: float, few: int = 1024, block: int = 1024) -> tuple[DataFrame, list[DataFrame]]:
    """Links of texts that differ from their leader with the other texts of its buckets, where these are of another class.

    checked (a: leader, b, similar). Families with at most `few` comparisons are joined; larger ones are cut into blocks
    of texts, and every two blocks meet in one task that returns spanning links, so no pairs are written out.
    """
    tagged = checked.join(known.withColumnRenamed("node", "b"), "b", "left").select("a", "b", "similar", F.coalesce("component", "b").alias("c"))
    size = tagged.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("similar")).alias("lost"), F.min("c").alias("low"), F.max("c").alias("high"))
    open_ones = size.filter("lost > 0 and n > 1 and low != high").select("a", "n", "lost")
    rows = materialise(tagged.join(open_ones, "a"), "families")
    small, large = rows.filter(F.col("n") * F.col("lost") <= few), rows.filter(F.col("n") * F.col("lost") > few)
    lost = small.filter("not similar").select("a", F.col("b").alias("x"), F.col("c").alias("cx"))
    others = small.select("a", F.col("b").alias("y"), F.col("c").alias("cy"))
    pairs = lost.join(others, "a").filter("cx != cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found = _verified(pairs, sets, threshold).filter("similar").select("a", "b")
    if not large.limit(1).count():
        return found, [rows]
    blocks = lambda c: F.ceil(F.col(c) / block).cast("long")
    own = lambda c: F.pmod(F.xxhash64("b"), blocks(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), blocks(c) - 1))
    left = large.filter("not similar").select("a", own("lost").alias("i"), each("n").alias("j"), "b", "c")
    right = large.select("a", each("lost").alias("i"), own("n").alias("j"), "b", "c")
    content = sets.select(F.col("_uid").alias("b"), "set")

    def work(cell: pd.DataFrame) -> pd.DataFrame:
        x, y = cell[cell["side"] == 0], cell[cell["side"] == 1]
        links = spanning_links(x["set"].tolist(), x["c"].to_numpy(), y["set"].tolist(), y["c"].to_numpy(), threshold) if len(x) and len(y) else []
        a, b = x["b"].to_numpy()[[i for i, _ in links]], y["b"].to_numpy()[[j for _, j in links]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}, dtype=np.int64)

    cells = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).join(content, "b")
    met = cells.groupBy("a", "i", "j").applyInPandas(work, "a long, b long")
    return found.unionByName(met), [rows]


def near_duplicate_classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, weighted: bool = True) -> DataFrame:
    """(key, _uid, class_id, kept): class_id is the smallest row number of the class (the key, where keys are unique), whose row is kept.

    weighted: shingles weigh as often as they occur, in signatures, bands and links; otherwise each weighs 1.
    """
    picked = df.select(F.col(text).alias("_text"), F.col(key).alias("_key"))
    docs = with_uid(picked, "_key", ["_text", "_key"])
    hashed = docs.select("_uid", "_text", F.unhex(F.md5(F.col("_text").cast("binary"))).alias("digest"))
    signed = materialise(hashed.mapInArrow(releasing(_signing(bands, rows, words, weighted)), "_uid long, digest binary, size long, keys array<long>"), "signatures")
    worded = signed.filter("size > 0")
    copies = materialise(worded.groupBy("digest").agg(F.min("_uid").alias("rep")), "copies")
    chosen = worded.join(growing(copies.select(F.col("rep").alias("_uid"))), "_uid", "left_semi")
    entries = materialise(chosen.select("_uid", F.explode("keys").alias("bucket")), "bands")
    crowds = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = materialise(entries.join(crowds, "bucket"), "shared")
    discard(entries)
    # the text that meets most others leads its buckets: the original of a group resembles its copies more than they each other
    degrees = shared.groupBy("_uid").agg(F.sum("members").alias("degree"))
    leaders = shared.join(degrees, "_uid").groupBy("bucket").agg(F.max_by("_uid", F.struct("degree", -F.col("_uid"))).alias("leader"))
    members = materialise(shared.join(leaders, "bucket"), "buckets")
    discard(shared)
    pairs = members.filter("_uid != leader").select(F.col("leader").alias("a"), F.col("_uid").alias("b")).distinct()  # one row for each member and leader
    pairs = materialise(pairs, "pairs")
    involved = members.select("_uid").distinct()
    sets = materialise(docs.select("_uid", "_text").join(growing(involved), "_uid", "left_semi").mapInArrow(releasing(_sets(words, weighted)), "_uid long, set array<long>"), "sets")
    discard(members)
    checked = materialise(_verified(pairs, sets, threshold), "checked")
    discard(pairs)
    written = [checked, sets]
    links = checked.filter("similar").select("a", "b")
    if checked.filter("not similar").limit(1).count():
        # whoever differs from the leader meets the rest of the leader's buckets, unless both are already of one class
        known = materialise(components(links, "a", "b"), "known")
        more, used = _second_links(checked, known, sets, threshold)
        again = materialise(more, "again")
        written += [known, again, *used]
        links = links.unionByName(again)
    found = materialise(components(links, "a", "b"), "classes")
    for x in written:
        discard(x)
    ids = signed.select("_uid", "digest", "size").join(copies, "digest", "left").select("_uid", F.when(F.col("size") > 0, F.col("rep")).otherwise(F.col("_uid")).alias("rep"))
    classes = ids.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("_uid", F.coalesce("component", "rep").alias("class_id"))
    keyed = docs.select("_uid", "_key").join(classes, "_uid")
    return keyed.select(F.col("_key").alias(key), F.col("_uid"), "class_id", (F.col("_uid") == F.col("class_id")).alias("kept"))


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with one row of each class of near duplicates, all columns kept."""
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_body"))
    docs = with_uid(marked, "_id", ["_row", "_body"])
    classes = near_duplicate_classes(docs.select(F.col("_uid").alias("_row_id"), "_body"), "_row_id", "_body", **options)
    gone = classes.filter("not kept").select("_uid")  # less than what stays
    return docs.join(growing(gone), "_uid", "left_anti").select("_row.*")
