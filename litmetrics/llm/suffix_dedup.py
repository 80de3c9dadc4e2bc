"""Suffix-array dedup: removes every byte that lies in a string of `min_bytes` bytes which starts anywhere else too.

Plan
1. Each text is scanned once. A window of `min_bytes` bytes holds `min_bytes - gram + 1` grams; the smallest gram hash
   of every window is an anchor (minimum sampling), so two equal windows have anchors of one hash. An anchor's context
   is the union of the windows whose anchor it is. Only (hash, context digest, place) is shuffled, about one row in 140 bytes.
2. Anchors whose hash occurs once are done. Equal contexts (64 bits of hash and a 128-bit digest of their bytes) are one
   text with a multiplicity: all their windows repeat. A hash with several different contexts goes to a suffix array
   over one copy of each context.
3. Suffix array, two-stage sorting: only suffixes smaller than their successors are sorted directly, the larger ones
   are induced by scanning the buckets of first bytes in ascending order; common prefixes of neighbours in the array
   (capped at `min_bytes`, compared byte by byte) tell which windows repeat.
4. A hash with more than `group_limit` different contexts is dealt out without losing a window: a window that holds a
   known common core of length c must extend it by (min_bytes - c) bytes, at least half of them on one side, so the
   context is filed under the core grown by half on the left and under the core grown by half on the right. The groups
   so made go to suffix arrays like all others. After at most log2(min_bytes) rounds the core is a whole window: such a
   group is one string, there is nothing left to sort, and its places are counted by the window's bytes. Which of the
   two happens changes where the work is done, not what is found: both compare bytes.

Passages in words: with `min_words` a text is coded as eight bytes (a 64-bit hash) a word, and windows are `min_words`
words; white space then makes no difference. What is removed begins at a word and ends before the next one that stays.

Defined results: null text is empty; texts shorter than `min_bytes` (`min_words`) stay; rows with repeated or null ids
are judged as documents of their own; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_table, discard, fields, growing, materialise, mix64, pieces, powers, releasing, utf8_column, with_uid, word_places

GRAM = 128
GROUP_LIMIT = 512
BLOCK = 1 << 18  # bytes scanned or sorted at once, unless one text or group is longer
SEGMENT = 1 << 20  # longer texts are scanned in overlapping segments
SEPARATOR = 0xFF  # stands between texts; no window holds it, as only windows inside a text are asked for
CODE = 8  # bytes of a coded word


def anchors(data: np.ndarray, ends: np.ndarray, begins: np.ndarray, window: int, gram: int, own: tuple[int, int] | None = None):
    """Anchors of the texts data[begin:end]: place, hash, context begin, context end.

    Every window of `window` bytes inside a text holds an anchor whose hash is the window's smallest gram hash.
    own: return only anchors in this range of places; neighbouring segments own the others.
    """
    n, w = len(data), window - gram + 1
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty.astype(np.uint64), empty, empty
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_table(1)[data] * up[:n], out=sums[1:])
    hashes = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    ends_of = np.repeat(ends, ends - begins)
    begins_of = np.repeat(begins, ends - begins)
    places = np.arange(n)
    low = np.uint64(SEGMENT * 2 - 1)
    ranked = (hashes & ~low) | places[: n - gram + 1].astype(np.uint64)
    m = n - window + 1
    pad = -len(ranked) % w
    blocks = np.concatenate([ranked, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    smallest = np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])
    whole = np.flatnonzero(places[:m] + window <= ends_of[:m])
    at, head = np.unique((smallest[whole] & low).astype(np.int64), return_index=True)
    if not len(at):
        return empty, empty.astype(np.uint64), empty, empty
    # an anchor's windows stand in a row: the place of the smallest hash never moves back
    first, last = whole[head], whole[np.append(head[1:], len(whole)) - 1] + window
    if own is not None:
        mine = (at >= own[0]) & (at < own[1])
        at, first, last = at[mine], first[mine], last[mine]
    keep, thin = _thinned(at, hashes[at], w)
    first = np.where(thin, np.maximum(begins_of[at], at - (window - gram)), first)[keep]
    last = np.where(thin, np.minimum(ends_of[at], at + window), last)[keep]
    at = at[keep]
    return at, hashes[at], first, last


def _thinned(at: np.ndarray, hashes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors to keep: of equal hashes close together (runs, periods) only so many that no window goes without;
    and which of them stand in such a crowd and have to answer for the windows of the others."""
    near = (hashes[1:] == hashes[:-1]) & (at[1:] - at[:-1] < w // 2)
    keep, thin = np.ones(len(at), bool), np.zeros(len(at), bool)
    if near.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):  # at[a..b] share a hash
            thin[a : b + 1] = True
            i = a
            while i < b:
                j = max(i + 1, min(b, int(np.searchsorted(at, at[i] + w, "right")) - 1))
                keep[i + 1 : j] = False
                i = j
    return keep, thin


def _scan(window: int, gram: int, coded: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _coded(batches) if coded else batches:
            offsets, data = utf8_column(batch, "_text")
            uid = batch.column("_uid").to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets, BLOCK):
                if j == i + 1 and offsets[j] - offsets[i] > SEGMENT:
                    starts = range(int(offsets[i]), int(offsets[j]), SEGMENT - window)
                    parts = [(s, min(s + SEGMENT, int(offsets[j]))) for s in starts]
                else:
                    parts = [(int(offsets[i]), int(offsets[j]))]
                for lo, hi in parts:
                    # a segment also sees the bytes around it, so that contexts are whole
                    lo2, hi2 = max(int(offsets[i]), lo - window), min(int(offsets[j]), hi + window)
                    begins, ends = np.clip(offsets[i:j], lo2, hi2) - lo2, np.clip(offsets[i + 1 : j + 1], lo2, hi2) - lo2
                    own = (lo - lo2, min(hi, lo + SEGMENT - window) - lo2) if len(parts) > 1 else None
                    at, h, first, last = anchors(data[lo2:hi2], ends, begins, window, gram, own)
                    raw = memoryview(data[lo2:hi2].tobytes())
                    # the seed is the anchor's place in its context
                    digest = [xxhash.xxh3_128_digest(raw[a:b], p - a) for p, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)]
                    row = np.searchsorted(offsets[i : j + 1], at + lo2, "right") - 1
                    base = offsets[i:j][row] - lo2 if len(at) else at
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(digest, pa.binary()), pa.array(uid[i:j][row].astype(np.int64)), pa.array((at - base).astype(np.int64)), pa.array((first - base).astype(np.int64)), pa.array((last - base).astype(np.int64))],
                        names=["h", "digest", "_uid", "at", "first", "last"],
                    )

    return scan


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian integer; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def _take(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words[np.minimum(at, len(words) - 1)] * (at < len(words)).astype(np.uint64)


def _sort_directly(words: np.ndarray, at: np.ndarray, sums: np.ndarray, depth: int) -> np.ndarray:
    """`at` ordered by the first `depth` bytes from each place on; places that agree so far keep together.

    Each round finds how far the members of a tied group agree (by prefix sums, halving the step) and sorts them by the
    eight bytes that follow, so a group takes as many rounds as it branches, not as it is deep.
    """
    at = at[np.argsort(words[at], kind="stable")]
    if not len(at):
        return at
    n = len(words)
    _, down = powers(n + 1)
    key = words[at]
    head_of = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(at)), 0))
    known = np.full(len(at), 8)
    active = np.arange(len(at))
    steps = [1 << e for e in range(3, max(4, depth.bit_length())) if 1 << e <= max(depth, 8)][::-1]
    while True:
        g = head_of[active]
        same = g[1:] == g[:-1]
        tied = np.zeros(len(g), bool)
        tied[1:] |= same
        tied[:-1] |= same
        active, g = active[tied], g[tied]
        if not len(active):
            return at
        heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(g))))
        p, agree = at[active], known[active]
        for step in steps:
            x = np.minimum(p + agree, n)
            y = np.minimum(x + step, n)
            # of a group all have gone equally far, so one answer per group is enough
            value = (sums[y] - sums[x]) * down[x]
            lowest, highest = np.minimum.reduceat(value, heads), np.maximum.reduceat(value, heads)
            agree = agree + step * ((lowest == highest)[of] & (agree < depth))
        going = agree < depth
        active, g, p, agree = active[going], g[going], p[going], agree[going]
        if not len(active):
            return at
        key = _take(words, p + agree)
        order = np.lexsort((key, g))
        p, key, agree = p[order], key[order], agree[order]
        at[active] = p
        known[active] = np.minimum(agree + 8, depth)
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        head_of[active] = active[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))]


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of data in the order of their first `depth` bytes (at least), by two-stage sorting.

    Suffixes smaller than their successor are sorted directly; every other one is the predecessor of a suffix that
    stands before it, and the scan of the buckets of first bytes, from the smallest on, files it.
    wanted: a mask of the suffixes asked for; others are sorted only where these are induced from them.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    words = _words_at(data)
    sums = np.zeros(n + 1, np.uint64)
    up, _ = powers(n + 1)
    np.cumsum(byte_table(2)[data] * up[:n], out=sums[1:])
    follow = np.concatenate([data[1:].astype(np.int16), [-1]])
    step = np.sign(follow - data.astype(np.int16))
    places = np.arange(n)
    change = np.minimum.accumulate(np.where(step != 0, places, n)[::-1])[::-1]  # where the run of equal bytes ends
    smaller = step[np.minimum(change, n - 1)] > 0
    needed = np.ones(n, bool)
    if wanted is not None:
        source = np.minimum.accumulate(np.where(smaller, places, n)[::-1])[::-1]  # what a suffix is induced from
        before = np.maximum.accumulate(np.where(wanted, places, -1))
        needed = (before >= 0) & (source[np.maximum(before, 0)] == source)
    direct = _sort_directly(words, np.flatnonzero(smaller & needed), sums, depth)
    cuts = np.searchsorted(data[direct], np.arange(257))
    larger = ~smaller & needed
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[data[n - 1]].append(np.array([n - 1]))  # the last suffix is followed by nothing, the smallest of all
    out = []

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """Files the larger predecessors of `found` under their first bytes; returns those of this same bucket."""
        before = found[found > 0] - 1
        before = before[larger[before]]
        if not len(before):
            return before
        first = data[before]
        order = np.argsort(first, kind="stable")
        first, ordered = first[order], before[order]
        marks = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        same = np.zeros(0, np.int64)
        for a, b in zip(marks, [*marks[1:], len(first)], strict=True):
            if first[a] == byte:
                same = ordered[a:b]
            else:
                pending[first[a]].append(ordered[a:b])
        return same

    for byte in range(256):
        if pending[byte]:
            found = np.concatenate(pending[byte])
            pending[byte] = []
            while len(found):
                out.append(found)
                found = induce(found, byte)
        found = direct[cuts[byte] : cuts[byte + 1]]
        if len(found):
            out.append(found)
            induce(found, byte)
    order = np.concatenate(out)
    return order if wanted is None else order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each neighbouring pair of the suffix array the length of its common prefix, capped at `most`."""
    words = _words_at(data)
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for step in range(0, most, 8):
        x, y = _take(words, a[alive] + step), _take(words, b[alive] + step)
        differ = x ^ y
        equal = differ == 0
        stop = alive[~equal]
        d = differ[~equal]
        zeros = np.zeros(len(d), np.int64)
        for byte in range(7, 0, -1):
            zeros += (d >> np.uint64(8 * byte)) == 0
        out[stop] = step + zeros
        alive = alive[equal]
        if not len(alive):
            break
    out[alive] = most
    room = len(data) - np.maximum(a, b)
    return np.minimum(np.minimum(out, room), most)


def repeated_starts(texts: list[bytes], owner: np.ndarray, origin: np.ndarray, window: int) -> list[np.ndarray]:
    """For each text the places where a window starts that also starts at another place.

    owner and origin say of which document a text is part and where it begins there: one place may be seen in two texts.
    """
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer(bytes([SEPARATOR]).join(texts) + bytes([SEPARATOR]), np.uint8)
    text_at = np.repeat(np.arange(len(texts)), sizes + 1)
    local_at = np.arange(len(data)) - starts[text_at]
    order = suffix_array(data, window, local_at + window <= sizes[text_at])
    if not len(order):
        return [np.zeros(0, np.int64) for _ in texts]
    text_of, local = text_at[order], local_at[order]
    same = common_prefixes(data, order, window) >= window
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(heads, len(order)))
    place = origin[text_of] + local
    who = owner[text_of]
    several = (np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)) | (np.minimum.reduceat(who, heads) != np.maximum.reduceat(who, heads))
    hit = np.repeat(several, size)
    found = np.sort(order[hit])
    cut = np.searchsorted(found, starts)
    return [found[cut[i] : cut[i + 1]] - starts[i] for i in range(len(texts))]


def _runs(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Start places to covered runs (begin, end)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    return [(int(starts[a]), int(starts[b]) + window) for a, b in zip(np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(starts) - 1]]), strict=True)]


def _array_groups(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None

        def flush() -> pa.RecordBatch:
            found = repeated_starts([r[5] for r in rows], np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), window)
            out = [(r[1], r[2], a, b) for r, s in zip(rows, found, strict=True) for a, b in _runs(s, window)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary() if i == 1 else pa.int64()) for i in range(4)], names=["h", "digest", "a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "h", "digest", "_uid", "first", "context")]
            for row in zip(*cols, strict=True):
                if row[0] != last and held >= BLOCK:
                    yield flush()
                    held = 0
                last = row[0]
                rows.append(row)
                held += len(row[5])
        if rows:
            yield flush()

    return work


def _contexts(coded: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in _coded(batches) if coded else batches:
            out: list[tuple] = []
            held = 0
            for at, (uid, text, wanted) in enumerate(zip(batch.column("_uid"), batch.column("_text"), batch.column("wanted"), strict=True)):
                raw, uid = text.as_py() or b"", uid.as_py()
                for w in wanted.as_py():
                    out.append((w["h"], bytes(w["digest"]), uid, w["first"], w["at"] - w["first"], raw[w["first"] : w["last"]]))
                    held += w["last"] - w["first"]
                if held >= BLOCK or at == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["h", "digest", "_uid", "first", "lo", "context"])
                    out, held = [], 0

    return work


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, in pieces, with the words of each `_text` as CODE bytes each."""
    for batch in batches:
        offsets, data = utf8_column(batch, "_text")
        for i, j in pieces(offsets, BLOCK):
            text, _, _, word = word_places(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
            edges = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=j - i) * CODE)]).astype(np.int32)
            codes = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(word.tobytes())])
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([codes if c == "_text" else part.column(c) for c in part.schema.names], names=part.schema.names)


def _merged(runs: Column) -> Column:
    """Ascending runs (a, b) with those joined that overlap or touch."""

    def step(done: Column, run: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], run["b"]).alias("b"))
        return F.when(last["b"] >= run["a"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, F.slice(runs, 1, 1), step)


def repeated_spans(docs: DataFrame, window: int = 400, gram: int = GRAM, group_limit: int = GROUP_LIMIT, across: bool = False, coded: bool = False) -> DataFrame:
    """(_uid, spans): byte runs (a, b) of docs (_uid, _text binary) covered by repeated windows, possibly overlapping; written.

    across: only windows that stand in another text too count as repeated. coded: texts are judged, and runs given, as coded words.
    """
    gram = min(gram, window)
    found = materialise(docs.select("_uid", "_text").mapInArrow(releasing(_scan(window, gram, coded)), "h long, digest binary, _uid long, at long, first long, last long"), "anchors")
    written = [found]
    several = F.min("_uid") != F.max("_uid") if across else F.count(F.lit(1)) > 1
    # written, so that a hot hash is dealt out by the join that follows
    twice = materialise(found.groupBy("h").agg(several.alias("several")).filter("several").select("h"), "twice")
    found = materialise(found.join(twice, "h", "left_semi"), "repeated")
    written += [twice, found]
    # one row per different context, whether it occurs elsewhere too, and one place of it
    kinds = found.groupBy("h", "digest").agg(several.alias("several"), F.min(F.struct("_uid", "at", "first", "last")).alias("one"))
    kinds = materialise(kinds, "contexts")
    groups = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    mixed = kinds.join(groups.select("h"), "h", "left_semi")
    wanted = mixed.select(F.col("one._uid").alias("_uid"), F.struct("h", "digest", "one.at", "one.first", "one.last").alias("w")).groupBy("_uid").agg(F.collect_list("w").alias("wanted"))
    texts = docs.select("_uid", "_text").join(growing(wanted), "_uid").mapInArrow(releasing(_contexts(coded)), "h long, digest binary, _uid long, first long, lo long, context binary")
    core = materialise(texts, "texts")
    keys = core.withColumn("key", F.col("h")).withColumn("hi", F.col("lo") + gram)
    parts = []
    written += [kinds, core]
    while True:
        keys = keys.withColumn("rest", window - (F.col("hi") - F.col("lo")))
        many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > group_limit)
        many = materialise(many.select("key"), "hot")
        written.append(many)
        hot = many.limit(1).count() > 0
        cold = keys.join(many, "key", "left_anti") if hot else keys
        # bytes decide: texts with one key lie together and are compared
        ordered = cold.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
        part = materialise(ordered.select("key", "h", "digest", "_uid", "first", "context").mapInArrow(releasing(_array_groups(window)), "h long, digest binary, a long, b long"), "runs")
        parts.append(part)
        if not hot:
            break
        keys = keys.join(many, "key", "left_semi")
        half = F.floor(F.col("rest") / 2).cast("long")
        left = keys.withColumn("lo", F.col("lo") - (F.col("rest") - half))
        right = keys.withColumn("hi", F.col("hi") + half + 1)
        grown = left.unionByName(right).filter("lo >= 0 and hi <= octet_length(context)")
        grown = grown.withColumn("key", F.xxhash64("key", F.expr("substring(context, cast(lo + 1 as int), cast(hi - lo as int))")))
        grown = materialise(grown.drop("rest"), "grown")
        written.append(grown)
        full = grown.filter(F.col("hi") - F.col("lo") == window)
        # the core is the window itself: equal bytes at two different places settle it
        full = full.withColumn("bytes", F.expr("substring(context, cast(lo + 1 as int), cast(hi - lo as int))"))
        where = F.col("_uid") if across else F.struct("_uid", (F.col("first") + F.col("lo")).alias("p"))
        same = full.groupBy("key", "bytes").agg(F.min(where).alias("x"), F.max(where).alias("y")).filter("x != y").select("key", "bytes")
        part = materialise(full.join(same, ["key", "bytes"], "left_semi").select("h", "digest", F.col("lo").alias("a"), F.col("hi").alias("b")), "windows")
        parts.append(part)
        keys = grown.filter(F.col("hi") - F.col("lo") < window)
    runs = parts[0]
    for p in parts[1:]:
        runs = runs.unionByName(p)
    # runs are relative to the context's first byte, and every place with that context has them; a context that occurs
    # elsewhere too is a run as a whole. One row a context and one join, so that Spark can deal out a context with very
    # many places.
    whole = kinds.filter("several").select("h", "digest", F.lit(0).cast("long").alias("a"), (F.col("one.last") - F.col("one.first")).alias("b"))
    answers = runs.unionByName(whole).groupBy("h", "digest").agg(_merged(F.sort_array(F.collect_set(F.struct("a", "b")))).alias("runs"))
    answers = materialise(answers, "answers")
    written.append(answers)
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b")))
    spans = found.join(answers, ["h", "digest"]).select("_uid", moved.alias("runs")).groupBy("_uid").agg(F.flatten(F.collect_list("runs")).alias("spans"))
    spans = materialise(spans, "spans")
    for df in [*written, *parts]:
        discard(df)
    return spans


def _cut(keep: str | None, min_words: int | None):
    def words_of(raw: bytes, spans: list[list[int]]) -> list[list[int]]:
        """Spans of coded words as spans of bytes: whole words only, at least min_words of them."""
        if not spans:
            return spans
        _, begin, _, _ = word_places(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
        begin = [*begin.tolist(), len(raw)]
        whole = [(-(-a // CODE), b // CODE) for a, b in spans]
        return [[begin[a], begin[b]] for a, b in whole if b - a >= min_words]

    text_type = pa.string() if keep == "text" else pa.binary()
    types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.string(), text_type)

    def cut(raw: bytes, spans: list[dict]) -> tuple:
        merged: list[list[int]] = []
        for s in sorted(spans, key=lambda s: (s["a"], s["b"])):
            if merged and s["a"] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s["b"])
            else:
                merged.append([s["a"], s["b"]])
        if min_words:
            merged = words_of(raw, merged)
        kept, at = [], 0
        for a, b in merged:
            kept.append(raw[at:a])
            at = b
        rest = b"".join([*kept, raw[at:]])
        left = rest if keep == "bytes" else rest.decode("utf-8", "ignore") if keep == "text" else None
        return len(raw), len(raw) - len(rest), [{"a": a, "b": b} for a, b in merged], hashlib.sha256(rest).hexdigest(), left

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, _ = utf8_column(batch, "_text")
            passed = [f for f in batch.schema.names if f not in ("_text", "spans")]
            for i, j in pieces(offsets, 4 * BLOCK):
                part = batch.slice(i, j - i)
                out = [cut((text.as_py() or "").encode(), spans.as_py() or []) for text, spans in zip(part.column("_text"), part.column("spans"), strict=True)]
                made = [pa.array([x[k] for x in out], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(part.column(f) for f in passed), *made], names=[*passed, "n_bytes", "n_removed", "removed", "kept_sha256", "kept"])

    return work


def suffix_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_bytes: int = 400, min_words: int | None = None, across: bool = False, keep: str | None = "bytes", carry: list[str] | None = None, group_limit: int = GROUP_LIMIT, gram: int = GRAM) -> DataFrame:
    """Per row of df: key, n_bytes, n_removed, removed (spans a, b), kept_sha256, kept.

    min_words: strings are judged by so many words instead of min_bytes. across: strings repeated inside one document only stay.
    keep: kept as "bytes", as "text" (what remains of characters cut apart is left out), or None for no such column.
    carry: further columns to return under their own names, after those.
    """
    names = list(dict.fromkeys([key, *(carry or [])]))
    col = lambda c: F.col(f"`{c}`")
    picked = df.select(col(text).alias("_text"), *[col(c).alias(f"_c{i}") for i, c in enumerate(names)])
    docs = with_uid(picked, "_c0", ["_text", *[f"_c{i}" for i in range(len(names))]])
    judged = docs.select("_uid", F.col("_text").cast("binary").alias("_text"))
    spans = repeated_spans(judged, CODE * min_words if min_words else min_bytes, gram, group_limit, across, bool(min_words))
    joined = docs.join(growing(spans), "_uid", "left").select(*[f"_c{i}" for i in range(len(names))], "_text", "spans")
    schema = fields(docs, [f"_c{i}" for i in range(len(names))], "n_bytes long, n_removed long, removed array<struct<a: long, b: long>>, kept_sha256 string, kept " + ("string" if keep == "text" else "binary"))
    out = joined.mapInArrow(releasing(_cut(keep, min_words)), schema)
    made = ["n_bytes", "n_removed", "removed", "kept_sha256", *(["kept"] if keep else [])]
    return out.select(F.col("_c0").alias(key), *made, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(names) if i])
