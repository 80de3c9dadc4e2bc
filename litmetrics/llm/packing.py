"""Packing token sequences by non-negative least squares.

Documents become token ids plus an end id and are cut into full windows and a rest. Full windows are sequences of their
own. The rests of a shard (about `shard` documents, by hash) are packed together: all combinations of one to `depth`
lengths that fill the window exactly are enumerated, a non-negative least squares fit finds how often to use each so
that the histogram of rests is met, the counts are rounded within what the histogram holds, and whatever is left is
packed greedily, longest first, into the fullest sequence with room. The rests of sequences that still would need padding
(a sequence whose length is a power of two needs none) are cut into pieces of powers of two, the longest first: in
descending order these fill windows exactly, so a shard has one padded sequence at most. Token ids are never shuffled:
only lengths and checksums (of windows, rests and their pieces) leave the task that tokenises.

Tokeniser: byte-level BPE given as rank file and split pattern. Words are looked up in a table of at most `WORDS`
recent ones per worker; texts with characters for which Python's classes could differ from the pattern's, or with the
special token's text, go through the full encoder. Both give the ids of the vocabulary's JSON form.

Defined results: null text is empty and gives the end id alone; rows with repeated or null keys are documents of their
own; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, releasing, with_uid

WINDOW, SHARD, WORDS = 1024, 32768, 400_000
SPECIAL = "<|endoftext|>"
# characters up to U+024F, less those whose class differs between Python's expressions and the pattern's
_PLAIN = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba-\xbb\xbf-ɏ]")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Encoder:
    """Token ids of texts as little-endian 32-bit words."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.full = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
        encode = self.full.encode_ordinary

        class Table(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) > WORDS:
                    self.clear()
                out = self[word] = np.array(encode(word), "<u4").tobytes()
                return out

        self.table = Table()

    def __call__(self, text: str) -> bytes:
        if _PLAIN.search(text) or SPECIAL in text:
            return np.array(self.full.encode(text, allowed_special="all"), "<u4").tobytes()
        return b"".join(map(self.table.__getitem__, _SPLIT.findall(text)))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    found = _ENCODERS.get((ranks_path, pattern))
    if found is None:
        found = _ENCODERS[ranks_path, pattern] = Encoder(ranks_path, pattern)
    return found


def strategies(lengths: np.ndarray, window: int, depth: int) -> list[np.ndarray]:
    """For each depth the combinations (rows) of that many of the given lengths, ascending, that fill the window."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = []
    if have[window]:
        out.append(np.array([[window]]))
    if depth >= 2:
        a = lengths[2 * lengths <= window]
        a = a[have[window - a]]
        out.append(np.stack([a, window - a], axis=1))
    if depth >= 3:
        a, b = np.meshgrid(lengths, lengths, indexing="ij")
        a, b = a.ravel(), b.ravel()
        c = window - a - b
        fine = (a <= b) & (b <= c)
        a, b, c = a[fine], b[fine], c[fine]
        fine = have[c]
        out.append(np.stack([a[fine], b[fine], c[fine]], axis=1))
    return [x for x in out if len(x)]


def solve_counts(plans: list[np.ndarray], histogram: np.ndarray, rounds: int = 200) -> list[np.ndarray]:
    """Non-negative counts of the plans whose use of lengths comes nearest to the histogram (accelerated projected gradient)."""
    size = len(histogram)
    x = [np.zeros(len(p)) for p in plans]
    # plans times their transpose have a norm of at most the largest column sum of the product
    use = sum(np.bincount(p.ravel(), minlength=size) * p.shape[1] for p in plans)
    step = 1.0 / max(1.0, float(use.max()))
    y, t = [v.copy() for v in x], 1.0
    for _ in range(rounds):
        filled = sum(np.bincount(p.ravel(), weights=np.repeat(v, p.shape[1]), minlength=size) for p, v in zip(plans, y, strict=True))
        off = filled - histogram
        new = [np.maximum(0.0, v - step * off[p].sum(axis=1)) for p, v in zip(plans, y, strict=True)]
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = [n + (t - 1) / t2 * (n - o) for n, o in zip(new, x, strict=True)]
        x, t = new, t2
    return x


def pack(histogram: np.ndarray, window: int, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use every length as often as the histogram says."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    plans = strategies(np.flatnonzero(left), window, depth)
    if plans:
        counts = solve_counts(plans, left.astype(np.float64))
        flat = [(-c, tuple(int(v) for v in p)) for plan, count in zip(plans, counts, strict=True) for p, c in zip(plan[count >= 0.5], count[count >= 0.5], strict=True)]
        for c, p in sorted(flat):
            n = min(round(-c), *(int(left[v]) // p.count(v) for v in p))
            if n > 0:
                out.append((p, n))
                for v in p:
                    left[v] -= n
    # what is left: longest first, into the fullest open sequence with room
    open_by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    rooms = np.zeros(window + 1, np.int64)
    for length in range(window, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                # as many new sequences as this length alone can fill
                per = window // length
                fresh, rest = divmod(n, per)
                if fresh:
                    open_by_room[window - per * length][(length,) * per] += fresh
                    rooms[window - per * length] += fresh
                if rest:
                    open_by_room[window - rest * length][(length,) * rest] += 1
                    rooms[window - rest * length] += 1
                break
            room = int(fits[0]) + length
            combo, many = next(iter(open_by_room[room].items()))
            k = min(many, n)
            open_by_room[room][combo] -= k
            if not open_by_room[room][combo]:
                del open_by_room[room][combo]
            open_by_room[room - length][(*combo, length)] += k
            rooms[room] -= k
            rooms[room - length] += k
            n -= k
    out += [(combo, n) for by in open_by_room.values() for combo, n in by.items() if n]
    return out


def halves(length: int) -> list[int]:
    """The powers of two that add up to a length, in descending order."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _tokenising(ranks_path: str, pattern: str, window: int, end_id: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern)
        tail = int(end_id).to_bytes(4, "little")
        try:
            for batch in batches:
                total, sums, bits = [], [], []
                for text in batch.column("_text"):
                    raw = encode(text.as_py() or "") + tail
                    total.append(len(raw) // 4)
                    sums.append([zlib.crc32(raw[i : i + 4 * window]) for i in range(0, len(raw), 4 * window)])
                    at, own = len(raw) - len(raw) % (4 * window), []
                    for n in halves(total[-1] % window):
                        own.append(zlib.crc32(raw[at : at + 4 * n]))
                        at += 4 * n
                    bits.append(own)
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (sums, bits)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_uid", "_key")), pa.array(total, pa.int64()), *lists], names=["_uid", "_key", "doc_tokens", "sums", "bits"])
        finally:
            encode.table.clear()  # the worker outlives the task

    return work


def _packing(window: int, depth: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_uid").reset_index(drop=True)
        total = pdf["doc_tokens"].to_numpy()
        count = -(-total // window)
        row = np.repeat(np.arange(len(pdf)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = nth * window
        length = np.minimum(window, total[row] - start)
        sequence, offset = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        rest = np.flatnonzero(length < window)
        rest = rest[np.argsort(length[rest], kind="stable")]
        made, over = 0, []
        edges = np.searchsorted(length[rest], np.arange(window + 1))
        taken = edges[:-1].copy()
        for combo, n in pack(np.bincount(length[rest], minlength=window + 1), window, depth):
            size = sum(combo)
            padded = size < window and size & (size - 1)
            begin = 0
            for v in combo:
                at = rest[taken[v] : taken[v] + n]
                taken[v] += n
                if padded:
                    over.append(at)
                    continue
                sequence[at] = made + np.arange(n)
                offset[at] = begin
                begin += v
            made += 0 if padded else n
        whole = np.flatnonzero(length == window)
        sequence[whole] = made + np.arange(len(whole))
        made += len(whole)
        sums = np.array([s[i] for s, i in zip(pdf["sums"].to_numpy()[row], nth, strict=True)], np.int64)
        out = np.concatenate(over) if over else np.zeros(0, np.int64)
        kept = np.ones(len(row), bool)
        kept[out] = False
        # pieces of powers of two in descending order meet every multiple of the window
        cut = [(-n, int(i), k, int(start[i]) + sum(parts[:k])) for i in np.sort(out) for parts in (halves(int(length[i])),) for k, n in enumerate(parts)]
        cut.sort()
        size = -np.array([c[0] for c in cut], np.int64)
        place = np.cumsum(size) - size
        more = np.array([c[1] for c in cut], np.int64)
        bits = pdf["bits"].to_numpy()
        row_of, shard = np.concatenate([row[kept], row[more]]), int(pdf["_shard"].iloc[0]) if len(pdf) else 0
        return pd.DataFrame({
            "_key": pdf["_key"].to_numpy()[row_of], "start": np.concatenate([start[kept], np.array([c[3] for c in cut], np.int64)]), "length": np.concatenate([length[kept], size]),
            "ids_crc32": np.concatenate([sums[kept], np.array([bits[row[c[1]]][c[2]] for c in cut], np.int64)]), "doc_tokens": total[row_of],
            "sequence_id": (np.int64(shard) << np.int64(32)) + np.concatenate([sequence[kept], made + place // window]),
            "offset": np.concatenate([offset[kept], place % window]),
        })

    return work


def pack_documents(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 0, depth: int = 3, shard: int = SHARD) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id and offset. Sequence ids are unique, not dense."""
    picked = df.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{text}`").alias("_text"))
    docs = with_uid(picked, "_key", ["_key", "_text"])
    tokens = materialise(docs.mapInArrow(releasing(_tokenising(ranks_path, pattern, window, end_id)), "_uid long, _key long, doc_tokens long, sums array<long>, bits array<long>"), "tokens")
    shards = max(1, -(-tokens.count() // shard))
    sharded = tokens.withColumn("_key", F.col("_key").cast("string")).withColumn("_shard", F.pmod(F.xxhash64("_uid"), F.lit(shards)))
    out = sharded.groupBy("_shard").applyInPandas(_packing(window, depth), "_key string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.select(F.col("_key").cast("long").alias(key), *out.columns[1:])
