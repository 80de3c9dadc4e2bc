"""Cross-tokenizer alignment: which tokens of one vocabulary stand where those of another do.

A text with a space before it is encoded by a byte-level BPE (A) and by a BPE with byte fallback (B). Both cut the same
bytes; a merge of the two sequences of cumulative token ends (a pointer into each side moves past every end it meets,
for all chunks of a block at once) emits a link for every pair of tokens whose bytes overlap, and closes a group wherever
both end.

Both vocabularies cut before white space that follows something else, so a text falls into chunks (a run of white space
and what follows it) that can be encoded, merged and remembered one by one; which characters may begin a chunk is read
from the vocabularies, and where none may the whole text is one chunk. Chunks of up to 64 characters are remembered. A
worker holds about `WORDS` chunks or `HELD` bytes of them at most, and those of one block.

Texts are dealt with in blocks of about `BLOCK` bytes. A block is one written row: for every text its numbers and, coded by
the block's own list of different pairs, which it links how often. Only those lists are exploded: one row per block and
pair, with the number of its texts that link it. Spark adds these up by pair, takes the maxima of both sides, and joins counts and
maxima back to the lists and so to the blocks. A pair is in a block's list once however frequent it is, so the most
frequent pair has as many rows as there are blocks.

Defined results: null and empty texts, and texts whose joined token bytes of either side are not the text's (a literal
U+2581, say), have no tokens: zeros and an empty digest. The strings of special tokens are plain text. Rows with repeated
or null ids are texts of their own; further columns do not matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, growing, materialise, releasing

BLOCK, WORDS, HELD, LONGEST = 1 << 22, 400_000, 1 << 25, 64
TOGETHER = 2  # blocks of a row group: who reads one holds all its rows
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    def __init__(self, ranks_path: str, pattern: str, model_path: str):
        import base64

        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.a_bytes = {v: k for k, v in ranks.items()}
        self.encode_a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.model.piece_to_id("▁")
        used = set().union(*pieces)
        breaks = "".join(c for c in "\t\n\v\f" if c not in used)
        # a space begins a chunk unless some piece goes on over one
        if not any(re.search("[^▁]▁", p) for p in pieces):
            breaks += " "
        self.chunks = re.compile(rf"\s*\S+(?:(?![{re.escape(breaks)}])\s+\S*)*|\s+").findall if " " in breaks else lambda text: [text]
        self.lengths = [np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)]), np.array([len(x) for x in self.b_bytes])]
        self.forget(-1)

    def forget(self, most: int = WORDS) -> None:
        """Lets go of all chunks if there are more than that many, or too many bytes of them."""
        if most < 0 or len(self.fine) > most or self.held > HELD:
            self.held = 0  # bytes of chunks and groups
            self.known: dict[str, int] = {}
            self.fresh: list[str] = []  # met, but not yet aligned
            self.fine = np.zeros(0, bool)  # of each chunk: do both sides' bytes agree with it?
            self.counts = np.zeros((0, 4), np.int64)  # its n_a, n_b, n_groups and n_links
            self.groups: list[bytes] = []
            self.edges = np.zeros(1, np.int64)  # where its links begin and end
            self.links = np.zeros(0, np.int64)

    def numbers_of(self, text: str) -> np.ndarray:
        """The numbers of the chunks of a text with its space; new ones are noted for learn()."""
        known, fresh, out, base = self.known, self.fresh, [], len(self.fine)
        for chunk in self.chunks(" " + text):
            at = known.get(chunk)
            if at is None:
                at = base + len(fresh)
                fresh.append(chunk)
                if len(chunk) <= LONGEST:
                    known[chunk] = at
            out.append(at)
        return np.array(out, np.int64)

    def encoded(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of chunks as they stand inside a text: without the space that B's model puts before a text."""
        b = self.model.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for at, c in enumerate(chunks):
            if c == " ":
                b[at] = [self.blank]
            elif c[0] != " ":
                b[at] = b[at][1:]
        return [self.encode_a(c) for c in chunks], b

    def learn(self) -> None:
        """Aligns the chunks noted since the last time, all in one merge over their bytes laid end to end."""
        chunks, self.fresh = self.fresh, []
        if not chunks:
            return
        raw = [c.encode() for c in chunks]
        sides, tables = self.encoded(chunks), (self.a_bytes, self.b_bytes)
        fine = np.ones(len(chunks), bool)
        for ids, table in zip(sides, tables, strict=True):
            if b"".join([table[i] for x in ids for i in x]) != b"".join(raw):
                fine &= [b"".join([table[i] for i in x]) == r for x, r in zip(ids, raw, strict=True)]
        kept = np.flatnonzero(fine)
        chunk_ends = np.cumsum([len(raw[i]) for i in kept])
        ids = [np.fromiter(chain.from_iterable(side[i] for i in kept), np.int64) for side in sides]
        ends = [np.cumsum(lengths[x]) for lengths, x in zip(self.lengths, ids, strict=True)]
        merged = np.union1d(*ends)
        # at each end met, where the pointers into both sides stand: those two tokens overlap
        links = ids[0][np.searchsorted(ends[0], merged)] << 32 | ids[1][np.searchsorted(ends[1], merged)]
        closes = [np.isin(x, y, assume_unique=True) for x, y in (ends, ends[::-1])]
        counts = np.zeros((len(chunks), 4), np.int64)
        for k, places in enumerate((*ends, ends[0][closes[0]], merged)):
            counts[kept, k] = np.bincount(np.searchsorted(chunk_ends, places), minlength=len(kept))
        self.fine, self.counts = np.concatenate([self.fine, fine]), np.concatenate([self.counts, counts])
        self.links, self.edges = np.concatenate([self.links, links]), np.concatenate([self.edges, self.edges[-1] + np.cumsum(counts[:, 3])])
        texts = _groups(ids, ends, closes, chunk_ends)
        groups = [b""] * len(chunks)
        for at, g in zip(kept.tolist(), texts, strict=True):
            groups[at] = g
        self.groups += groups
        self.held += sum(map(len, raw)) + sum(map(len, groups))


def _groups(ids: list[np.ndarray], ends: list[np.ndarray], closes: list[np.ndarray], chunk_ends: np.ndarray) -> list[bytes]:
    """The groups of each chunk as text, `a1,a2|b1;a3|b2,b3`."""
    if not len(chunk_ends):
        return []
    group = [np.cumsum(c) - c for c in closes]
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    mark = [np.where(closes[0], 1, 0), np.where(np.isin(ends[1], chunk_ends), 3, np.where(closes[1], 2, 0))]
    marks = pa.array([",", "|", ";", ""]).take(pa.array(np.concatenate(mark)[order]))
    words = pc.binary_join_element_wise(pc.cast(pa.array(np.concatenate(ids)[order]), pa.string()), marks, "")
    offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
    text = words.buffers()[2].to_pybytes()
    last = np.cumsum(np.bincount(np.searchsorted(chunk_ends, np.concatenate(ends)), minlength=len(chunk_ends)))
    cuts = [0, *offsets[last].tolist()]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_ALIGNERS: dict[tuple[str, str, str], Aligner] = {}

_BLOCK = {
    "block": "long", "n_a": "array<long>", "n_b": "array<long>", "n_groups": "array<long>", "n_links": "array<long>", "groups_sha256": "array<string>",
    "size": "array<int>", "pair": "array<int>", "times": "array<int>", "pairs": "array<long>", "docs": "array<int>",
}


def _listed(values: pa.Array) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(aligner: Aligner, number: int, rows: list[pa.Array], texts: list[np.ndarray]) -> pa.RecordBatch:
    """The written row of a block: chunk numbers of each text, none for a text without tokens."""
    aligner.learn()
    groups, edges = aligner.groups, aligner.edges
    fine = [at if aligner.fine[at].all() else at[:0] for at in texts]
    counts = np.array([aligner.counts[at].sum(axis=0) for at in fine]).reshape(len(texts), 4)
    digests = [hashlib.sha256(b";".join([groups[i] for i in at.tolist()])).hexdigest() if len(at) else "" for at in fine]
    # (text, chunk) with its count, then (text, pair) with its count
    width = len(groups) + 1
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in fine])
    key, times = np.unique(owner * width + np.concatenate([*fine, np.zeros(0, np.int64)]), return_counts=True)
    chunk = key % width
    n = edges[chunk + 1] - edges[chunk]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(edges[chunk], n)
    code, pairs = pd.factorize(aligner.links[place])
    linked, at = np.unique(np.repeat(key // width, n) * (len(pairs) + 1) + code, return_inverse=True)
    often = np.bincount(at, weights=np.repeat(times, n), minlength=len(linked)).astype(np.int32)
    text, pair = linked // (len(pairs) + 1), (linked % (len(pairs) + 1)).astype(np.int32)
    made_columns = [
        pa.array([number], pa.int64()), *[_listed(pa.array(counts[:, k])) for k in range(4)], _listed(pa.array(digests, pa.string())),
        _listed(pa.array(np.bincount(text, minlength=len(texts)).astype(np.int32))), _listed(pa.array(pair)), _listed(pa.array(often)),
        _listed(pa.array(pairs)), _listed(pa.array(np.bincount(pair, minlength=len(pairs)).astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays([_listed(pa.concat_arrays(rows)), *made_columns], names=["rows", *_BLOCK])


def _aligning(block: int, *paths: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _ALIGNERS.get(paths) or _ALIGNERS.setdefault(paths, Aligner(*paths))
        number = TaskContext.get().partitionId() << 32
        rows, texts, held = [], [], 0
        try:
            for batch in batches:
                at = 0
                for nth, text in enumerate(batch.column("_text")):
                    raw = text.as_py() or ""
                    texts.append(aligner.numbers_of(raw) if raw else np.zeros(0, np.int64))
                    held += len(raw) + 64
                    if held >= block:
                        yield _block(aligner, number, [*rows, batch.column("_row").slice(at, nth + 1 - at)], texts)
                        aligner.forget()
                        number, rows, texts, held, at = number + 1, [], [], 0, nth + 1
                if at < batch.num_rows:
                    rows.append(batch.column("_row").slice(at))
            if texts:
                yield _block(aligner, number, rows, texts)
        finally:
            aligner.forget(-1)  # the worker outlives the task

    return work


def _scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for nth in range(batch.num_rows):
            of = lambda name: batch.column(name)[nth].values  # noqa: B023, E731
            arrays = {c: of(c).to_numpy(zero_copy_only=False) for c in ("size", "pair", "times")}
            n = len(arrays["size"])
            owner = np.repeat(np.arange(n), arrays["size"])
            sums = [np.zeros(n, np.int64)] * 3
            if len(owner):
                facts = of("facts")
                order = np.argsort(facts.field("at").to_numpy())
                facts = [facts.field(c).to_numpy(zero_copy_only=False)[order][arrays["pair"]].astype(np.int64) for c in ("best_a", "best_b", "count")]
                edge = np.concatenate([[0], np.cumsum(arrays["size"])])
                for k, fact in enumerate(facts):
                    total = np.concatenate([[0], np.cumsum(fact * arrays["times"])])
                    sums[k] = total[edge[1:]] - total[edge[:-1]]
            kept = [of(c) for c in ("rows", *NUMBERS)]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(s) for s in sums], of("groups_sha256")], names=["_row", *NUMBERS, "n_best", "n_best_b", "count_sum", "groups_sha256"])


def align_tokens(df: DataFrame, ranks_path: str, pattern: str, model_path: str, text: str = "text", carry: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """df's rows as _row (a struct of the columns `carry`, all by default) with n_a, n_b, n_groups, n_links, n_best (links
    whose pair is in as many texts as any pair of their A id), n_best_b (of their B id), count_sum and groups_sha256."""
    aligned, counts = _linked(df, ranks_path, pattern, model_path, text, carry, block)
    lists = aligned.select("block", F.posexplode("pairs").alias("at", "pair"))
    facts = lists.join(growing(counts), "pair").groupBy("block").agg(F.collect_list(F.struct("at", "best_a", "best_b", "count")).alias("facts"))
    schema = T.StructType([T.StructField("_row", aligned.schema["rows"].dataType.elementType), *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_b long, count_sum long, groups_sha256 string")])
    whole = aligned.drop("pairs", "docs").join(growing(facts), "block", "left")
    return whole.mapInArrow(releasing(_scoring), schema)


def pair_counts(df: DataFrame, ranks_path: str, pattern: str, model_path: str, text: str = "text") -> DataFrame:
    """The table of translation between the vocabularies: a, b, count (texts that link them), best_a and best_b (no other
    pair of that A or B id is in more texts)."""
    aligned, counts = _linked(df, ranks_path, pattern, model_path, text, [], BLOCK)
    discard(aligned)
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "count", "best_a", "best_b")


def _linked(df: DataFrame, ranks_path: str, pattern: str, model_path: str, text: str, carry: list[str] | None, block: int) -> tuple[DataFrame, DataFrame]:
    """The blocks and the table of pairs, both written."""
    col = lambda c: F.col(f"`{c}`")
    names = df.columns if carry is None else carry
    row = F.struct(*[col(c) for c in names]) if names else F.struct(F.lit(0).alias("_"))
    picked = df.select(row.alias("_row"), col(text).alias("_text"))
    schema = T.StructType([T.StructField("rows", T.ArrayType(picked.schema["_row"].dataType)), *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in _BLOCK.items()))])
    aligned = materialise(picked.mapInArrow(releasing(_aligning(block, ranks_path, pattern, model_path)), schema), "aligned", TOGETHER)
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count"))
    counts = materialise(counts, "counts")
    a, b = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = lambda side, name: counts.groupBy(side.alias(name)).agg(F.max("count").alias(f"most_{name}"))
    keyed = counts.select("pair", "count", a.alias("a"), b.alias("b"))
    joined = keyed.join(growing(most(a, "a")), "a").join(growing(most(b, "b")), "b")
    best = materialise(joined.select("pair", "count", (F.col("count") == F.col("most_a")).alias("best_a"), (F.col("count") == F.col("most_b")).alias("best_b")), "best")
    discard(counts)
    return aligned, best
