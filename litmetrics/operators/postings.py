"""Terms of documents, block by block: which terms a block's documents hold, and the postings of all documents by term.

Documents are dealt in blocks by the hash of their key; only the texts move for that. A task numbers a block's words, counts
words and pairs of neighbours as numbers, and asks for each different term once: the terms go out by ranges of their hashes,
compressed, with the numbers of the block's documents that hold them where they are wanted. A range's task brings together what
is asked for the same term, compared as text. No vocabulary is collected, and a term is never taken for another of its hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

BLOCK = 2048  # documents of a block
ASKED = "_range int, _block int, sizes binary, terms binary, df binary, cells binary, at binary, tf binary"
POSTED = "df binary, sizes binary, rows binary, places binary, tf binary, others binary, other_rows binary, other_places binary, other_tf binary"
ODD = 0x9E3779B97F4A7C15


def words(text: Column) -> Column:
    """Lower-cased words of at least two word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w\w+"), F.lit(0))


def blocks_of(n: int) -> int:
    return 1 + n // BLOCK


def dealt(df: DataFrame, key: str, number: int, text: Column | None = None, extra: tuple[str, ...] = (), first: int = 0) -> DataFrame:
    """(_block, _at, key, extra, and _words where there is a text), by block; `_at` counts a block's keys from 0 on."""
    block = (F.pmod(F.xxhash64(key), F.lit(number)) + first).cast("int").alias("_block")
    own = [] if text is None else [text.alias("_text")]
    rows = df.select(block, F.col(key), *extra, *own).repartition(number, "_block").sortWithinPartitions("_block", key, *(["_text"] if own else []))
    at = (F.dense_rank().over(Window.partitionBy("_block").orderBy(key)) - 1).cast("int").alias("_at")
    return rows.select("_block", at, key, *extra, *([words(F.col("_text")).alias("_words")] if own else []))


def _zip(x: np.ndarray) -> bytes:
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unzip(x: pa.Scalar, kind=np.int32) -> np.ndarray:
    raw = x.as_buffer()
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], size, codec="zstd") if size else b"", kind)


def _bytes(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each term begins and ends, and the bytes of all."""
    _, ends, data = terms.buffers()
    ends = np.frombuffer(ends, np.int64)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int64)
    return ends - ends[0], np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]


def _hashes(terms: pa.Array) -> np.ndarray:
    """A hash of each word's bytes: the bytes times powers of an odd number, less what comes before the word."""
    ends, data = _bytes(terms)
    powers = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(data), x, np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(ODD)[:-1])])
    return _mixed((sums[ends[1:]] - sums[ends[:-1]]) * powers(pow(ODD, -1, 1 << 64))[ends[:-1]])


def _mixed(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)


@dataclass
class Counted:
    """A block's different terms by range; and by term and document the occurrences: the term's place, the document's, how often."""

    terms: pa.Array
    ranges: np.ndarray
    df: np.ndarray
    term: np.ndarray
    at: np.ndarray
    tf: np.ndarray


def counted(at: np.ndarray, lists: pa.ListArray, ranges: int) -> Counted:
    """Rows of one document (equal `at`) are counted together; df counts rows."""
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().cast(pa.large_string()).dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary).to_numpy()  # neighbours are alike, which compresses, and the rows' order is nothing
    own = coded.dictionary.take(pa.array(by_name))
    w = np.argsort(by_name)[coded.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    near = row[1:] == row[:-1]
    pairs, nth = np.unique(w[:-1][near] * len(own) + w[1:][near], return_inverse=True)
    left, right = np.divmod(pairs, max(1, len(own)))
    terms = pa.concat_arrays([own, pc.binary_join_element_wise(own.take(pa.array(left)), own.take(pa.array(right)), pa.scalar(" ", pa.large_string()))])
    h = _hashes(own)
    of = (_mixed(np.concatenate([h, _mixed(h[left]) + h[right]])) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    term, row = place[np.concatenate([w, len(own) + nth])], np.concatenate([row, row[1:][near]])
    by_row = lambda x, k: np.unique(term * max(1, k) + x, return_counts=True)
    docs = 1 + int(at.max(initial=0))
    cells, tf = by_row(at[row].astype(np.int64), docs)
    held = cells // docs if len(np.unique(at)) == len(at) else by_row(row, len(sizes))[0] // max(1, len(sizes))
    return Counted(terms.take(pa.array(order)), of[order], np.bincount(held, minlength=len(order)).astype(np.int32), cells // docs, (cells % docs).astype(np.int32), tf.astype(np.int32))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, which come one after the other."""
    def parts():
        for batch in batches:
            blocks = batch.column("_block").to_numpy()
            edges = [0, *(1 + np.flatnonzero(np.diff(blocks))), len(blocks)]
            yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)

    for _, same in groupby(parts(), lambda x: x.column("_block")[0].as_py()):
        yield pa.Table.from_batches(list(same)).combine_chunks()


def _count(block: pa.Table, ranges: int) -> Counted:
    return counted(block["_at"].to_numpy(), pa.chunked_array(block["_words"].chunks).combine_chunks(), ranges)


def asked(rows: DataFrame, ranges: int, postings: bool) -> DataFrame:
    """What the blocks of `dealt` ask, by range."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_blocks(batches):
            c = _count(block, ranges)
            ends, data = _bytes(c.terms)
            cells = np.bincount(c.term, minlength=len(c.terms)).astype(np.int32)
            before = np.concatenate([[0], np.cumsum(cells, dtype=np.int64)])
            own, first = np.unique(c.ranges, return_index=True)
            columns = [[] for _ in range(6)]
            for a, b in zip(first, [*first[1:], len(c.terms)]):
                x = slice(before[a], before[b])
                parts = [np.diff(ends[a : b + 1]).astype(np.int32), data[ends[a] : ends[b]], c.df[a:b], *([cells[a:b], c.at[x], c.tf[x]] if postings else [])]
                for column, part in zip(columns, [*map(_zip, parts), *[None] * (6 - len(parts))]):
                    column.append(part)
            number = block["_block"][0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([number] * len(own), pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=[x.split()[0] for x in ASKED.split(", ")])

    return rows.select("_block", "_at", "_words").mapInArrow(ask, ASKED).repartition(ranges, "_range")


class _Range:
    """All that is asked of a task: the terms' numbers in the order of the questions."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.table = pa.Table.from_batches(list(batches), None) if (batches := [b for b in batches if b.num_rows]) else None
        if self.table is not None:
            self.blocks = self.table["_block"].to_numpy()
            sizes = [_unzip(x) for x in self.table["sizes"]]
            self.asked = np.array([len(x) for x in sizes])
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
            data = b"".join(_unzip(x, np.uint8).tobytes() for x in self.table["terms"])
            self.code = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode().indices.to_numpy().astype(np.int64)
            self.df = self.all("df")

    def all(self, name: str) -> np.ndarray:
        return np.concatenate([_unzip(x) for x in self.table[name]])


def posted(questions: DataFrame, starts: np.ndarray, fitted: int, min_df: int = 2) -> DataFrame:
    """The postings of the terms that at least min_df rows of the first `fitted` blocks hold, one row a task (POSTED).

    Documents are numbered on from starts[block]. rows: those of the fitted blocks, term by term (`sizes` of them each);
    places and tf: which of them are held how often, where it is not once; the others' postings likewise.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Range(batches)
        if got.table is None:
            return
        block = np.repeat(got.blocks, got.asked)
        own = block < fitted
        df = np.bincount(got.code[own], got.df[own], minlength=got.code.max(initial=-1) + 1).astype(np.int64)
        cells, at, tf = (got.all(x) for x in ("cells", "at", "tf"))
        kept = df >= min_df
        number = np.cumsum(kept) - 1
        arrays = [df[kept]]
        of, origin = np.repeat(got.code, cells), np.repeat(block, cells)
        for part in (True, False):
            x = kept[of] & ((origin < fitted) == part)
            term, row, times = number[of[x]], starts[origin[x]] + at[x], tf[x]
            order = np.lexsort((row, term))
            row, times = row[order], times[order]
            places = np.flatnonzero(times > 1)
            arrays += [np.bincount(term, minlength=len(arrays[0])), row, places, times[places]]
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, np.int32).tobytes()], pa.binary()) for x in arrays], names=[x.split()[0] for x in POSTED.split(", ")])

    return questions.mapInArrow(post, POSTED)


ANSWERED = "_block int, _range int, df binary"


def answered(questions: DataFrame) -> DataFrame:
    """For each question how many rows of all blocks hold its terms, in their order."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Range(batches)
        if got.table is None:
            return
        total = np.bincount(got.code, got.df).astype(np.int32)[got.code]
        df = [_zip(x) for x in np.split(total, np.cumsum(got.asked)[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(got.blocks), got.table["_range"].combine_chunks(), pa.array(df, pa.binary())], names=["_block", "_range", "df"])

    return questions.mapInArrow(answer, ANSWERED)


def weighed(rows: DataFrame, answers: DataFrame, key: str, number: int, ranges: int, total: int, min_df: int) -> DataFrame:
    """(key, term, weight) of the blocks of `dealt` by their answers: (1 + ln tf) * idf, scaled to length 1 by document."""

    def weigh(block: pa.Table, answer: pa.Table) -> pa.Table:
        c = _count(block, ranges)
        order = np.argsort(answer["_range"].to_numpy())
        df = np.concatenate([np.zeros(0, np.int32), *(_unzip(answer["df"][int(i)]) for i in order)])
        kept = df[c.term] >= min_df
        term, at = c.term[kept], c.at[kept]
        raw = (1 + np.log(c.tf[kept])) * (np.log((1 + total) / (1 + df[term])) + 1)
        weight = raw / np.bincount(at, raw * raw)[at] ** 0.5
        first = np.unique(block["_at"].to_numpy(), return_index=True)[1]
        keys = block[key].combine_chunks().take(pa.array(first[at]))
        return pa.table({key: keys, "term": c.terms.take(pa.array(term)).cast(pa.string()), "weight": weight})

    schema = StructType([StructField(key, rows.schema[key].dataType), StructField("term", StringType()), StructField("weight", DoubleType())])
    return rows.groupBy("_block").cogroup(answers.repartition(number, "_block").groupBy("_block")).applyInArrow(weigh, schema)
