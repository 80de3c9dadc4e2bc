"""Alignment of two vocabularies against whole-text encoding by the public libraries and all pairs of token ranges."""

import hashlib
import random
import re
from collections import defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from litmetrics.llm import token_alignment as A
from litmetrics.llm.queries import alignment_paths


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_of():
    """The public byte-level alphabet: printable characters stand for themselves, the others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in [*zip(plain, plain), *((b, 256 + n) for n, b in enumerate(rest))]}


BYTES = byte_of()


def plain(texts, libraries):
    """Per text (n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, digest), by definition."""
    enc_a, enc_b = libraries
    found, docs = [], defaultdict(int)
    for text in texts:
        links, groups, sizes = [], "", (0, 0, 0)
        if text:
            e = enc_a.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(BYTES[c] for c in enc_a.id_to_token(i))) for i in e.ids]
            b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := enc_b.id_to_piece(i)) else p.replace("▁", " ").encode()) for i in enc_b.encode(text)]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                spans = []
                for side in (a, b):
                    at, out = 0, []
                    for i, x in side:
                        out.append((at, at + len(x), i))
                        at += len(x)
                    spans.append(out)
                links = [(i, j) for s, e, i in spans[0] for s2, e2, j in spans[1] if s < e2 and s2 < e]
                cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                parts = [[[], []] for _ in cuts]
                for side in (0, 1):
                    for s, e, i in spans[side]:
                        parts[next(k for k, c in enumerate(cuts) if e <= c)][side].append(str(i))
                groups, sizes = ";".join("|".join(map(",".join, p)) for p in parts), (len(a), len(b), len(cuts))
        for p in set(links):
            docs[p] += 1
        found.append((sizes, links, groups))
    most = [defaultdict(int), defaultdict(int)]
    for (i, j), n in docs.items():
        most[0][i], most[1][j] = max(most[0][i], n), max(most[1][j], n)
    return [
        (*s, len(links), sum(docs[p] == most[0][p[0]] for p in links), sum(docs[p] == most[1][p[1]] for p in links), sum(docs[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for s, links, g in found
    ]


ODD = [
    None, "", " ", "  ", "\n", "\t x", "a", "a ", " a", "a  b", "a\nb", "a \n b", "a\n\n  b", "x\ry", "x \r\n y\r", "x\r\n", ");\r\n}\r x", "▁", "a ▁b", "<|endoftext|>", "<s> </s> <unk>", "<0x41>",
    "naïve Ünïcode ß", "漢字かな交じり文", " x  y", "a  b", "　", "\u0085z", "a\u0085 b", "\x1c a\x1d", "zero\x00byte", "tab\tsep\tx", "é ﬁ", "🙂🙂 👩‍👩‍👧", "don't  won't", "1234567 89", "....   ....", "a" * 3000, "ab " * 50, "x\v\fy",
]


def got(df, **options):
    rows = A.align_tokens(df, *alignment_paths(), **options).collect()
    return {r._row.doc_id: tuple(r)[1:] for r in rows}


def test_odd_and_random_texts_by_definition(spark, libraries):
    rng = random.Random(5)
    some = ["the", "Haus", "reëntry", "\n", "  ", "\t", "foo_bar", "x\r", "42", "...", "Straße", "日本", " ", "'s", "<s>", "ing", "ﬁ"]
    texts = [*ODD, *["".join(rng.choice(some) + rng.choice(["", " ", " ", "\n", "  "]) for _ in range(rng.randrange(1, 60))) for _ in range(120)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_a": F.lit("x"), "a.b": F.lit(1), "block": F.lit(2)}).repartition(3)
    found, want = got(df), plain(texts, libraries)
    assert {i: texts[i] for i in range(len(texts)) if found[i] != want[i]} == {}


def test_documents_by_definition(spark, sf_dir, libraries):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.length("text") < 3000).orderBy("doc_id").collect()
    texts = [r.text for r in rows]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    found, want = got(df, carry=["doc_id"]), plain(texts, libraries)
    assert [found[i] for i in range(len(texts))] == want


def test_chunks_add_up_to_whole_texts(libraries):
    texts = [t for t in ODD if t]
    aligner = A.Aligner(*alignment_paths())
    for text in texts:
        at = aligner.numbers_of(text)
        aligner.learn()
        total = tuple(aligner.counts[at].sum(axis=0).tolist()) if aligner.fine[at].all() else (0, 0, 0, 0)
        assert total == plain([text], libraries)[0][:4], text
    aligner.forget(0)
    assert not aligner.known and not aligner.groups


def test_blocks_make_no_difference(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    assert got(df, carry=["doc_id"], block=20_000) == got(df, carry=["doc_id"])


def test_null_and_repeated_ids_and_empty_tables(spark, libraries):
    texts = ["same text", "same text", None, "other words"]
    df = spark.createDataFrame([(i, t) for i, t in zip([1, 1, None, None], texts)], "doc_id long, text string")
    rows = sorted(tuple(r)[1:] for r in A.align_tokens(df, *alignment_paths(), carry=["doc_id"]).collect())
    assert rows == sorted(plain(texts, libraries))
    assert A.align_tokens(df.limit(0), *alignment_paths()).collect() == []
    assert A.align_tokens(df.filter("text is null"), *alignment_paths()).select("n_links", "count_sum", "groups_sha256").first() == (0, 0, "")


def test_pair_table(spark, libraries):
    df = spark.createDataFrame([(1, "cat dog"), (2, "cat cat"), (3, "dogs")], "doc_id long, text string")
    table = {(r.a, r.b): (r["count"], r.best_a, r.best_b) for r in A.pair_counts(df, *alignment_paths()).collect()}
    enc_a, enc_b = libraries
    cat = (enc_a.encode(" cat").ids[0], enc_b.encode("cat")[0])
    assert table[cat] == (2, True, True)
    assert all(n >= 1 for n, _, _ in table.values())


def test_row_groups_hold_few_blocks(spark):
    """A reader or writer of the blocks holds a row group: its rows must not grow with those of a task."""
    from pathlib import Path

    import pyarrow.parquet as pq

    df = spark.createDataFrame([(i, f"text number {i} of some words") for i in range(40)], "doc_id int, text string").coalesce(1)
    aligned, _ = A._linked(df, *alignment_paths(), "text", ["doc_id"], 100)
    files = [pq.ParquetFile(f).metadata for f in Path(aligned._written_to.removeprefix("file://")).glob("*.parquet")]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) >= 20 and max(groups) <= A.TOGETHER


def test_long_chunks_are_let_go_of(monkeypatch):
    monkeypatch.setattr(A, "HELD", 1 << 12)
    aligner = A.Aligner(*alignment_paths())
    for n in range(3):
        aligner.numbers_of(f"{n}" + "ab" * (A.HELD // 8))
        aligner.learn()
        aligner.forget()
    assert len(aligner.fine) < 3
