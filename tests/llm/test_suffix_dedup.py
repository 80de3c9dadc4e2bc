import hashlib
import random

import numpy as np

from litmetrics.llm.suffix_dedup import anchors, common_prefixes, suffix_array, suffix_dedup


def brute(texts, window):
    where = {}
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - window + 1):
            where.setdefault(raw[i : i + window], []).append((d, i))
    gone = [bytearray(len(r)) for r in raws]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + window] = b"\1" * window
    return [(len(r), sum(g), hashlib.sha256(bytes(b for b, x in zip(r, g) if not x)).hexdigest()) for r, g in zip(raws, gone)]


def corpus(rng):
    words = ["ab", "cde", "é", "fghi", "j", "\n", "klm"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    shared = [say(30) for _ in range(3)]
    texts = [None, "", "x", "y" * 700, "y" * 700, "ab" * 500, "z" * 41, say(3000)]
    for _ in range(60):
        t = say(rng.randrange(5, 120))
        if rng.random() < 0.6:
            t += rng.choice(shared) + say(rng.randrange(40))
        if rng.random() < 0.3:
            t += rng.choice(shared)[:70] + say(2)
        texts.append(t)
    texts += [texts[20], texts[21], texts[21]]
    return texts


def test_suffix_array_and_prefixes_against_sorting():
    rng = random.Random(1)
    for n in (1, 2, 50, 400):
        for letters in (b"a", b"ab", b"abcdefgh\xff"):
            raw = bytes(rng.choice(letters) for _ in range(n)) * 2
            data = np.frombuffer(raw, np.uint8)
            order = suffix_array(data, 10_000)
            assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
            lcp = common_prefixes(data, order, 64)
            for a, b, x in zip(order, order[1:], lcp):
                k = 0
                while k < 64 and max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
                    k += 1
                assert x == k


def test_anchors_cover_every_window():
    rng = np.random.default_rng(3)
    for data in (rng.integers(0, 3, 3000), np.zeros(3000), np.tile(rng.integers(0, 255, 7), 500)):
        data = data.astype(np.uint8)
        at, *_ = anchors(data, np.array([1500, len(data)]), np.array([0, 1500]), 60, 20)
        for i in range(len(data) - 60 + 1):
            if i + 60 <= 1500 or i >= 1500:
                assert ((at >= i) & (at <= i + 40)).any(), i


def check(spark, texts, **kw):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup(df, min_bytes=60, gram=20, **kw).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 60)


def test_against_brute_force(spark):
    check(spark, corpus(random.Random(5)))


def test_hot_groups_are_split(spark):
    check(spark, corpus(random.Random(6)), group_limit=3)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "q" * 70, 1), (1, "r" * 10, 1), (1, None, 2)], "doc_id long, text string, n_bytes int")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup(df, min_bytes=60, gram=20).collect()))
    assert got == [(0, 70, 70), (1, 0, 0), (1, 10, 0)]
    assert suffix_dedup(df.filter("false")).count() == 0


def repeated_across(texts, n):
    """For each text the words that lie in n words which stand in another text too."""
    where = {}
    for d, w in enumerate(texts):
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), set()).add(d)
    gone = [[False] * len(w) for w in texts]
    for d, w in enumerate(texts):
        for i in range(len(w) - n + 1):
            if len(where[tuple(w[i : i + n])]) > 1:
                gone[d][i : i + n] = [True] * n
    return gone


def test_passages_in_words_against_brute_force(spark):
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    shared = [say(n) for n in (10, 11, 12, 13, 20, 40)]
    texts = [[], say(3), say(200) * 2]
    for _ in range(80):
        t = say(rng.randrange(0, 30))
        for _ in range(rng.randrange(3)):
            t += rng.choice(shared)[: rng.randrange(9, 41)] + say(rng.randrange(4))
        texts.append(t)
    blanks = [" ", "  ", "\n", "\t "]
    rows = [(i, "".join(x + rng.choice(blanks) for x in t) or None, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string").repartition(4)
    want = [[x for x, g in zip(t, gone) if not g] for t, gone in zip(texts, repeated_across(texts, 12))]
    assert any(len(a) != len(b) for a, b in zip(want, texts))
    for limit in (512, 2):
        got = {r.doc_id: (r.kept or "").split() for r in suffix_dedup(df, min_words=12, across=True, keep="text", gram=24, group_limit=limit).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_production_parameters_and_texts_in_segments(spark):
    from litmetrics.llm.suffix_dedup import SEGMENT

    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz  "
    say = lambda n: "".join(rng.choices(letters, k=n))
    shared = say(900)
    long = say(SEGMENT + 5000)
    border = SEGMENT - 400
    long = long[: border - 300] + shared + long[border + 600 :]  # lies over the border of two segments
    texts = [long, say(100) + shared[:400] + say(50), say(70) + shared[200:599] + say(9), say(2000), "ab" * 600, shared]
    texts += [say(300) + shared + say(20) for _ in range(4)]
    for limit in (512, 3):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup(df, group_limit=limit).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, 400)
