import random
from collections import Counter

import numpy as np

from litmetrics.llm.dart_minhash import dart_signatures, near_dedup, near_duplicate_classes, shingles


def sets_of(text, n=5):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def similar(a, b):
    return bool(a and b) and 5 * (a & b).total() >= 4 * (a | b).total()


def brute(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = [sets_of(t) for t in texts]
    for i in range(len(s)):
        for j in range(i):
            if similar(s[i], s[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(s))]


def corpus():
    rng = random.Random(2)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [None, "", "  \n", "a", "a", "a b c", "a  b\tc", "a b c d e"]
    for _ in range(12):
        base = say(rng.randrange(20, 400))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            c = list(base)
            for _ in range(rng.randrange(1, 12)):
                c[rng.randrange(len(c))] = f"v{rng.randrange(99)}"
            texts.append(" ".join(c))
    texts += [texts[-1], texts[-1], texts[20]]
    # the same shingles, but not as often: alike as sets, not by weight
    line = " ".join(say(30))
    texts += [" ".join([line] * n) for n in (2, 3, 10, 11, 12)]
    rng.shuffle(texts)
    return texts


def test_classes_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id int, kept string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    left = near_dedup(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want))


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "p q r s t u", 1), (None, "p q r s t u", 1), (3, None, 2), (3, None, 2)], "doc_id long, text string, a int")
    assert near_dedup(df).count() == 3
    assert near_dedup(df.filter("false")).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 2**62, 300).astype(np.uint64)
    wa, wb = rng.random(300) * 3 + 0.1, rng.random(300) * 3 + 0.1
    k = 4000
    sig = dart_signatures(np.repeat([0, 1], 300), np.concatenate([ids, ids]), np.concatenate([wa, wb]), 2, k)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / k) ** 0.5


def test_shingles_match_words():
    texts = ["a b c d e f", "", "x\ty", "a b c d e f a b c d e f"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    who, _, count = shingles(offsets, np.frombuffer(b"".join(raw), np.uint8))
    assert np.bincount(who, minlength=4).tolist() == [len(sets_of(t)) for t in texts]
    assert count.sum() == 2 + 1 + 8


def test_blocks_find_the_links_that_pairs_find():
    from litmetrics.llm.dart_minhash import spanning_links

    rng = np.random.default_rng(1)
    base = np.arange(6000)
    x = [np.sort(rng.choice(base[:60], 50, replace=False)) if i % 2 else np.sort(rng.choice(base, 50, replace=False)) for i in range(30)]
    y = [np.sort(rng.choice(base[:60], 52, replace=False)) for _ in range(40)]
    links = spanning_links(x, np.arange(30), y, np.arange(100, 140), 0.8)
    want = {(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b))}
    assert want and set(links) <= want

    def joined(pairs):
        label = list(range(70))
        for _ in range(70):
            for i, j in pairs:
                label[i] = label[30 + j] = min(label[i], label[30 + j])
        return label

    assert joined(links) == joined(want)


def test_families_in_blocks_against_brute_force(spark, monkeypatch):
    import litmetrics.llm.dart_minhash as d

    original = d._second_links
    monkeypatch.setattr(d, "_second_links", lambda *a: original(*a, few=0, block=2))
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = []
    for _ in range(40):
        c = list(base)
        for _ in range(rng.randrange(1, 6)):
            c[rng.randrange(len(c))] = f"v{rng.randrange(999)}"
        texts.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_classes_of_the_table_against_all_pairs(spark):
    """Every pair of the smallest table at a weighted similarity of 0.8 or more is in one class, and no others are joined."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = brute([t for _, t in rows])
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(docs).collect()}
    assert [got[i] for i, _ in rows] == [rows[c][0] for c in want]
    assert len(set(want)) < len(rows)
