import random

import corpus_pipeline
from litmetrics.llm.common import shared_dir


def prose(rng, n, words=4000):
    return [f"{rng.choice(['the', 'of', 'and', 'to', 'in'])}{rng.randrange(words)}" for _ in range(n)]


def passages(text, n=51):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def documents():
    """Documents of which every fifth shares a passage of 51 to 70 words with others, exact and near copies, and odd rows."""
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (51, 52, 55, 60, 70)]
    rows = []
    for i in range(120):
        w = prose(rng, rng.randrange(60, 200))
        if i % 5 == 0:
            at = rng.randrange(len(w))
            w[at:at] = shared[(i // 5) % 5]
        rows.append((i, " ".join(w), "en", f"src{i % 3}", "x"))
    clean = [i for i in range(120) if i % 5]
    rows += [(200, rows[1][1], "en", "src0", "x"), (201, rows[2][1] + " and more", "en", "src1", "x")]
    rows += [(300, None, "en", "src0", "x"), (301, "", "en", None, "x"), (302, " \n ", None, None, None), (None, " ".join(prose(rng, 80)), "en", None, None), (None, " ".join(prose(rng, 80)), "en", None, None)]
    return rows, clean


def stages(spark, df, upto):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        df = stage(spark, df, None)
    return df


def test_shared_passages_go_and_clean_documents_stay(spark):
    rows, clean = documents()
    df = spark.createDataFrame([(i, t, lang, s, len(t or ""), x) for i, t, lang, s, x in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)
    left = stages(spark, df, 3)
    assert left.columns == df.columns
    got = left.collect()
    seen = {}
    for r in got:
        for p in passages(r.text):
            seen.setdefault(p, set()).add((r.doc_id, r.text))
    assert not [p for p, x in seen.items() if len(x) > 1]
    kept = {r.doc_id: r for r in got if r.doc_id is not None}
    before = {i: t for i, t, *_ in rows}
    assert all(kept[i].text == before[i] for i in clean)
    assert not kept.keys() & {200, 201, 300, 301, 302}
    assert sum(r.doc_id is None for r in got) == 2
    assert all(r.n_chars == len(r.text) for r in got)


def test_whole_run_and_empty_table(spark, tmp_path):
    rows, _ = documents()
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, table in (("some", df), ("none", df.filter("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        found = out.collect()
        assert {"doc_id", "start", "length", "sequence_id"} <= set(out.columns)
        assert bool(found) == (name == "some")
    sequences = {}
    for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect():
        sequences.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_are_named_and_ordered(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "packing"]
    assert shared_dir(spark).startswith("file:")
