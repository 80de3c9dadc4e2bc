"""Extra columns whose names have dots or clash with the operators' own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from litmetrics.llm import dart_minhash, quality_rules


@pytest.fixture(scope="module")
def odd(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(words[(i % 12 * 7 + j * (i % 12 + 3)) % 10] + str(i % 12) for j in range(80)), "en", f"s{i % 3}", 1) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"x.y": F.lit("kept"), "_uid": F.lit(5), "class_id": F.lit("c"), "n_words": F.lit("n"), "_text": F.lit("t")})


def test_near_dedup_keeps_them(odd):
    out = dart_minhash.near_dedup(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert len(rows) == 12 and {(r["x.y"], r["_uid"], r["class_id"], r["n_words"]) for r in rows} == {("kept", 5, "c", "n")}


def test_quality_rules_do_not_mind_them(odd):
    out = quality_rules.quality_verdicts(odd.drop("n_words"))
    assert out.count() == 24


@pytest.mark.parametrize("stage", range(4))
def test_pipeline_stages_keep_them(spark, odd, sf_dir, stage):
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, odd.filter("doc_id < 12"), sf_dir)
    assert out.columns == odd.columns, name
    rows = out.collect()
    assert {r["x.y"] for r in rows} <= {"kept"} and (rows or name == "language_id")
