"""Sinks that swap on success, and the scan of JSON lines for wanted keys."""

import json

import pytest
from pyspark.sql import functions as F

from litmetrics.sources import files


def rows_of(spark, path):
    return sorted(tuple(r) for r in files.read_csv(spark, path).collect())


def test_a_failing_job_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_csv(spark.createDataFrame([("1", "a")], "id string, x string"), path)
    broken = spark.range(100).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("b")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        files.write_csv(broken, path)
    assert rows_of(spark, path) == [("1", "a")]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_failing_swap_is_rolled_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    files.write_csv(spark.createDataFrame([("1", "a")], "id string, x string"), path)

    def write(to):
        assert not to.endswith("/t")  # nothing is there to be put in place

    with pytest.raises(Exception):
        files.swapped(spark, path, write)
    assert rows_of(spark, path) == [("1", "a")]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_table_is_enriched_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_csv(spark.createDataFrame([("1", "old"), ("2", None), ("3", "x")], "id string, type string"), path)
    extra = spark.createDataFrame([("1", "review"), ("1", "article"), ("2", "book")], "id string, type string")
    files.enrich_csv(spark, path, extra, "id", "type")
    assert rows_of(spark, path) == [("1", "article"), ("2", "book"), ("3", None)]


def test_wanted_lines_whatever_the_split_size(spark, tmp_path):
    folder = tmp_path / "snap"
    folder.mkdir()
    want = {}
    for name in ("b.jsonl", "a.jsonl"):
        lines = []
        for i in range(400):
            key = f"k{i % 90}" if i % 7 else f'q"{i % 5}é'
            lines.append(json.dumps({"id": key, "inner": {"id": "k3"}, "n": i, "file": name}))
        (folder / name).write_text("\n".join([*lines, "no json", "{}"]))
    for name in ("a.jsonl", "b.jsonl"):
        for line in (folder / name).read_text().split("\n")[:400]:
            r = json.loads(line)
            want.setdefault(r["id"], (r["n"], r["file"]))
    keys = [k for k in want if k in {"k1", "k3", "k89", 'q"0é', 'q"4é'}]
    wanted = spark.createDataFrame([(k,) for k in [*keys, "absent", keys[0]]] + [(None,)], "id string")
    results = []
    for size in ("128m", "3000b", "500b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = files.read_json_lines(spark, str(folder), "id string, n int, file string", "id", wanted).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        results.append({r.id: (r.n, r.file) for r in got})
        assert len(got) == len(keys)
    assert results[0] == results[1] == results[2] == {k: want[k] for k in keys}


def test_the_bitmap_loses_nothing_and_drops_most(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    wanted = df.filter("cast(key as int) % 100 = 0").withColumnRenamed("key", "w")
    kept = {r.key for r in files.maybe_in(df, "key", wanted).collect()}
    assert {str(i) for i in range(0, 20_000, 100)} <= kept and len(kept) < 230
    assert files.maybe_in(df, "key", wanted.limit(0)).count() == 0
