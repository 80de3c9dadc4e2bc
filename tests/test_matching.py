"""Prefix matches against all pairs, also where half of the titles begin alike; record titles of every script."""

import random
from statistics import median

from pyspark.sql import functions as F

from litmetrics.operators import matching, profiles, verification

HEAD = "introductiontothetheory"


def titles(n=400):
    rng = random.Random(6)
    keys = []
    for i in range(n):
        head = HEAD if i % 2 else "".join(rng.choice("abc") for _ in range(20))
        keys.append(head + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))))
    return [*keys, "", "short", "short", "shorter", *keys[:9]]


def plain(refs, rows):
    """(ref, row, exact) by all pairs."""
    out = {}
    for ref, r in refs:
        hits = [(k == r, c or 0, -i, i) for i, k, c in rows if k and r and (k == r or len(r) >= 20 and k.startswith(r))]
        if hits:
            best = max(hits)
            out[ref] = (best[3], int(best[0]))
    return out


def test_prefix_match_by_all_pairs(spark):
    rng = random.Random(8)
    rows = [(i, k, rng.choice([None, 0, 3, 3, 9])) for i, k in enumerate(titles())]
    refs = [(i, k[: rng.choice([len(k), 20, 22, 23, 25])]) for i, k in enumerate(titles())][::3] + [(999, "")]
    p, r = spark.createDataFrame(rows, "id int, k string, c int"), spark.createDataFrame(refs, "ref int, r string")
    got = {x.ref: (x.id, x.exact) for x in matching.prefix_match(r, p, "ref", "r", "k", "c", "id").collect()}
    assert got == plain(refs, rows)
    assert matching.prefix_match(r.limit(0), p, "ref", "r", "k", "c", "id").collect() == []


def test_coverage_by_all_pairs(spark):
    keys = titles(200)
    refs = [("xy"[i % 2], k[:22]) for i, k in enumerate(keys)]
    rows = [("xy"[i % 3 % 2], k) for i, k in enumerate(keys)][::2]
    got = {x.who: (x.found, x.total) for x in verification.coverage(spark.createDataFrame(refs, "who string, k string"), spark.createDataFrame(rows, "who string, k string"), "who", "k").collect()}
    fits = lambda r, k: k.startswith(r) if len(r) >= 20 else k == r
    assert got == {w: (sum(any(w == v and fits(r, k) for v, k in rows) for u, r in refs if u == w), sum(u == w for u, _ in refs)) for w in "xy"}


def test_a_head_of_half_the_rows_is_dealt_out(spark):
    n = 40_000
    rows = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit(HEAD), F.sha1(F.col("id").cast("string")))).otherwise(F.concat(F.sha1(F.col("id").cast("string")), F.lit("x"))).alias("k"))
    refs = rows.filter("id % 5 = 0").select(F.substring("k", 1, 30).alias("r"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("false", "-1", "8"), strict=True):
            spark.conf.set(k, v)
        out = matching.beginnings(rows, "k", refs, "r").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    counts = [r["count"] for r in out]
    assert len(counts) == 8 and max(counts) <= 2 * median(counts)
    assert sum(counts) == n / 2 + n / 10  # one length a head: every row of a head that references have, once


def test_heads_are_salted_where_many_rows_have_them_and_hold_no_sets(spark, monkeypatch):
    rows = [("xy"[i % 2], HEAD + str(i) if i % 3 else f"{i:020d}" + "ab"[: i % 5 % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "who string, k string")
    refs = df.select("who", F.substring("k", 1, 21).alias("r"))
    find = lambda: matching.beginnings(df, "k", refs, "r", ("who",))
    lengths = {}
    for who, k in rows:
        lengths.setdefault((who, k[:20]), set()).add(min(len(k), 21))
    want = sorted((who, k, k[:n]) for who, k in rows for n in lengths[who, k[:20]] if n <= len(k))
    assert sorted(tuple(r) for r in find().collect()) == want
    monkeypatch.setattr(matching, "HOT", 50)
    assert sorted(tuple(r) for r in find().collect()) == want
    assert "collect_set" not in find()._jdf.queryExecution().optimizedPlan().toString()


def test_records_of_every_script_stay(spark):
    rows = [("1", "Обзор методов", 5), ("2", "Обзор методов!", 9), ("3", "Другая статья", None), ("4", "Третья", 0), ("5", "A Survey", 1), ("6", "a  survey", 1), ("7", "...", 9), ("8", None, 9)]
    df = spark.createDataFrame(rows, "id string, title string, citationCount long")
    assert sorted(r.id for r in profiles.most_cited(df).collect()) == ["2", "3", "4", "5"]
