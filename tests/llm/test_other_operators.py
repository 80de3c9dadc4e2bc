import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmetrics.llm import html_extract, language_id, mixing, multi_index, packing, quality_rules, url_filter, warc
from litmetrics.llm.queries import vocabulary


# WARC -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [0, 1, 7, 8192, 8193, 100_000])
def test_chunked_round_trip(size):
    payload = bytes(range(256)) * (size // 256 + 1)
    assert warc.unchunked(warc.chunked(payload[:size])) == payload[:size]
    with pytest.raises(ValueError):
        warc.unchunked(warc.chunked(payload[:size])[:-5] + b"zz")


def test_warc_round_trip(spark):
    long = "WARC/1.1\r\n\r\n" + "x\r\n\r\n" * 3000
    rows = [(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/ c\r\nX: y", "same"), (4, "u", None), (5, "u", ""), (6, "u", long), (7, "é", "é")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, type string").repartition(3)
    got = {r.page_id: r for r in warc.archive_round_trip(df, segment=1000, records=4).collect()}
    for page, _, html in rows:
        raw = (html or "").encode()
        want = {3: 1, 2: 1, 5: 4}.get(page)
        r = got[page]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if want else "response", want, None)
    assert warc.archive_round_trip(df.filter("false")).count() == 0


def test_damaged_segments_are_reported(spark):
    parts = [warc._header([("WARC-Type", "x")])[:0] + r for r in warc.records_of(1, 1, "u", b"y" * 5000, None, 1000)]
    fields = [next(warc.parse_records(p)) for p in parts]
    rows = [(f.get("warc-record-id"), f["warc-type"], 1, f["warc-payload-digest"][5:], None, f.get("warc-segment-origin-id"), int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, bytearray(b)) for f, b in fields]
    schema = "id string, type string, key long, digest string, refers_to long, origin string, number long, total long, block binary"
    assert warc.reassemble(spark.createDataFrame(rows[::-1], schema)).first().payload == b"y" * 5000
    assert warc.reassemble(spark.createDataFrame(rows[:2] + rows[3:], schema)).first().problem == "segments are missing"
    assert warc.reassemble(spark.createDataFrame(rows[:-1], schema)).first().problem == "the total length differs"


# Nearest neighbours ---------------------------------------------------------------------------------------------------


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (3000, 4))
    index = multi_index.MultiIndex(codes, 8)
    for radius in (0, 3, 7, 10, 32):
        far = np.bitwise_count(codes ^ codes[5]).sum(axis=1)
        assert index.within(codes[5], radius).tolist() == np.flatnonzero(far <= radius).tolist()


def brute_neighbours(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    return {q: sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in ok if i != q)[:k] for q, v in ok if q % 100 == 0}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(600)]
    rows += [(i, [1.0] * 8) for i in range(1000, 1030)] + [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [1.0, None] * 4), (2400, [1.0, 2.0]), (2500, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(4)
    want = brute_neighbours(rows)
    got: dict = {}
    for r in multi_index.nearest(df, parts=2, block=200, queries=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got.keys() == want.keys() and all(len(got[k]) == 10 for k in got)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    assert [i for _, i in got[1000]] == list(range(1001, 1011))
    few = multi_index.nearest(df.filter("vec_id in (100, 101, 102)"), parts=2).collect()
    assert sorted(r.vec_id for r in few) == [101, 102]
    assert multi_index.nearest(df.filter("false")).count() == 0


# Packing --------------------------------------------------------------------------------------------------------------


def test_packing_is_a_partition_of_the_tokenizers_ids(spark):
    from pathlib import Path

    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [None, "", " ", "a", "Hello  world\n\n it's 12²3 ½ don't _x_ ", "é ñ ß ªº <|endoftext|> 中文 \u00a0x\x1cy\x85z", "lorem ipsum dolor " * 900, "x" * 3000, "tab\t\ttab  \n  end "] + [f"short text number {i} " * (i % 60) for i in range(150)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(4)
    assert Path(vocabulary()[0]).exists()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in texts]
    rows = packing.pack_documents(df, *vocabulary(), shard=50).collect()
    seen = {i: 0 for i in range(len(texts))}
    sequences: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(seen[i] == len(x) for i, x in enumerate(ids))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(df.filter("false"), *vocabulary()).count() == 0


def test_packing_wastes_little():
    rng = np.random.default_rng(3)
    histogram = np.bincount(rng.integers(1, 1024, 20000), minlength=1025)
    plan = packing.pack(histogram, 1024)
    used = np.zeros(1025, int)
    for combo, n in plan:
        assert sum(combo) <= 1024
        for v in combo:
            used[v] += n
    assert (used == histogram).all()
    assert sum(n for _, n in plan) * 1024 < 1.02 * (histogram * np.arange(1025)).sum()


def test_packing_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack_documents(df, *vocabulary()).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"] and len({r.sequence_id for r in rows}) == 1


# URL filter -----------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = {
        "http://A.Net/x": ("a.net", "/x", "net/", "block"), "https://example.net/en/1?q": ("example.net", "/en/1", "example.net/en/", "allow"),
        "https://w.example.net/de/1#x": ("w.example.net", "/de/1", "net/", "block"), "x://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://b.org/fr/": ("b.org", "/fr/", "org/fr/", "allow"), "http://net": ("net", "", None, None), "http://x.com?a/b": ("x.com", "", None, None), "nothing": ("", "", None, None), None: ("", "", None, None),
        "http://notnet/": ("notnet", "/", None, None), "a://b://c/d": ("b:", "//c/d", None, None),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or rule is None and got[i].verdict == "allow"  # too few examples for a model


def test_url_model_separates_held_out_urls(spark):
    rows = [(i, f"http://good{i % 7}.example.net/en/page-{i}") for i in range(300)] + [(1000 + i, f"http://spam{i % 5}.cheap.net/buy/{i * 37}") for i in range(300)]
    rows += [(5000 + i, f"http://good{i % 7}.example.info/en/page-{i + 900}") for i in range(40)] + [(6000 + i, f"http://spam{i % 5}.cheap.info/buy/{i * 37 + 5}") for i in range(40)]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[5000 + i] == "allow" for i in range(40)) >= 38 and sum(got[6000 + i] == "block" for i in range(40)) >= 38


def test_url_models_count_every_context(spark):
    bodies = [("allow", "abcab"), ("allow", "abd\u00fc"), ("block", "ab"), ("block", "")]
    want = Counter()
    for says, body in bodies:
        line = "\x02" + body + "\x03"
        want.update((says, line[i - n : i + 1]) for i in range(1, len(line)) for n in range(min(3, i) + 1))
    df = spark.createDataFrame(bodies, "says string, body string")
    assert {(r.says, r.gram): r.n for r in url_filter.count_grams(df, 3).collect()} == dict(want)
    grams, contexts = url_filter.train(df, 3)
    seen = {r.gram: (r.allow, r.block) for r in grams.collect()}
    assert seen == {g: (want["allow", g], want["block", g]) for _, g in want}
    ab = contexts.filter("context = 'ab'").first()
    assert (ab.t_allow, ab.k_allow, ab.t_block, ab.k_block) == (3, 3, 1, 1)
    model = Model([x for says, x in bodies if says == "allow"], 3)
    assert math.isclose(sum(model.probability("ab", chr(c)) for c in range(256)), 1.0, rel_tol=1e-9)


class Model:
    """Counts in a dictionary: P(c | context) backs off to ever shorter contexts and at last to 1/256."""

    def __init__(self, bodies, order):
        self.order, self.n, self.after = order, Counter(), {}
        for body in bodies:
            line = "\x02" + body + "\x03"
            for i in range(1, len(line)):
                for k in range(min(order, i) + 1):
                    self.n[line[i - k : i], line[i]] += 1
                    self.after.setdefault(line[i - k : i], Counter())[line[i]] += 1

    def probability(self, context, char):
        p = 1 / 256
        for k in range(len(context) + 1):
            tail = context[len(context) - k :]
            if tail not in self.after:
                break
            seen = self.after[tail]
            p = (seen[char] + len(seen) * p) / (seen.total() + len(seen))
        return p

    def mean_log(self, body):
        line = "\x02" + body + "\x03"
        return sum(math.log(self.probability(line[max(0, i - self.order) : i], line[i])) for i in range(1, len(line))) / (len(line) - 1)


def url_table():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeü"), rng.integers(1, 6)))
    urls = [f"http://{word()}.example.net/en/{word()}" for _ in range(60)] + [f"http://{word()}.net/buy/{rng.integers(999)}" for _ in range(60)]
    urls += [f"https://{word()}.info/{word()}?{word()}" for _ in range(80)] + [None, "", "no scheme", "://", "http://", "x://" + "ab/" * 30_000]
    return [(i, u, "clash") for i, u in enumerate(urls + urls[:7])] + [(None, "http://a.net/", "x"), (3, None, "x")]


def test_url_verdicts_against_brute_force(spark):
    rows = url_table()
    df = spark.createDataFrame(rows, "page_id long, url string, body string").repartition(4)
    out = url_filter.filter_urls(df)
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.score) for r in out.collect()]
    assert len(got) == len(rows)
    hashed = {r.url: r.h for r in df.filter("url is not null").select("url", F.pmod(F.xxhash64("url"), F.lit(5)).alias("h")).collect()}
    rule = {u: next((x.rule, x.says) for x in spark.createDataFrame([(u,)], "u string").select(*url_filter.split_url(F.col("u"))).toDF("h", "p").select(*url_filter.rule_of(F.col("h"), F.col("p"))).toDF("rule", "says").collect()) for u in list(hashed)[:5]}
    verdicts = {r[0]: r for r in got if r[0] is not None and r[0] != 3}
    labelled = {u: verdicts[i][4] for i, u, _ in rows if i in verdicts and u and verdicts[i][3]}
    assert all(labelled.get(u) == says for u, (_, says) in rule.items() if says)
    body = lambda u: u.partition("://")[2]
    models = [Model([body(u) for u, x in labelled.items() if x == says and hashed[u]], 4) for says in ("allow", "block")]
    score = lambda u: models[0].mean_log(body(u)) - models[1].mean_log(body(u))
    bins = [Counter(math.floor(score(u) * url_filter.STEPS) for u, x in labelled.items() if x == says and not hashed[u]) for says in ("allow", "block")]
    threshold = url_filter.calibrate(*bins)
    judged = 0
    for i, u, _ in rows:
        if i in verdicts and not verdicts[i][3]:
            if u and "://" in u:
                assert math.isclose(verdicts[i][5], score(u), abs_tol=1e-9)
                assert verdicts[i][4] == ("allow" if score(u) >= threshold else "block")
                judged += 1
            else:
                assert verdicts[i][4] == "allow"
    assert judged > 80
    assert url_filter.filter_urls(df.filter("false")).count() == 0


def test_url_parts_and_rules_against_sql(spark):
    """Host, path and rule of whole tables as SQL states them."""
    import duckdb

    sql = r"""
    with s as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
    r as (select * from (values ('net', '/', 'net/'), ('example.net', '/en/', 'example.net/en/'), ('example.com', '/de/', 'example.com/de/'), ('org', '/fr/', 'org/fr/')) t(h, p, rule))
    select page_id, host, path, (select rule from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(rule) desc limit 1) as rule from s"""
    path = "/root/testdata/sf0.01/pages.parquet"
    want = sorted(duckdb.sql(sql.replace("from pages)", f"from '{path}')")).fetchall())
    got = sorted((r.page_id, r.host, r.path, r.rule) for r in url_filter.filter_urls(spark.read.parquet(path)).collect())
    assert got == want and len({r[3] for r in want}) > 3


def test_url_threshold():
    assert url_filter.calibrate({5: 3, 9: 1}, {-7: 2, 1: 1}) == 2 / url_filter.STEPS
    assert url_filter.calibrate({}, {1: 1}) == 0.0


# Mixing ---------------------------------------------------------------------------------------------------------------


def shared_targets(sizes, most=3.0, weights=(1, 2, 3)):
    """Targets of sources in order by sharing what is left among those below their limit, one round after another."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i % 3] for i in free)
        over = [i for i in free if unit * weights[i % 3] > most * sizes[i]]
        for i in over or free:
            out[i] = most * sizes[i] if over else unit * weights[i % 3]
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 0, 5], [0, 0], [7], [1] * 50 + [100_000], [3, 5, 8, 13, 21, 34, 55, 2000, 1, 1, 1]])
def test_targets_against_rounds(spark, sizes):
    names = [f"s{i:03}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "_source string, words long").repartition(3)
    got = {r._source: r.target for r in mixing.source_targets(df).collect()}
    assert np.allclose([got[n] for n in names], shared_targets(sizes))


def test_settling_keeps_expectations_and_totals():
    sizes, part = [90.0, 40.0] + [10.0] * 30, 0.4
    ids, totals, n = list(range(32)), np.zeros(32), 4000
    for seed in range(n):
        bits = mixing.settle(ids, sizes, [part] * 32, seed, 0.4 * 430)
        assert abs(np.dot(bits, sizes) - 0.4 * 430) <= 10
        totals += bits
    # all but the last few keep their expectation
    assert np.abs(totals[:28] / n - part).max() < 4 * (part * (1 - part) / n) ** 0.5


def test_mix_of_few_documents_null_keys_and_ties(spark):
    rows = [(None, "w " * 5, "a"), (None, "w " * 5, "a"), (1, "w " * 5, "a"), (1, "w " * 5, "b"), (2, None, "b"), (3, "w " * 2000, "c"), (4, "w", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(r.size for r in got) == [0, 1, 5, 5, 5, 5, 2000]
    assert mixing.mix(df.filter("false")).count() == 0


@pytest.mark.parametrize("n", [5, 8, 12, 20])
def test_few_documents_come_near_the_best_reachable_subset(n):
    rng = random.Random(4)
    missed, least = [], []
    for seed in range(60):
        sizes = sorted((int(rng.lognormvariate(5, 1.3)) + 1 for _ in range(n)), reverse=True)
        part = rng.uniform(0.1, 0.9)
        goal, reached = part * sum(sizes), {0}
        for s in sizes:
            reached |= {x + s for x in reached}
        bits, _ = mixing.round_group(list(range(n)), sizes, [part] * n, seed, goal, True)
        missed.append(abs(sum(b * s for b, s in zip(bits, sizes, strict=True)) - goal) / goal)
        least.append(min(abs(x - goal) for x in reached) / goal)
    assert sum(missed) / 60 < sum(least) / 60 + 0.015


def test_expectations_hold_where_all_can_be_made_up_for():
    sizes, part = [40, 30, 20, 20, *[5] * 60], 0.4
    taken = [mixing.round_group(list(range(64)), sizes, [part] * 64, seed, part * sum(sizes), True)[0] for seed in range(1500)]
    for i in (0, 1, 2, 10, 30):  # the last one takes what is left of a word
        assert abs(sum(t[i] for t in taken) / 1500 - part) < 0.05
    assert all(abs(sum(b * s for b, s in zip(t, sizes, strict=True)) - part * sum(sizes)) <= 5 for t in taken)


def test_every_source_comes_near_its_target(spark, sf_dir):
    out = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["source"]).groupBy("_row.source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(out) > 10 and all(abs(r.taken - r.target) <= 0.03 * r.target for r in out)


def test_mix_meets_targets_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", "ü", None][min(3, int(rng.integers(0, 9)) // 2)]) for i in range(3000)] + [(9000, None, "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    one = mixing.mix(df.repartition(3), bucket=200, fan=2, carry=["doc_id", "source"]).collect()
    two = mixing.mix(df.repartition(5), bucket=200, fan=2, carry=["doc_id", "source"]).collect()
    assert {(r._row.doc_id, r.taken) for r in one} == {(r._row.doc_id, r.taken) for r in two}
    assert len(one) == len(rows) and all(0 <= r.copies <= 3 for r in one)
    for s in ("a", "b", "ü", None):
        own = [r for r in one if r._row.source == s]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in mixing.mix(df).collect())
    assert mixing.mixed_documents(df.filter("false")).count() == 0


def test_pivotal_keeps_expectations():
    total = np.zeros(6)
    sizes, parts = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [0.3] * 6
    for seed in range(3000):
        bits, held, p = mixing.pivotal(list(range(6)), sizes, parts, seed)
        values = [p if i == held else b for i, b in enumerate(bits)]
        assert math.isclose(sum(v * s for v, s in zip(values, sizes, strict=True)), 0.3 * 21)
        total += values
    assert np.abs(total / 3000 - 0.3).max() < 0.03


# HTML -----------------------------------------------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="x">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
%s<aside>side</aside><form><p>ask</p></form><div id="comments"><p>first comment that is rather long and chatty, so dense</p></div><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("body", [
    "<article><h1>Head &amp; Co</h1><p>One\n <b>bo</b>ld <a href='>'>link</a><p>Two<br>three<ul><li>x<li>y</ul><table><tr><td>1<td>2</table><div class=ad>buy</div></article>",
    "<main><article><h1>Head &amp; Co</h1><p>One <b>bo</b>ld <a href='>'>link</a></p></article><p>Two<br>three<ul><li>x<li>y</ul>1<div>2</div></main>",
])
def test_articles(body):
    assert html_extract.extract(PAGE % body) == "Head & Co One bold link Two three x y 1 2"


def test_page_without_article_elements():
    text = "Long text of the main part with many words in it. " * 8
    page = PAGE % f"<div class='wrap'><div class='top'><a href=a>one</a> <a href=b>two</a></div><div class='text'><p>{text}</p><p>{text}</p></div></div>"
    assert html_extract.extract(page) == " ".join([text.strip()] * 2)


def test_article_that_is_not_the_main_text():
    texts = [f"Part {i} of the main text with many words in it. " * 8 for i in range(4)]
    paragraphs = "".join(f"<p>{t}</p>" for t in texts)
    whole = " ".join(" ".join(texts).split())
    assert html_extract.extract(PAGE % f"<article class='card'><p>More</p></article><div>{paragraphs}</div>") == whole
    assert html_extract.extract(PAGE % "".join(f"<article><h2>H{i}</h2><p>{t}</p><p>{t}</p></article>" for i, t in enumerate(texts))) == " ".join(f"H{i} {t.strip()} {t.strip()}" for i, t in enumerate(texts))


def test_paragraphs_directly_in_the_body():
    long, short = "Long text of the main part with many words in it. " * 6, "A short paragraph of the same text. "
    page = PAGE % f"<h1>Head</h1><p>{long}</p>loose<p>{short}</p><p>{long}</p>"
    assert html_extract.extract(page) == f"Head {long}loose {short}{long.strip()}"
    assert html_extract.extract(PAGE % f"<article class='card'><p>More</p></article><p>{long}</p><p>{short}</p><p>{long}</p>") == f"More {long}{short}{long.strip()}"
    assert html_extract.extract(PAGE % f"<article><p>{long}</p></article><div>About us</div>") == long.strip()


def test_odd_pages(spark):
    odd = [None, "", "   ", "plain text", "<", "<p", "<p>a", "</p></div>b", "<script>x", "<!-- x", "<a>" * 3000 + "deep", "<p title=\"a>b\">ok"]
    assert [html_extract.extract(p) for p in odd] == ["", "", "", "plain text", "<", "<p", "a", "b", "", "", "deep", "ok"]
    df = spark.createDataFrame([(i, None, p, "x") for i, p in enumerate(odd)], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html_extract.extract_pages(df).collect()) == sorted(len(html_extract.extract(p)) for p in odd)


# Language -------------------------------------------------------------------------------------------------------------


def test_language_by_text_declaration_and_host(spark):
    rng = np.random.default_rng(5)
    words = {"aa": ["ksol", "trem", "vund", "halk"], "bb": ["piou", "laeiu", "moia", "reou"]}
    rows = [(i, " ".join(rng.choice(words[x], 40)), x, f"{x}.example.{x}", 1.0) for i, x in enumerate(["aa", "bb"] * 100)]
    rows += [(900, " ".join(rng.choice(words["aa"], 40)), "bb", "u", 1.0), (901, "$#@! 0x99 %%", None, None, 1.0), (902, None, "aa", "aa.example.aa", 1.0), (903, "halk", None, "bb.example.aa", 1.0), (900, "\x00\x01" * 40, None, "u", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, posterior double")
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    by = {(r._row.doc_id, r._row.lang): r for r in got}
    assert all(by[i, x].language == x and by[i, x].accepted for i, x in enumerate(["aa", "bb"] * 100))
    assert by[900, "bb"].language == "aa" and not by[902, "aa"].accepted and not by[900, None].accepted
    assert language_id.keep_identified(df).columns == df.columns
    assert language_id.identify(df.filter("false")).count() == 0


def test_every_declared_language_is_known(spark):
    rng = np.random.default_rng(8)
    names = [f"l{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    words = {x: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(6)] for x in names}
    rows = [(j * 70 + i, " ".join(rng.choice(words[x], 60)), x + ["", "-US", "_br"][j % 3], "u") for i, x in enumerate(names) for j in range(4 if i < 64 else 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = language_id.identify(df).collect()
    assert len(got) == len(rows) and all(r.language == r._row.lang[:3] and r.accepted for r in got)


# Quality --------------------------------------------------------------------------------------------------------------


def brute_counts(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_against_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = [None, "", " \t", "a", "a b", "a b c", "a b c a b c", "x " * 80, "l1\nl1\n\n l1\nl2", "#*$%&|<> \u00a0é\u2003 漢字", "\na b\x0bc\x1cd\r\n"]
    texts += [" ".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 90)))) + "\n" * int(rng.integers(0, 3)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "s", True) for i, t in enumerate(texts)], "doc_id long, text string, source string, kept boolean")
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_bad_hosts_are_rejected_and_small_ones_need_more_evidence(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, f"h{i % 10}") for i in range(1000)] + [(2000 + i, "bad", "junk") for i in range(200)] + [(3000, good, "junk"), (4000, "bad", "tiny"), (4001, good, None), (4002, good, "tiny")]
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[3000].kept and not got[3000].base_failed and got[4001].kept and got[4002].kept and all(got[i].kept for i in range(1000))
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality_rules.quality_verdicts(empty).count() == 0
    assert quality_rules.text_counts(empty.select("text"), "text").agg(F.count("*")).first()[0] == 0


def test_mix_reserve_is_bounded_and_makes_up_for_a_long_document(spark):
    sizes = np.sort(np.random.default_rng(1).integers(1, 500, 300_000))[::-1]
    assert mixing.reserve(sizes, np.full(len(sizes), 1e-6)) == mixing.BUCKET // 2
    assert mixing.reserve(sizes[:10], np.full(10, 0.5)) == 5 and mixing.reserve(sizes[:0], np.zeros(0)) == 0
    rows = [(i, " ".join(["w"] * (900 if i < 2 else 20)), "ab"[i % 2]) for i in range(402)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        mine = [r for r in got if r["_row"]["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 40


# Language evidence ----------------------------------------------------------------------------------------------------


def _accuracy(found, truth):
    return sum(found[i] == truth[i] for i in truth) / len(truth)


def test_language_holds_with_hidden_and_wrong_declarations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 100").select("doc_id", "text", "lang", "source")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    die = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10))
    other = F.element_at(F.array_except(F.array(*map(F.lit, ("en", "fr", "de", "es"))), F.array("lang")), 1)
    hidden = docs.withColumn("lang", F.when(die >= 4, F.col("lang")))
    wrong = docs.withColumn("lang", F.when(die == 0, other).otherwise(F.col("lang")))
    share = {}
    for name, table in (("hidden", hidden), ("wrong", wrong)):
        rows = language_id.identify(table, carry=["doc_id"]).select("_row.doc_id", "language").collect()
        share[name] = _accuracy({r.doc_id: r.language for r in rows}, truth)
        changed = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
        odd = {i: x for i, x in truth.items() if changed[i] != x}
        assert len(odd) > 50
        share[name + " where changed"] = _accuracy({r.doc_id: r.language for r in rows}, odd)
    assert min(share.values()) > 0.95, share


def test_hosts_and_suffixes_decide_where_texts_do_not(spark):
    rows = [(i, "12345 67890", "de" if i % 2 else None, f"h{i % 5}.example.de") for i in range(200)]
    rows += [(1000 + i, "12345 67890", "fr" if i % 2 else None, f"h{i % 5}.example.fr") for i in range(200)]
    rows += [(2000, "12345 67890", None, "new.example.de"), (2001, "12345 67890", None, "other.fr"), (2002, "12345 67890", "fr", "new.example.de"), (2003, "x" * 300_000, None, "h1.example.de"), (2004, "12345", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    found = {r.doc_id: r.language for r in language_id.identify(df, carry=["doc_id"]).select("_row.doc_id", "language").collect()}
    assert all(found[i] == "de" for i in range(200)) and all(found[1000 + i] == "fr" for i in range(200))
    assert (found[2000], found[2001]) == ("de", "fr")
    assert len(found) == len(rows)


def test_host_priors_against_hand_counts(spark):
    rows = [("a.x", "x", "de")] * 6 + [("a.x", "x", "fr")] * 2 + [("b.x", "x", "fr")] * 4 + [("c", "", None)]
    df = spark.createDataFrame(rows, "_host string, _suffix string, _declared string")
    got = {r._h: list(r._prior) for r in language_id.host_priors(df, ["de", "fr"], strength=2.0).collect()}
    top = [(6 + 1) / (12 + 2), (6 + 1) / (12 + 2)]
    x = [(6 + 2 * top[0]) / 14, (6 + 2 * top[1]) / 14]
    assert np.allclose(got["a.x"], [(6 + 2 * x[0]) / 10, (2 + 2 * x[1]) / 10])
    assert np.allclose(got["b.x"], [2 * x[0] / 6, (4 + 2 * x[1]) / 6])
    assert np.allclose(got["c"], top)


def test_pages_by_markup_and_address(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r.page_id: r.l for r in pages.select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("l")).collect()}
    stripped = pages.withColumn("html", F.when(F.pmod(F.xxhash64("page_id"), F.lit(3)) == 0, F.regexp_replace("html", '<html lang="[a-z]+">', "<html>")).otherwise(F.col("html")))
    found = {r.page_id: r.language for r in language_id.identify_pages(stripped).select("_row.page_id", "language").collect()}
    assert _accuracy(found, {i: x for i, x in truth.items() if x}) > 0.9
    assert language_id.identify_pages(pages.filter("false")).count() == 0


# Density --------------------------------------------------------------------------------------------------------------


def _random_page(rng, depth=0):
    """Nested lists [tag, children]; a child is a list or text."""
    tag = "body" if not depth else rng.choice(["div", "section", "p", "a", "span"] if depth < 4 else ["p", "a", "span"])
    if tag in ("p", "a", "span"):
        return [tag, ["x" * rng.randrange(1, 60)]]
    return [tag, [_random_page(rng, depth + 1) for _ in range(rng.randrange(1, 5))] + (["y" * rng.randrange(1, 9)] if rng.random() < 0.3 else [])]


def _markup(node):
    return node if isinstance(node, str) else f"<{node[0]}>{' '.join(map(_markup, node[1]))}</{node[0]}>"


def _measure(node, in_link=False):
    """Characters, tags, characters in links and links below a node."""
    c = t = lc = lt = 0
    for x in node[1]:
        inside = in_link or node[0] == "a"
        if isinstance(x, str):
            c, lc = c + len(x), lc + len(x) * inside
        else:
            a = _measure(x, inside)
            c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3] + (x[0] == "a")
    return c, t, lc, lt


def _density(node, whole, in_link):
    c, t, lc, lt = _measure(node, in_link)
    t, lt = max(1, t), max(1, lt)
    base = math.log(c / max(1, c - lc) * lc + whole[2] / max(1, whole[0]) * c + math.e)
    return c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(max(base, 1.0000001)) if c else 0.0


def test_density_sums_against_their_definition():
    import random

    rng = random.Random(5)
    chosen = 0
    for _ in range(300):
        page = _random_page(rng)
        whole = _measure(page)
        found = []  # (density sum, characters) of the nodes in page order

        def walk(node, in_link=False):
            place = len(found)
            found.append(None)
            inner = in_link or node[0] == "a"
            below = [walk(x, inner) for x in node[1] if not isinstance(x, str)]
            own = _density(node, whole, in_link)
            found[place] = (sum(below) or own, _measure(node)[0], node)
            return own

        walk(page)
        tree = html_extract.Tree(_markup(page))
        own = [0] * len(tree.parent)
        for node, text in tree.content:
            own[node] += len("".join(text.split()))
        alive = [True] * len(own)
        chars, density = html_extract.densities(tree, own, alive, tree.body)
        total = [0.0] * len(own)
        for i in range(len(own) - 1, 0, -1):
            total[tree.parent[i]] += density[i]
        assert [c for c in chars[1:]] == [x[1] for x in found]
        assert np.allclose([t or d for t, d in zip(total[1:], density[1:], strict=True)], [x[0] for x in found])
        best = max(range(len(found)), key=lambda i: (found[i][0], -i))
        roots = html_extract.main_nodes(tree, chars, density, alive, tree.body)
        if best:
            chosen += 1
            inside = set(roots)
            for i in range(len(own)):
                if tree.parent[i] in inside:
                    inside.add(i)
            up = best + 1
            while up not in inside and tree.tag[up] in html_extract.INLINE:
                up = tree.parent[up]
            assert up in inside
    assert chosen > 50


def test_names_only_annotate():
    p = "<p>" + "Words of the article that go on for a while. " * 4 + "</p>"
    text = " ".join(["Words of the article that go on for a while."] * 4)
    e = html_extract.extract
    assert e(f"<article>{p}<p class='notice'>This is part of it, too.</p>{p}</article>") == f"{text} This is part of it, too. {text}"
    for name in ("article-share", "post-navigation", "content-newsletter", "ad", "related-posts", "commentList"):
        assert e(f"<article>{p}<div class='{name}'>leave this out</div>{p}</article>") == f"{text} {text}"
    assert e(f"<div class='menu-open has-sidebar'><h1>Head</h1>{p}{p}</div>") == f"Head {text} {text}"
    assert e(f"<body><div class='comments'><article class='comment'>{p * 6}</article></div><article>{p}{p}</article>") == f"{text} {text}"
    assert e(f"<body><!-->{p}{p}") == f"{text} {text}"
    assert e(f"<article>{p}{p}</article><article>{p}{p}</article>") == " ".join([text] * 4)


def test_article_without_its_names():
    """Pages whose article, nav, footer and class names are taken away: density alone has to find the text."""
    import re

    import pandas as pd

    shares = []
    for page in pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"]:
        want = html_extract.extract(page).split()
        assert want
        bare = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", page.replace(' class="ad"', ""))
        got = html_extract.extract(bare).split()
        both = (Counter(got) & Counter(want)).total()
        shares.append((both / max(1, len(got)), both / len(want)))
    precision, recall = np.mean(shares, axis=0)
    assert precision > 0.85 and recall > 0.95, (precision, recall)


@pytest.mark.parametrize("bad", ["<a x ", "<a x='", '<a x=">', "<!--", "<p><b>", "<body>", "<td>", "<li><p>", "<", "&", "<a class=", "<object><p>"])
def test_hostile_pages_take_linear_time(bad):
    import time

    began = time.time()
    html_extract.extract("<body>" + bad * 50_000)
    html_extract.extract("<body>" + "<div><b>" * 25_000 + "</x>" * 25_000 + bad)
    assert time.time() - began < 5


def test_packing_pads_one_sequence_of_a_shard_at_most(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "word " * int(rng.integers(0, 1500))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack_documents(df, *vocabulary(), shard=150)
    size = {r.sequence_id: (r.n, r.far) for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("far")).collect()}
    assert all(n == far and n <= 1024 for n, far in size.values())
    shards = -(-len(rows) // 150)
    assert sum(n & (n - 1) != 0 for n, _ in size.values()) <= shards
    parts = {}
    for r in out.collect():
        parts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for (_, total), pieces in parts.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == total
    assert len(parts) == len(rows)
    assert packing.halves(0) == [] and packing.halves(1023) == [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]


def test_recall_of_the_index_on_the_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
        ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
        got: dict = {}
        for r in multi_index.nearest(df).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        hits = asked = 0
        for q in np.flatnonzero(ids % 100 == 0):
            far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            far[q] = np.inf
            best = sorted(zip(far, ids, strict=True))[:10]
            mine = sorted(got[ids[q]])
            hits += len({i for _, i, _ in mine} & {i for _, i in best})
            asked += 10
            assert [m[0] for m in mine] == list(range(1, 11)) and [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        assert hits >= 0.9 * asked, (sf, hits, asked)


def test_warc_with_repeated_and_null_keys(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (2, "u", "b"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.payload_bytes, r.problem) for r in warc.archive_round_trip(df).collect())
    assert got == sorted((str(i), len(h or ""), None) for i, _, h in rows)


def test_mix_columns_against_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    sql = f"""with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from '{path}')
    select doc_id, size, sum(size) over (partition by source)::bigint as source_size, source from s"""
    want = duckdb.sql(sql.replace("\\\\", "\\")).fetchall()
    out = mixing.mix(spark.read.parquet(path), carry=["doc_id", "source"]).collect()
    assert sorted((r._row.doc_id, r["size"], r.source_size) for r in out) == sorted(x[:3] for x in want)
    sizes = {source: total for _, _, total, source in want}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, shared_targets([sizes[n] for n in names]), strict=True))
    for name in names:
        mine = [r for r in out if r._row.source == name]
        assert math.isclose(mine[0].target, goals[name]) and all(r.taken <= 3 * r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - goals[name]) <= 0.005 * goals[name]


def test_archives_of_any_name_and_with_a_hot_payload(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "hot" if i % 3 else f"page {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    warc.write_warc(df, f"file://{tmp_path}/written", records=50)
    there = tmp_path / "other"
    there.mkdir()
    for n, file in enumerate(sorted((tmp_path / "written").glob("part-*"))):
        name = there / f"crawl-{n:05d}.warc"
        if n % 2:
            name.write_bytes(gzip.decompress(file.read_bytes()))
        else:
            name.with_suffix(".warc.gz").write_bytes(file.read_bytes())
    got = {r.page_id: r for r in warc.read_payloads(spark, f"file://{there}").collect()}
    assert len(got) == 300
    for page, _, html in rows:
        again = bool(page % 3) and page != 1
        assert (got[page].payload_bytes, got[page].record_type, got[page].refers_to, got[page].problem) == (len(html), "revisit" if again else "response", 1 if again else None, None)
