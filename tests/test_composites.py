import json
import urllib.parse

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from litmetrics import cli
from litmetrics.functions.text import seeded
from litmetrics.operators import hybrid, lookup, sampling
from litmetrics.plans import dataset, pipelines
from litmetrics.sources import files, rest


def test_ranks_in_ranges_are_the_ranks_of_a_window(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"), F.lit("x").alias("_keep")).repartition(5)
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(seeded(F.col("id"), F.lit(9)), "id")))
    got = sampling._rank(df, ["g"], "id", 9, "r")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    places = sampling.shuffled(df, "id", 1)
    assert sorted(r.place for r in places.collect()) == list(range(1, 3001))
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", "c")], "x string, y string")
    assert sorted(map(str, sampling.numbered(rows, "n").drop("n").collect())) == sorted(map(str, rows.collect()))
    assert sorted(r.n for r in sampling.numbered(rows, "n").collect()) == [1, 2, 3]


def served(answers, log):
    """Answers in turn, and what was asked."""
    left = list(answers)

    def transport(url, body=None, headers=None):
        log.append((dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query)), body, headers))
        code, answer = left.pop(0)
        return code, answer if isinstance(answer, str) else json.dumps(answer)

    return transport


def test_requests_say_who_asks_and_drop_a_refused_key():
    log = []
    assert rest.get("http://x", {"a": "1"}, served([(200, {"ok": 1})], log), key="K", mailto="m@x") == {"ok": 1}
    assert log[0][0] == {"a": "1", "api_key": "K", "mailto": "m@x"}
    log.clear()
    send = rest.with_key("K", served([(200, {"n": 1}), (403, "no"), (200, {"n": 2}), (200, {"n": 3})], log))
    assert [rest.request("http://x", {}, None, send)["n"] for _ in range(3)] == [1, 2, 3]
    assert [h for _, _, h in log] == [{"x-api-key": "K"}, {"x-api-key": "K"}, {}, {}]
    with pytest.raises(rest.BudgetExceeded):
        rest.get("http://x", {}, served([(429, "daily budget used")], []))


def test_batches_samples_and_bodies():
    log = []
    found = dict(rest.by_ids("http://x/batch", ["a", "b", "a", "c"], 2, "title", served([(200, [{"t": 1}, None]), (500, "later"), (200, [{"t": 3}])], log), pause=lambda s: None))
    assert found == {"a": {"t": 1}, "b": None, "c": {"t": 3}}
    assert [b for _, b, _ in log] == [{"ids": ["a", "b"]}, {"ids": ["c"]}, {"ids": ["c"]}]
    with pytest.raises(RuntimeError):
        list(rest.by_ids("http://x", ["a", "b"], 2, None, served([(200, [{}])], [])))
    log.clear()
    pages = [(200, {"results": [1, 2, 3]}), (200, {"results": [4, 5, 6]})]
    assert list(rest.sample("http://x", {"filter": "f"}, 5, 42, served(pages, log))) == [1, 2, 3, 4, 5]
    assert [q["page"] for q, _, _ in log] == ["1", "2"] and log[0][0]["sample"] == "5"


def test_reader_needs_an_address(spark):
    with pytest.raises(ValueError):
        rest.PagedReader({"entities": "a"})


def test_find_author_takes_the_one_with_most_works(spark):
    df = spark.createDataFrame([(1, "Li Wei", 5), (2, "Wei Li", 9), (3, "Li Wei", 9), (4, "Other", 99)], "id long, name string, works long")
    got = lookup.find_author(df, "li WEI").collect()
    assert [(r.id, r.chosen) for r in sorted(got, key=lambda r: (-r.works, r.id))] == [(2, True), (3, False), (1, False)]
    assert lookup.find_author(df, "nobody").count() == 0
    assert lookup.by_ids(df, spark.createDataFrame([(1,), (7,), (1,)], "w long"), "id").count() == 2


def work(i, title, venue, year, kind="article", words=60):
    return {
        "id": f"https://index.org/W{i}", "title": title, "doi": f"https://doi.org/10.1/{i}", "abstract_inverted_index": {f"w{k}": [k] for k in range(words)},
        "authorships": [{"author": {"id": "A1", "display_name": "Li Wei"}, "institutions": []}], "primary_location": {"source": {"id": f"https://index.org/{venue}", "display_name": venue}},
        "cited_by_count": i, "referenced_works_count": 2, "publication_year": year, "type": kind,
    }


def works():
    out = [work(i, f"A Survey of Topic {i}", "S1", 2010 + i % 3) for i in range(6)]
    out += [work(100 + i, f"Fast Routing {i}", "S2", 2010 + i % 5) for i in range(20)]
    out += [work(200, "An Overview of Routing", "S2", 2011), work(201, "Fast Routing 1", "S2", 2011), work(202, "Short", "S2", 2011, words=5), work(203, "A Survey of Topic 1", "S2", 2011, "editorial"), work(300, "Elsewhere", "S3", 2011)]
    return out


def test_dataset_is_balanced_by_year_and_sets_hard_cases_aside(spark):
    raw = spark.createDataFrame([(json.dumps(w),) for w in works()], "record string")
    venues = spark.createDataFrame([("S1", "Surveys", "g", 0), ("S2", "Journal", "g", 1)], "source string, Venue string, Group string, Label int")
    rows = pipelines.works_from_json(raw, keep_source=True)
    gone = spark.createDataFrame([("asurveyoftopic0",)], "k string")
    built, hard = dataset.build(rows, venues, [gone], ["g"])
    got = built.collect()
    assert sorted(r.Title for r in got if r.Label == 0) == [f"A Survey of Topic {i}" for i in range(1, 6)]
    years = lambda label: sorted(r.Year for r in got if r.Label == label)
    assert years(0) == years(1)
    assert sorted(r.Place for r in got) == list(range(1, len(got) + 1))
    assert sorted(r.Title for r in hard.collect()) == ["A Survey of Topic 1", "An Overview of Routing"]
    assert all(r.Abstract.startswith("w0 w1 ") and r.DOI for r in got)
    assert {r.Route for r in dataset.routed(dataset.labelled_rows(rows, venues)).collect()} == {"kept", "hard case", "unusable"}


def labelled_csv(spark, path, n=120):
    rows = [(str(i), f"A survey of field {i}" if i % 2 else f"Fast routing {i}", "this survey reviews the field " * 8 if i % 2 else "we propose a scheme that outperforms " * 8, "0" if i % 2 else "1") for i in range(n)]
    files.write_csv(spark.createDataFrame(rows, "id string, Title string, Abstract string, Label string"), path)


def test_hybrid_is_fitted_saved_loaded_and_used(spark, tmp_path, capsys):
    labelled_csv(spark, f"{tmp_path}/labelled")
    assert cli.main(["train", "--dataset", f"{tmp_path}/labelled", "--output-dir", f"{tmp_path}/model"]) == 0
    model, scorer = cli.load_models(spark, f"{tmp_path}/model")
    frame = spark.createDataFrame([("1", "A survey of things", "this survey reviews the field " * 8, "IEEE Network", "article", "5"), ("2", "Fast coding", "we propose a scheme that outperforms " * 8, "V", "article", "50"), ("3", "Some book", "x " * 30, "V", "book", None)], "id string, title string, abstract string, venue string, type string, citationCount string")
    assert {r.id: r.Category for r in pipelines.classify(frame, model=model, scorer=scorer).collect()} == {"1": "survey", "2": "research", "3": "non-paper"}
    assert {r.id: r.Category for r in pipelines.classify(frame, scorer=scorer).collect()} == {"1": "survey", "2": "research", "3": "non-paper"}
    assert len(model.mean) == 11 + len(scorer.weights.head) - 1 and len(scorer.losses) > 2
    files.write_csv(frame, f"{tmp_path}/profile")
    assert cli.main(["classify", "--input", f"{tmp_path}/profile", "--output", f"{tmp_path}/kept", "--surveys", f"{tmp_path}/out", "--model", f"{tmp_path}/model"]) == 0
    assert [r.id for r in files.read_csv(spark, f"{tmp_path}/kept").collect()] == ["2"]
    assert cli.main(["evaluate", "--eval-set", f"{tmp_path}/labelled", "--model", f"{tmp_path}/model", "--authors", f"{tmp_path}/profile/*.csv", "--comparison", f"{tmp_path}/profile/*.csv", "--report", f"{tmp_path}/report"]) == 0
    text = open(f"{tmp_path}/report/report.md").read()
    assert all(f"## {x}" in text for x in ("Methods", "Authors", "Methods by author", "Cohorts")) and "Learned hybrid" in text
    tables = json.load(open(f"{tmp_path}/report/tables.json"))
    assert next(r for r in tables["Methods"] if r["method"] == "Text model")["f1"] == 1.0
    assert next(r for r in tables["Methods"] if r["method"] == "Learned hybrid")["f1"] == 1.0
    assert {r["method"] for r in tables["Cohorts"]} == {"Main", "Keyword only", "Title phrases", "Indexer type", "Strict phrases"}


def test_training_again_only_the_hybrid(spark, tmp_path, capsys):
    labelled_csv(spark, f"{tmp_path}/labelled")
    labelled_csv(spark, f"{tmp_path}/others", 60)
    train = ["train", "--dataset", f"{tmp_path}/labelled", "--labelled", f"{tmp_path}/others", "--output-dir", f"{tmp_path}/model"]
    assert cli.main(train) == 0
    first = cli.load_models(spark, f"{tmp_path}/model")
    assert "text model: " in capsys.readouterr().out
    assert cli.main([*train, "--hybrid-only"]) == 0
    again = cli.load_models(spark, f"{tmp_path}/model")
    assert "text model: " not in capsys.readouterr().out
    assert first[0].coefficients == pytest.approx(again[0].coefficients) and (first[1].weights.table == again[1].weights.table).all()
    assert cli.load_models(spark, None) == (None, None)


def test_out_of_fold_metrics(spark):
    rows = [(i, f"A survey of field {i}" if i % 2 else f"Fast routing {i}", "this survey reviews " * 10 if i % 2 else "we propose a scheme " * 10, 0, "", "", "0" if i % 2 else "1", 0.9 if i % 2 else 0.1) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, Title string, Abstract string, ReferenceCount long, Venue string, Type string, Label string, proba double")
    assert pipelines.cross_validated(df, reps=1, outer=2, inner=2, grid=(1.0,)).first().f1 == 1.0


def test_commands_from_fixtures(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "A1-first.json").write_text(json.dumps({"results": works()[:4], "meta": {"next_cursor": "c2"}}))
    (folder / "A1-c2.json").write_text(json.dumps({"results": works()[4:7], "meta": {"next_cursor": None}}))
    assert cli.main(["extract", "--fixtures", str(folder), "--author", "A1", "--output", f"{tmp_path}/profile"]) == 0
    got = files.read_csv(spark, f"{tmp_path}/profile").collect()
    assert len(got) == 7 and all(r.abstract and r.venue and r.doi for r in got)
    record = {"paperId": "p1", "title": "T", "abstract": None, "authors": [{"name": "A"}, {"name": "B"}], "citationCount": 3, "references": [{"paperId": "r1"}, {"paperId": None}, {"paperId": "r2"}], "venue": "V", "year": 2020, "publicationTypes": ["Review"]}
    (folder / "B1-0.json").write_text(json.dumps({"data": [record], "next": 1000}))
    (folder / "B1-1000.json").write_text(json.dumps({"data": [record | {"paperId": "p2", "title": "U", "references": None, "publicationTypes": None}]}))
    types = spark.createDataFrame([("p2", "article")], "id string, type string")
    files.write_csv(types, f"{tmp_path}/types")
    assert cli.main(["extract", "--source", "scholar", "--fixtures", str(folder), "--author", "B1", "--types", f"{tmp_path}/types", "--output", f"{tmp_path}/records"]) == 0
    rows = {r.id: r for r in files.read_csv(spark, f"{tmp_path}/records").collect()}
    assert rows["p1"].references == "r1; r2" and rows["p1"].authors == "A; B" and rows["p2"].type == "article"
    (tmp_path / "works.jsonl").write_text("\n".join(json.dumps(w) for w in works()))
    files.write_csv(spark.createDataFrame([("S1", "Surveys", "g", "0"), ("S2", "Journal", "g", "1")], "source string, Venue string, Group string, Label string"), f"{tmp_path}/venues")
    assert cli.main(["build-dataset", "--works", f"{tmp_path}/works.jsonl", "--venues", f"{tmp_path}/venues", "--exclude", f"{tmp_path}/records", "--output", f"{tmp_path}/data", "--hard-cases", f"{tmp_path}/hard"]) == 0
    assert {r.Label for r in files.read_csv(spark, f"{tmp_path}/data").collect()} == {"0", "1"}
    assert files.read_csv(spark, f"{tmp_path}/hard").count() == 2
