import json
import math
from re import _parser as sre_parse

import pytest
from pyspark.sql import functions as F

from litmetrics import report
from litmetrics.functions import text as X
from litmetrics.functions import vocabulary as V
from litmetrics.operators import baselines, features, hybrid, indices, matching, metrics, profiles, rules, sampling, scoring, verification
from litmetrics.plans import composites, pipelines, registry  # noqa: F401 - composites registers its queries
from litmetrics.sources import files, rest


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [(None, ""), ("Abstract: hello", "hello"), ("a <b>x</b> $y^2$ \\emph{z} [1] {2}", "a x 1 2"), ("<tex-math>\na\n</tex-math>t", "t"), ("a \n b", "a b")])
def test_clean_text(spark, raw, want):
    assert one(spark, X.clean_text(F.lit(raw))) == want


def test_record_cleaner_keeps_lines_after_a_notice(spark):
    assert one(spark, X.clean_record_text(F.lit("a (c) 2020\nb"))) == "a (c) 2020 b"
    assert one(spark, X.clean_record_text(F.lit("a\nb Copyright 2020"))) == "a b"


def test_keys_and_counts(spark):
    assert one(spark, X.norm_title(F.lit("A-b Ü 3"))) == "ab3"
    assert one(spark, X.unicode_title(F.lit("A-b Ü 3"))) == "abü3"
    assert one(spark, X.item_count(F.lit("a; b; ; c"))) == 3
    assert [one(spark, X.word_count(F.lit(t))) for t in ("", " a  b ", None)] == [0, 2, 0]
    assert one(spark, X.paper_text(F.lit("T"), F.lit(""))) == "T" and one(spark, X.paper_text(F.lit("T"), F.lit("A"))) == "T. A"
    assert one(spark, X.rebuild_abstract(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))))) == "a b a"


def test_cues(spark):
    assert not one(spark, X.keyword_is_survey(F.lit("Reviewer of"))) and one(spark, X.keyword_is_survey(F.lit("A Review of")))
    magazine = lambda v: one(spark, F.lit(v).rlike(f"(?iU){V.MAGAZINES}"))
    assert magazine("IEEE Network") and not magazine("IEEE Wireless Communications Letters")
    for kind, want in {"book-chapter": True, "BookSection": True, "JournalArticle; Editorial": True, "dataset": True, "JournalArticle; Review": False, "conference-paper": False, "preprint": False}.items():
        assert one(spark, rules.is_non_paper(F.lit(""), F.lit(kind))) == want


@pytest.mark.parametrize(("title", "abstract", "venue", "kind", "flag", "want"), [
    ("A survey", "word " * 20, "V", "article", True, "survey"), ("Routing", "word " * 20, "V", "article", False, "research"), ("X", "word " * 20, "V", "book", True, "non-paper"),
    ("Guest Editorial: x", "word " * 20, "V", "article", True, "non-paper"), ("Routing", "", "", "", True, "research"), ("A survey", "", "", "", False, "survey"), ("Routing", "", "V", "", True, "survey"),
])
def test_decision_rules(spark, title, abstract, venue, kind, flag, want):
    assert one(spark, rules.categorize(*map(F.lit, (title, abstract, venue, kind, flag)))) == want


@pytest.mark.parametrize(("cites", "h", "i10"), [([10, 8, 5, 4, 3], 4, 1), ([25, 8, 5, 3, 3], 3, 1), ([3, 3, 3], 3, 0), ([100], 1, 1), ([0, 0], 0, 0), ([3, None, 10, 5, 4, 8], 4, 1)])
def test_h_index(spark, cites, h, i10):
    df = spark.createDataFrame([("a", None if c is None else float(c)) for c in cites], "author string, citationCount double")
    r = indices.h_index(df, ["author"]).first()
    assert (r.h_index, r.i10_index, r.papers) == (h, i10, len(cites))
    assert indices.h_index(df.filter("false"), ["author"]).count() == 0


@pytest.mark.parametrize(("q", "c", "tpr", "fpr", "papers", "cites"), [(0.10, 0.30, 1.0, 0.0, 0.10, 0.30), (0.168, 0.5, 0.8, 0.01, 0.2, None), (0.005, 0.1, 0.8, 0.01, 0.0, None)])
def test_corrected_shares(spark, q, c, tpr, fpr, papers, cites):
    got = [one(spark, x) for x in metrics.corrected_shares(*map(F.lit, (q, c, tpr, fpr)))]
    assert got[0] == pytest.approx(papers) and (cites is None or got[1] == pytest.approx(cites))


def test_weighted_metrics_and_thresholds(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 0, 1.0), (0, 1, 3.0), (0, 0, 1.0)], "y int, p int, w double")
    r = metrics.weighted(df, [], F.col("y"), F.col("p"), F.col("w")).first()
    assert (r.precision, r.recall) == (0.25, 0.5) and r.f1 == pytest.approx(1 / 3)
    s = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    best = metrics.best_threshold(metrics.threshold_sweep(s, F.col("y"), F.col("s"), F.lit(1.0))).first()
    assert 0.2 < best.t <= 0.8 and best.f1 == 1.0


def test_versions_and_merge(spark):
    rows = [(1, "Same", "preprint", 9.0), (2, "same!", "article", 9.0), (3, "Обзор", "article", 1.0), (4, "", "article", 1.0), (5, None, "article", 1.0), (6, "Ж", "article", 2.0)]
    df = spark.createDataFrame(rows, "id long, title string, type string, citationCount double")
    assert sorted(r.id for r in profiles.merge_versions(df).collect()) == [2, 6]
    assert sorted(r.id for r in profiles.merge_versions(df, strict=True).collect()) == [2, 3, 6]
    a = spark.createDataFrame([("T", "long abstract", "x", "3", "", "2001", "article; Review")], "title string, abstract string, authors string, citationCount string, venue string, year string, type string")
    b = spark.createDataFrame([("t.", "a", "", "7", "V", "bad", "preprint", "r1; r2")], "title string, abstract string, authors string, citationCount string, venue string, year string, type string, references string")
    r = profiles.combine({"A": a, "B": b}).first()
    assert (r.title, r.abstract, r.authors, r.citationCount, r.ReferenceCount, r.venue, r.year, r.type, r.Sources) == ("t.", "long abstract", "x", 7, 2, "V", 2001, "Review; article; preprint", "A, B")


def test_samples(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("s"))
    few = sampling.per_stratum(df, "s", 10, "id", 1)
    assert few.count() == 30 and {r.StratumWeight for r in few.collect()} == {3.4, 3.3}
    split = {(r.s, r.Split): r["count"] for r in sampling.split(df, "s", "id", 1).groupBy("s", "Split").count().collect()}
    assert split[0, "test"] == 7 and split[0, "val"] == 3 and split[0, "train"] == 24
    draws = sampling.bootstrap_draws(df, ["s"], "id", 5, 3).groupBy("rep", "s").count().collect()
    assert all(r["count"] == (34 if r.s == 0 else 33) for r in draws) and len(draws) == 15


def test_matching(spark):
    refs = spark.createDataFrame([(1, "exactkey"), (2, "x" * 20), (3, "short")], "ref long, k string")
    prof = spark.createDataFrame([(10, "exactkey", 1), (11, "exactkeymore", 9), (12, "x" * 25, 4), (13, "x" * 22, 5), (14, "shorter", 1)], "id long, k string, c long")
    got = {r.ref: (r.id, r.exact) for r in matching.prefix_match(refs, prof, "ref", "k", "k", "c", "id").collect()}
    assert got == {1: (10, 1), 2: (13, 0)}
    assert one(spark, rules.same_person(F.lit("Jean-Paul Roe"), F.lit("J. Roe"))) and not one(spark, rules.same_person(F.lit("Ann Roe"), F.lit("Bob Roe")))


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "Deep nets, deep nets"), (2, "a deep net"), (3, None)], "id long, text string")
    got = {(r.id, r.term): r.weight for r in baselines.TfIdf.fit(df, F.col("text")).transform(df, "id", F.col("text")).collect()}
    assert got == {(1, "deep"): pytest.approx(1.0), (2, "deep"): pytest.approx(1.0)}
    every = baselines.TfIdf.fit(df, F.col("text"), min_df=1).transform(df, "id", F.col("text")).filter("id = 1").collect()
    common, rare = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    raw = {"deep": (1 + math.log(2)) * common, "nets": (1 + math.log(2)) * rare, "deep nets": (1 + math.log(2)) * rare, "nets deep": rare}
    size = math.sqrt(sum(v * v for v in raw.values()))
    assert {r.term: r.weight for r in every} == {k: pytest.approx(v / size) for k, v in raw.items()}


def test_svm_separates_topics(spark):
    rows = [(i, f"survey overview taxonomy item{i % 5}" if i % 2 else f"decoder circuit latency item{i % 5}", i % 2) for i in range(40)]
    df = spark.createDataFrame([*rows, (99, "", 0)], "id long, text string, y int")
    got = {r.id: r.p for r in baselines.tfidf_svm(df.filter("id < 20"), df.filter("id >= 20"), "id", F.col("text"), "y").collect()}
    assert len(got) == 21 and all(got[i] == i % 2 for i in range(20, 40))


def test_registered_models_use_the_whole_grid_and_all_folds(spark, sf_dir, monkeypatch):
    grids, jobs = [], []

    class Model:
        def predict(self, df):
            return df.selectExpr("*", "0.5 as hybrid_proba", "1 as is_survey")

    def fit_selected(df, key, stratum, fixed=None, k=5, seed=42, grid=hybrid.C_GRID):
        grids.append((k, grid))
        return Model()

    monkeypatch.setattr(hybrid, "fit_selected", fit_selected)
    registry.queries()["hybrid_fit"](spark, sf_dir)
    assert grids == [(5, (0.01, 0.1, 1.0))]
    monkeypatch.setattr(hybrid.logistic, "fit_all", lambda rows, k, grid, width, jobs, tasks: grids.append((k, grid, jobs)) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        registry.queries()["nested_cv"](spark, sf_dir)
    assert grids[1:] == [(5, (0.01, 0.1, 1.0), 50)]


def test_nested_cv_predicts_every_row_once(spark):
    rows = [(i, "s", [float((i * 7) % 20 - 10), float(i % 3)], float((i * 7) % 20 >= 10), 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, stratum string, features array<double>, y double, w double")
    got = hybrid.nested_cv(df, "id", "stratum", reps=1, outer=2, inner=2, grid=(1.0,)).collect()
    assert sorted(r.id for r in got) == list(range(60)) and sum(r.pred == rows[r.id][3] for r in got) >= 57


def test_verification_edges(spark):
    refs = spark.createDataFrame([("a", "x" * 20), ("a", "short"), ("b", "none"), ("c", "y" * 25)], "author string, k string")
    prof = spark.createDataFrame([("a", "x" * 30), ("a", "shorter"), ("b", "none"), ("c", "y" * 24)], "author string, k string")
    assert {r.author: (r.found, r.total) for r in verification.coverage(refs, prof, "author", "k").collect()} == {"a": (1, 2), "b": (1, 1), "c": (0, 1)}
    table = spark.createDataFrame([("a", "S2", 3), ("a", "OA", 9), ("b", "OA", 1), ("b", "X", 1)], "author string, source string, found int")
    assert {r.author: r.source for r in verification.preferred_source(table, "author", "source", "S2").collect()} == {"a": "S2", "b": "OA"}
    assert verification.agreement(table.filter("false").selectExpr("author", "'S' as t", "source as c", "true as seen"), "author", "t", "c", "seen").count() == 0


def test_files_and_rest(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,abstract,citationCount\n"A ""survey""","two\nlines",3\nB,NA,\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"), provenance=True)
    assert [(r.title, r.abstract, r.citationCount, r.SourceFile) for r in df.collect()] == [('A "survey"', "two\nlines", "3", "a.csv"), ("B", None, None, "a.csv")]
    out = pipelines.classify(df)
    assert {r.title: r.Category for r in out.collect()} == {'A "survey"': "survey", "B": "research"}
    answers = iter([(500, ""), (200, "{}")])
    assert rest.get("u", {}, lambda _: next(answers), pause=lambda _: None) == {}
    with pytest.raises(rest.BudgetExceeded):
        rest.get("u", {}, lambda _: (429, "daily budget"))
    with pytest.raises(RuntimeError):
        rest.get("u", {}, lambda _: (404, ""))
    fixtures = tmp_path / "fx"
    fixtures.mkdir()
    (fixtures / "A1-first.json").write_text(json.dumps({"results": [{"id": "https://x.org/W1", "title": "T"}], "meta": {"next_cursor": "n"}}))
    (fixtures / "A1-n.json").write_text(json.dumps({"results": [], "meta": {"next_cursor": "m"}}))
    spark.dataSource.register(rest.PagedSource)
    raw = spark.read.format("paged_rest").options(entities="A1", fixtures=str(fixtures)).load()
    assert [r.id for r in pipelines.works_from_json(raw).collect()] == ["W1"]


def test_report(spark):
    assert report.share(0.117, 0.1, 0.15) == "11.7% (10-15)"
    assert report.markdown(spark.createDataFrame([("a", 0.25)], "m string, x double")).endswith("| a | 0.2 |")


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - {"rebuild_abstract", "paired_bootstrap"}))
def test_queries_agree_with_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    mine, theirs = registry.queries()[name](spark, sf_dir), con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    rows = lambda some, cols: sorted((tuple(str(plain(r[cols.index(c)])) for c in sorted(cols)) for r in some))
    assert rows([tuple(r) for r in mine.collect()], mine.columns) == rows(theirs.fetchall(), names)


def test_draws_are_the_same_with_and_without_a_small_side(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(40)], "id long, rare boolean")
    draws = lambda: sorted(tuple(r) for r in sampling.bootstrap_draws(df, ["rare"], "id", 120, 3).select("rep", "rare", "id").collect())
    small = draws()
    monkeypatch.setattr(sampling, "FEW", 0)
    assert draws() == small and len(small) == 120 * 40
    assert {(rep, sum(x[0] == rep and x[1] for x in small)) for rep in (1, 50, 51, 120)} == {(rep, 14) for rep in (1, 50, 51, 120)}
    assert len({tuple(x[2] for x in small if x[0] == rep) for rep in range(1, 121)}) == 120


def test_index_from_one_sort(spark, sf_dir):
    """Words and places of a document, of two rows with one key too; only the texts are shuffled."""
    df = spark.createDataFrame([(1, ["b a  b", "a"]), (2, [""]), (3, [])], "id int, t array<string>")
    got = {r.id: r.m for r in df.select("id", X.inverted_index(F.col("t")).alias("m")).collect()}
    assert got == {1: {"a": [0, 1], "b": [0, 2]}, 2: None, 3: None}
    assert registry.rebuild_abstract(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_cues_of_probability_and_features_are_counted_once(spark):
    texts = [("A Survey", "We review this survey. " * 5), ("x", None), ("A review of", "we propose; the proposed scheme"), ("b", "w " * 9), ("b", " w " * 10)]
    df = spark.createDataFrame([(i, t, a, 3, "v", "article") for i, (t, a) in enumerate(texts)], "id int, Title string, Abstract string, ReferenceCount long, Venue string, Type string")
    once = features.hybrid_features(df, None, keep=("id",))
    apart = features.hybrid_features(df.withColumn("proba", scoring.cue_score(F.col("Title"), F.col("Abstract"))), "proba", keep=("id",))
    assert once.collect() == apart.collect()
    assert once._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2


def test_words_and_blanks_without_a_copy(spark):
    texts = ["", " ", "a", "a b", " a  b", "a b c", "a \t b", "a\tb", "\n a b\n\nc ", "　a b", "x" * 200_000]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for n in (1, 2, 3):
        assert all(r.a == r.b for r in df.select(X.has_words(F.col("t"), n).alias("a"), (X.word_count(F.col("t")) >= n).alias("b")).collect())
    assert all(r.a == r.b for r in df.select(X.collapse(F.col("t")).alias("a"), F.trim(F.regexp_replace("t", r"(?U)\s+", " ")).alias("b")).collect())


def test_hybrid_fit_predicts_from_the_features_it_was_fitted_on(spark, sf_dir, monkeypatch):
    class Model:
        def predict(self, df):
            return df.selectExpr("*", "0.5 as hybrid_proba", "1 as is_survey")

    monkeypatch.setattr(hybrid, "fit_selected", lambda df, key, stratum: Model())
    plan = registry.queries()["hybrid_fit"](spark, sf_dir)._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan


def test_abstracts_are_read_only_where_venue_and_type_are_blank(spark):
    df = spark.createDataFrame([("v", ""), (" ", "t"), ("v", None)], "venue string, type string")
    long = F.concat("venue", F.raise_error(F.lit("read")).cast("string"))
    assert [r.x for r in df.select(rules.has_no_metadata(long, F.col("venue"), F.col("type")).alias("x")).collect()] == [False] * 3
    assert one(spark, rules.has_no_metadata(F.lit("a b"), F.lit(" "), F.lit(None))) and not one(spark, rules.has_no_metadata(F.lit("a " * 10), F.lit(" "), F.lit(None)))


def test_stems_are_in_all_that_the_expressions_match(spark):
    def words(alternatives):
        """All that an expression of literals, groups and question marks matches."""
        parsed = sre_parse.parse(alternatives)

        def of(items):
            out = [""]
            for op, arg in items:
                name = str(op)
                if name == "LITERAL":
                    found = [chr(arg)]
                elif name == "BRANCH":
                    found = [x for branch in arg[1] for x in of(branch)]
                elif name == "SUBPATTERN":
                    found = of(arg[-1])
                elif name == "IN":
                    found = [chr(x) for _, x in arg]
                else:
                    assert name == "MAX_REPEAT" and arg[:2] == (0, 1)
                    found = ["", *of(arg[2])]
                out = [a + b for a in out for b in found]
            return out

        return of(parsed)

    cues = [(V.ABSTRACT_SURVEY, V.ABSTRACT_SURVEY_STEMS), (V.ABSTRACT_RESEARCH, V.ABSTRACT_RESEARCH_STEMS), (V.THIS_ARTICLE, V.THIS_ARTICLE_STEMS)]
    for alternatives, stems in cues:
        every = words(alternatives)
        assert len(every) > 1 and all(any(s in x for s in stems) for x in every)
        texts = [f(x) for x in every for f in (str, str.upper, lambda x: f"é {x.replace('s', 'ſ').replace('k', 'K')}. {x}", lambda x: x.replace("i", "İ"), lambda x: x.replace("i", "ı"), lambda x: f"x{x}")]
        df = spark.createDataFrame([(t,) for t in [*texts, "", None, "none of them"]], "t string")
        got = df.select(X.capped_count(F.col("t"), alternatives, stems=stems).alias("n"), X.capped_count(F.col("t"), alternatives).alias("m"), X.has(F.col("t"), alternatives, stems).alias("h"), X.has(F.col("t"), alternatives).alias("g"))
        rows = got.collect()
        assert all(r.n == r.m and r.h == r.g for r in rows) and {0, 1, 2} <= {r.n for r in rows}
    every = spark.range(128, 0x110000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert sorted(r.c for r in every.filter("c rlike '(?iU)^[a-z]$'").collect()) == sorted(X.FOLDED)


def test_cues_are_searched_plainly_first(spark, sf_dir):
    rows = profiles.normalize(registry.papers(spark, sf_dir), keep=("id",))
    plan = features.hybrid_features(rows, None, keep=("id",))._jdf.queryExecution().optimizedPlan().toString()
    assert all("Contains(" in plan and s in plan for s in (*V.ABSTRACT_SURVEY_STEMS, *V.ABSTRACT_RESEARCH_STEMS, *V.THIS_ARTICLE_STEMS))
    assert V.MARKUP in plan
