"""Registered queries and the SQL that gives the same results in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import baselines, features, hybrid, indices, matching, metrics, profiles, resampling, rules, sampling, scoring, verification
from . import evaluation, pipelines
from .papers import papers, papers_sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_impact(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL building blocks --------------------------------------------------------------------------------------------------

P = f"p as ({papers_sql()})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_sql(c: str) -> str:
    for pattern in V.CUT_MARKUP:
        c = f"regexp_replace({c}, {q(pattern)}, ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({c}, {q('(?i)' + V.CUT_HEADING)}, ''), {q(r'\s+')}, ' ', 'g'))"


def text_sql(c: str) -> str:
    return f"coalesce({c}, '')"


def has_sql(c: str, words: str) -> str:
    return f"regexp_matches({c}, {q('(?i)' + V.word_bound(words))})"


def count_sql(c: str, words: str) -> str:
    return f"least(len(regexp_extract_all({c}, {q('(?i)' + V.word_bound(words))})), 3)::bigint"


def words_sql(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '\S+'))::bigint"


def key_sql(c: str) -> str:
    return f"regexp_replace(lower({text_sql(c)}), '[^a-z0-9]', '', 'g')"


CT, CA = clean_sql(text_sql("title")), clean_sql(text_sql("abstract"))
NON_PAPER = f"({has_sql(CT, V.NON_PAPER_TITLES)} or {has_sql(text_sql('type'), V.NON_PAPER_TYPES)})"
BARE = f"({words_sql(text_sql('abstract'))} < 10 and trim({text_sql('venue')}) = '' and trim({text_sql('type')}) = '')"
CATEGORY = f"case when {NON_PAPER} then 'non-paper' when case when {BARE} then {has_sql(CT, V.TITLE_KEYWORDS)} else proba >= 0.5 end then 'survey' else 'research' end"
TOOL = f"regexp_matches({text_sql('title')}, {q('(?i)(?:' + V.TITLE_TOOL_PHRASES + ')')})"
STRICT = f"({has_sql(text_sql('type'), V.REVIEW_TYPES)} and ({has_sql(CT + " || ' ' || " + CA, V.STRICT_PHRASES)} or regexp_matches({text_sql('venue')}, {q('(?i)(?:' + V.REVIEW_VENUES + ')')})))"
INDEXER = has_sql(text_sql("type"), "review")
KEYWORD = has_sql(CT, V.TITLE_KEYWORDS)


def norm(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return profiles.normalize(papers(spark, sf_dir), keep=keep)


def category() -> F.Column:
    return rules.categorize(F.col("title"), F.col("abstract"), F.col("venue"), F.col("type"), F.col("proba") >= 0.5)


def h_sql(source: str, by: str, cites: str, where: str = "true") -> str:
    """h-index by ranking rows, as the definition says."""
    return f"""select {by}, count(*)::bigint as papers, coalesce(sum(c), 0)::bigint as citations, count(*) filter (c >= rn)::bigint as h_index, count(*) filter (c >= 10)::bigint as i10_index
from (select *, row_number() over (partition by {by} order by c desc) as rn from (select *, coalesce({cites}, 0)::bigint as c from {source} where {where})) group by {by}"""


def impact_sql(source: str, by: str, cites: str, out: str) -> str:
    return f"""with {source}, a as ({h_sql('src', by, cites)}), b as ({h_sql('src', by, cites, f'not ({out})')})
select a.{by}, a.papers, a.papers - coalesce(b.papers, 0) as surveys, a.citations, coalesce(b.citations, 0) as citations_kept,
 100 * (a.papers - coalesce(b.papers, 0)) / greatest(1, a.papers)::double as papers_excluded,
 100 * (a.citations - coalesce(b.citations, 0)) / greatest(1, a.citations)::double as citation_reduction,
 a.h_index, coalesce(b.h_index, 0) as h_index_kept, a.h_index - coalesce(b.h_index, 0) as h_drop,
 100 * (coalesce(b.h_index, 0) - a.h_index) / greatest(1, a.h_index)::double as h_change,
 100 * (1 - coalesce(b.i10_index, 0) / greatest(1, a.i10_index)::double) as i10_reduction
from a left join b on a.{by} = b.{by}"""


# Text -----------------------------------------------------------------------------------------------------------------


@query(f"select page_id, {clean_sql(text_sql('html'))} as cleaned from pages")
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.clean_text(F.col("html")).alias("cleaned"))


@query(rf"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '(?i)^\s*abstract[:.\s-]*', ''), '(?i)(©|\(c\)|copyright)[^\n]*\n?$', ''), '\s+', ' ', 'g')) as cleaned from documents")
def clean_records(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_record_text(F.col("text")).alias("cleaned"))


@query(rf"with {P} select id, {key_sql('title')} as norm_key, regexp_replace(lower({text_sql('title')}), '[^\p{{L}}\p{{N}}]', '', 'g') as unicode_key, trim(regexp_replace(lower({text_sql('title')}), '\s+', ' ', 'g')) as spaced_key, {words_sql(text_sql('abstract'))} as words, case when {CA} <> '' then {CT} || '. ' || {CA} else {CT} end as paper_text from p")
def text_keys(spark, sf_dir):
    t = F.col("title")
    return papers(spark, sf_dir).select("id", X.norm_title(t).alias("norm_key"), X.unicode_title(t).alias("unicode_key"), X.spaced_title(t).alias("spaced_key"), X.word_count(F.col("abstract")).alias("words"), X.paper_text(t, F.col("abstract")).alias("paper_text"))


@query("""with w as (select doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) as w, generate_subscripts(list_filter(string_split(text, ' '), lambda x: x <> ''), 1) as p from documents)
select doc_id, string_agg(w, ' ' order by p) as abstract from w group by doc_id""")
def rebuild_abstract(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    index = texts.select("doc_id", X.inverted_index(F.col("texts")).alias("m")).filter("m is not null")
    return index.select("doc_id", X.rebuild_abstract(F.col("m")).alias("abstract"))


# Profiles -------------------------------------------------------------------------------------------------------------


@query(f"with {P} select id, {text_sql('title')} as Title, {text_sql('abstract')} as Abstract, len(list_filter(string_split(coalesce(\"references\", ''), ';'), lambda x: trim(x) <> ''))::bigint as ReferenceCount, {text_sql('venue')} as Venue, {text_sql('type')} as Type from p")
def normalize_profile(spark, sf_dir):
    return norm(spark, sf_dir, "id")


@query(f"with {P}, k as (select *, {key_sql('title')} as k from p where trim({text_sql('title')}) <> '') select id, title, type, citationCount from (select *, row_number() over (partition by k order by (lower({text_sql('type')}) = 'preprint')::int, coalesce(citationCount, 0) desc, id) as rn from k) where rn = 1")
def version_merge(spark, sf_dir):
    return profiles.merge_versions(papers(spark, sf_dir)).select("id", "title", "type", "citationCount")


@query(f"with k as (select doc_id, {key_sql('text')} as k from documents) select min(doc_id) as doc_id, count(*)::bigint as copies from k where k <> '' group by k")
def title_key_dedup(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", X.norm_title(F.col("text")).alias("k")).filter("k <> ''")
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query(f"""with {P}, s as (
 select {key_sql('title')} as k, {text_sql('title')} as title, {text_sql('abstract')} as abstract, {text_sql('authors')} as authors, {text_sql('venue')} as venue, {text_sql('type')} as type, coalesce(citationCount, 0)::bigint as c, year,
  len(list_filter(string_split(coalesce("references", ''), ';'), lambda x: trim(x) <> ''))::bigint as r, case when year < 2018 then 'OpenAlex' else 'Semantic Scholar' end as s from p),
o as (select *, row_number() over (partition by k order by c desc, s, title, abstract) as rn from s where k <> ''),
t as (select k, string_agg(distinct x, '; ' order by x) as type from (select k, trim(unnest(string_split(type, ';'))) as x from o) where x <> '' group by k)
select o.k as _key, arg_min(title, rn) as title, arg_min(abstract, (-length(abstract), abstract)) as abstract, coalesce(arg_min(authors, rn) filter (trim(authors) <> ''), '') as authors,
 max(c) as citationCount, max(r) as ReferenceCount, coalesce(arg_min(venue, rn) filter (trim(venue) <> ''), '') as venue, arg_min(year, rn) as year,
 coalesce(any_value(t.type), '') as type, string_agg(distinct s, ', ' order by s) as Sources
from o left join t on o.k = t.k group by o.k""")
def combine_profiles(spark, sf_dir):
    p = papers(spark, sf_dir)
    return profiles.combine({"OpenAlex": p.filter("year < 2018"), "Semantic Scholar": p.filter("year >= 2018")})


# Rules ----------------------------------------------------------------------------------------------------------------


@query(f"with {P} select id, {CATEGORY} as Category, {NON_PAPER} as non_paper, {BARE} as title_only, {KEYWORD} as keyword, {TOOL} as title_rule, {INDEXER} as type_rule, {STRICT} as strict_rule from p")
def decision_rules(spark, sf_dir):
    t, a, v, k = (F.col(c) for c in ("title", "abstract", "venue", "type"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return papers(spark, sf_dir).select("id", category().alias("Category"), rules.is_non_paper(t, k).alias("non_paper"), rules.has_no_metadata(blank(a), v, k).alias("title_only"), X.keyword_is_survey(t).alias("keyword"), rules.title_phrase_tool(t).alias("title_rule"), rules.indexer_is_review(k).alias("type_rule"), rules.strict_phrase_rule(t, a, v, k).alias("strict_rule"))


@query(f"""with {P}, r as (select case when {text_sql('title')} = '' then 'no title' when {words_sql(text_sql('abstract'))} < 50 then 'short abstract' when {has_sql(text_sql('title'), V.JUNK_TITLES)} then 'front matter'
 when {text_sql('type')} not in ('article') or {has_sql(text_sql('title'), V.TITLE_TERMS)} then 'hard case' else 'kept' end as reason from p) select reason, count(*)::bigint as n from r group by reason""")
def filter_reasons(spark, sf_dir):
    t, a, k = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "abstract", "type"))
    rows = matching.first_reason(papers(spark, sf_dir), {"no title": t == "", "short abstract": X.word_count(a) < V.MIN_WORDS_TRAIN, "front matter": X.has(t, V.JUNK_TITLES), "hard case": rules.is_hard_case(t, k)})
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {P}, r as (select *, len(list_filter(string_split(coalesce("references", ''), ';'), lambda x: trim(x) <> ''))::bigint as refs, least(greatest(proba, 1e-4), 1 - 1e-4) as pp from p)
select id, round(ln(pp / (1 - pp)), 9) as bert_logit, {has_sql(CT, V.TITLE_TERMS)}::int as title_terms, {count_sql(CA, V.ABSTRACT_SURVEY)} as abstract_survey_cues, {count_sql(CA, V.ABSTRACT_RESEARCH)} as abstract_research_cues,
 ({words_sql(CA)} < 10)::int as abstract_missing, round(case when refs > 0 then ln(1 + refs) else 0e0 end, 9) as log_refs, (refs <= 0)::int as refs_missing,
 regexp_matches({text_sql('venue')}, {q('(?i)' + V.MAGAZINES)})::int as magazine, contains(lower({text_sql('venue')}), 'arxiv')::int as arxiv, {INDEXER}::int as type_review, {has_sql(text_sql('abstract'), 'this (?:article|magazine)')}::int as this_article from r""")
def hybrid_features(spark, sf_dir):
    n = profiles.normalize(papers(spark, sf_dir), keep=("id", "proba"))
    n = features.cleaned(n)
    cols = features.base_features(F.col("_title"), F.col("_abstract"), F.col("ReferenceCount"), F.col("proba"), clean=True) | features.flag_features(F.col("Abstract"), F.col("Venue"), F.col("Type"))
    cols["bert_logit"], cols["log_refs"] = F.round(cols["bert_logit"], 9), F.round(cols["log_refs"], 9)
    return n.select("id", *[c.alias(k) for k, c in cols.items()])


_CUES = f"1 / (1 + exp(-(-2e0 + 3 * {has_sql(CT, V.TITLE_TERMS)}::int + {count_sql(CA, V.ABSTRACT_SURVEY)} - {count_sql(CA, V.ABSTRACT_RESEARCH)})))"


@query(f"""with {P}, s as (select *, {_CUES} as cue from p), c as (select id, round_even(cue, 4) as SurveyScore, {CATEGORY.replace('proba >= 0.5', 'cue >= 0.5')} as Category from s)
select id, Category, SurveyScore, Category <> 'survey' as Keep from c""")
def classify_profile(spark, sf_dir):
    return pipelines.classify(papers(spark, sf_dir)).select("id", "Category", "SurveyScore", "Keep")


# Indices --------------------------------------------------------------------------------------------------------------


@query(h_sql("lineitem", "l_suppkey", "l_quantity"))
def h_index_by_author(spark, sf_dir):
    return indices.h_index(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@query(impact_sql("src as (select * from lineitem)", "l_suppkey", "l_quantity", "l_returnflag = 'R'"))
def author_impact(spark, sf_dir):
    return indices.impact(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R", "l_quantity")


_PAPER_IMPACT = impact_sql(f"{P}, src as (select *, {CATEGORY} as cat from p)", "author", "citationCount", "cat = 'survey'")


@query(f"with t as ({_PAPER_IMPACT}), d as (select author, round(papers::double, 6) as papers, round(citation_reduction, 6) as citation_reduction, round(h_drop::double, 6) as h_drop from t) select * from d union all select 'Average', round(avg(papers::double), 6), round(avg(citation_reduction), 6), round(avg(h_drop::double), 6) from t")
def impact_average(spark, sf_dir):
    out = indices.with_average(indices.impact(papers(spark, sf_dir), "author", category() == "survey"), "author")
    return out.select("author", *[F.round(c, 6).alias(c) for c in ("papers", "citation_reduction", "h_drop")])


@query(f"""with {P}, m as (select author, citationCount, unnest(['Keyword only', 'Title phrases', 'Indexer type', 'Strict phrases']) as method, unnest([{KEYWORD}, {TOOL}, {INDEXER}, {STRICT}]) as o from p),
f as (select author, citationCount, method || '|' || author as g, method, o from m), a as ({h_sql('f', 'g', 'citationCount')}), b as ({h_sql('f', 'g', 'citationCount', 'not o')})
select split_part(a.g, '|', 1) as method, split_part(a.g, '|', 2) as author, 100 * (a.papers - coalesce(b.papers, 0)) / a.papers::double as excluded, 100 * (a.citations - coalesce(b.citations, 0)) / greatest(1, a.citations)::double as citations, a.h_index - coalesce(b.h_index, 0) as h_drop
from a left join b on a.g = b.g""")
def method_comparison(spark, sf_dir):
    flags = pipelines.method_flags(*(F.col(c) for c in ("title", "abstract", "venue", "type")))
    return indices.by_method(papers(spark, sf_dir), "author", flags)


@query("""with n as (select l_suppkey, p_name as name, count(*)::bigint as n from lineitem join part on l_partkey = p_partkey group by all)
select l_suppkey, name, n from (select *, row_number() over (partition by l_suppkey order by n desc, name) as rn from n) where rn = 1""")
def modal_name(spark, sf_dir):
    named = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return indices.modal_name(named, "l_suppkey", "p_name")


# Joins and selections -------------------------------------------------------------------------------------------------


@query(f"with {P}, t as (select distinct {key_sql('title')} as k from p where Label = '0') select id, {key_sql('title')} as k from p where {key_sql('title')} not in (select k from t)")
def exclude_train(spark, sf_dir):
    keyed = papers(spark, sf_dir).select("id", X.norm_title(F.col("title")).alias("k"), "Label")
    return matching.without_keys(keyed, "k", keyed.filter("Label = '0'").select("k")).select("id", "k")


@query(f"with {P}, k as (select id, Label, {key_sql('title')} as k from p where Label <> 'skip') select id, k, Label from k where k not in (select k from k group by k having count(distinct Label) > 1)")
def class_clash(spark, sf_dir):
    keyed = papers(spark, sf_dir).filter("Label <> 'skip'").select("id", X.norm_title(F.col("title")).alias("k"), "Label")
    return matching.without_clashes(keyed, "k", "Label").select("id", "k", "Label")


_KEYS = f"{P}, k as (select id, Label, year, {key_sql('title')} as k, coalesce(citationCount, 0)::bigint as c from p), r as (select id as ref, case when year % 3 = 0 then left(k, 24) else k end as r from k where Label = '0' and k <> '')"


@query(f"""with {_KEYS}, m as (select ref, id, (r = k)::int as exact, c from r join k on r = k or (length(r) >= 20 and starts_with(k, r)))
select ref, id, exact from (select *, row_number() over (partition by ref order by exact desc, c desc, id) as rn from m) where rn = 1""")
def prefix_match(spark, sf_dir):
    k = papers(spark, sf_dir).select("id", X.norm_title(F.col("title")).alias("k"), F.coalesce("citationCount", F.lit(0)).cast("long").alias("c"), "Label", "year")
    refs = k.filter("Label = '0' and k <> ''").select(F.col("id").alias("ref"), F.when(F.col("year") % 3 == 0, F.substring("k", 1, 24)).otherwise(F.col("k")).alias("r"))
    return matching.prefix_match(refs, k, "ref", "r", "k", "c", "id")


@query(f"""with {P}, k as (select author, {key_sql('title')} as k, year from p), s as (select distinct k from k where year >= 2018 and k <> '')
select author, count(*)::bigint as papers, count(s.k)::bigint as common, round_even(count(s.k) / greatest(1, count(*)), 3) as share, count(s.k) >= 2 and count(s.k) / greatest(1, count(*)) >= 0.5 as accepted from k left join s on k.k = s.k group by author""")
def overlap_ids(spark, sf_dir):
    k = papers(spark, sf_dir).select("author", X.norm_title(F.col("title")).alias("k"), "year")
    return matching.candidate_overlap(k, "author", "k", k.filter("year >= 2018").select("k"))


@query("""with t as (select * from supplier order by s_acctbal desc, s_suppkey limit 60), x as (select c_custkey from customer where c_mktsegment = 'BUILDING')
select s_suppkey, s_acctbal from t where s_suppkey not in (select c_custkey from x) and s_nationkey between 3 and 20 order by s_acctbal desc, s_suppkey limit 5""")
def first_eligible(spark, sf_dir):
    out = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("s_suppkey"))
    return matching.first_eligible(table(spark, sf_dir, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")], out, "s_suppkey", F.col("s_nationkey").between(3, 20)).select("s_suppkey", "s_acctbal")


@query("select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders) where rank <= 3")
def topk_cited(spark, sf_dir):
    return matching.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("""with w as (select o_custkey as author, o_orderkey, case when o_orderkey % 5 = 0 then [] when o_orderkey % 2 = 0 then [o_orderpriority, o_orderpriority] else [o_orderpriority, o_orderstatus] end as i from orders),
r as (select distinct author, o_orderkey, x from (select author, o_orderkey, unnest(i) as x from w) union all select author, o_orderkey, null from w where len(i) = 0),
n as (select author, x as institution, count(*)::bigint as n from r group by all), t as (select author, count(*)::bigint as works from w group by author)
select author, institution, n, works, n / works as share, rank from (select n.*, t.works, row_number() over (partition by n.author order by n desc, institution asc nulls last)::int as rank from n join t on n.author = t.author) where rank <= 3""")
def nested_affiliations(spark, sf_dir):
    inst = F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority", "o_orderpriority")).otherwise(F.array("o_orderpriority", "o_orderstatus"))
    works = table(spark, sf_dir, "orders").select("o_custkey", F.array(F.struct(F.struct(F.col("o_custkey").alias("id")).alias("author"), F.transform(inst, lambda x: F.struct(x.alias("display_name"))).alias("institutions"))).alias("authorships"))
    return matching.affiliations(works, F.col("o_custkey")).select("author", "institution", "n", "works", "share", "rank")


# Histograms, samples, splits ------------------------------------------------------------------------------------------


@query("select year(o_orderdate)::int as year, count(*) filter (o_orderstatus = 'F')::bigint as f, count(*) filter (o_orderstatus = 'O')::bigint as o from orders where o_orderstatus in ('F', 'O') group by 1")
def year_histogram_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus in ('F', 'O')")
    return o.groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O"]).count().na.fill(0).select("year", F.col("F").alias("f"), F.col("O").alias("o"))


_MATCHED = "md5(concat_ws('-', o_orderkey::varchar, '42'))"


@query(f"""with pool as (select o_orderkey, year(o_orderdate)::int as y from orders where o_orderstatus <> 'F'), need as (select year(o_orderdate)::int as y, count(*)::bigint as need from orders where o_orderstatus = 'F' and month(o_orderdate) <= 6 group by 1),
r as (select pool.*, coalesce(need, 0) as need, row_number() over (partition by pool.y order by {_MATCHED}, o_orderkey) as rn from pool left join need on pool.y = need.y),
f as (select sum(greatest(0, need.need - coalesce(h.n, 0))) as short, sum(need.y * need.need) / greatest(1, sum(need.need)) as mean from need left join (select y, count(*) as n from pool group by y) h on need.y = h.y),
l as (select r.o_orderkey, r.y, row_number() over (order by abs(r.y - f.mean), {_MATCHED}, o_orderkey) as k, f.short from r, f where rn > need)
select o_orderkey, y as year from r where rn <= need union all select o_orderkey, y from l where k <= short""")
def year_matched_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderdate")
    need = o.filter("o_orderstatus = 'F' and month(o_orderdate) <= 6").groupBy("year").agg(F.count(F.lit(1)).alias("need"))
    return sampling.year_matched(o.filter("o_orderstatus <> 'F'").select("o_orderkey", "year"), need, "o_orderkey", "year", 42)


def _md5(key: str) -> str:
    return f"md5(concat_ws('-', {key}::varchar, '42'))"


@query(f"""select doc_id, lang, round_even(pool / least(pool, 40), 3) as StratumWeight from (select doc_id, lang, count(*) over (partition by lang) as pool, row_number() over (partition by lang order by {_md5('doc_id')}, doc_id) as rn from documents) where rn <= 40""")
def stratified_sample(spark, sf_dir):
    return sampling.per_stratum(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 40, "doc_id", 42).select("doc_id", "lang", "StratumWeight")


@query(f"select doc_id, lang, ((row_number() over (partition by lang order by {_md5('doc_id')}, doc_id) - 1) % 5)::int as fold from documents")
def kfold_assign(spark, sf_dir):
    return sampling.folds(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 5, 42)


@query(f"""with r as (select doc_id, lang, count(*) over (partition by lang) as n, row_number() over (partition by lang order by {_md5('doc_id')}, doc_id) as rn from documents), c as (select *, floor(n * 0.2e0 + 0.5e0) as t from r)
select doc_id, lang, case when rn <= t then 'test' when rn <= t + floor((n - t) * 0.1e0 + 0.5e0) then 'val' else 'train' end as Split from c""")
def split_assign(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 42)


@query(f"with {P} select id, case when ('0x' || substr({_md5('id')}, 1, 8))::bigint / 4294967296e0 < 0.25 then '' else {text_sql('abstract')} end as abstract from p union all select id, '' from p")
def title_only_training(spark, sf_dir):
    p = papers(spark, sf_dir).select("id", F.coalesce("abstract", F.lit("")).alias("abstract"))
    return sampling.title_only(p, "abstract", "id", 0.25, 42).unionByName(p.withColumn("abstract", F.lit("")))


# Metrics --------------------------------------------------------------------------------------------------------------

_FLAGS = f"m as (select id, (Label = '0')::int as y, Stratum, StratumWeight as w, unnest(['Keyword only', 'Title phrases', 'Indexer type', 'Strict phrases']) as method, unnest([{KEYWORD}, {TOOL}, {INDEXER}, {STRICT}])::int as p from p where Label in ('0', '1'))"
_CELLS = "sum(w) filter (y = 1 and p = 1) as tp, sum(w) filter (y = 0 and p = 1) as fp, sum(w) filter (y = 1 and p = 0) as fn, sum(w) filter (y = 0 and p = 0) as tn"


def flagged(spark, sf_dir) -> DataFrame:
    flags = pipelines.method_flags(*(F.col(c) for c in ("title", "abstract", "venue", "type")))
    rows = papers(spark, sf_dir).filter("Label in ('0', '1')")
    return rows.select("id", (F.col("Label") == "0").cast("int").alias("y"), "Stratum", F.col("StratumWeight").alias("w"), F.explode(F.array(*[F.struct(F.lit(m).alias("method"), c.cast("int").alias("p")) for m, c in flags.items()])).alias("f")).select("id", "y", "Stratum", "w", "f.*")


@query(f"""with {P}, {_FLAGS}, c as (select method, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, coalesce(tn, 0) as tn from (select method, {_CELLS.replace('sum(w)', 'sum(1e0)')} from m group by method))
select *, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) as f1 from c""")
def confusion(spark, sf_dir):
    out = metrics.confusion(flagged(spark, sf_dir), ["method"], F.col("y"), F.col("p"))
    return out.select("method", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"""with {P}, {_FLAGS}, c as (select method, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, coalesce(tn, 0) as tn from (select method, {_CELLS} from m group by method)), r as (select method, tp / greatest(tp + fp, 1e-12) as a, tp / greatest(tp + fn, 1e-12) as b, (tp + fn) / (tp + fp + fn + tn) as rate from c)
select method, round(a, 9) as precision, round(b, 9) as recall, round(case when a + b = 0 then 0 else 2 * a * b / (a + b) end, 9) as f1, round(rate, 9) as rate from r""")
def weighted_metrics(spark, sf_dir):
    out = metrics.weighted(flagged(spark, sf_dir), ["method"], F.col("y"), F.col("p"), F.col("w"))
    return out.select("method", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "rate")])


_SWEEP = f"""{P}, g as (select unnest(range(5, 96))::int as k), l as (select (Label = '0')::int as y, proba as s, StratumWeight as w from p where Label in ('0', '1')),
c as (select k, coalesce(sum(w) filter (y = 1 and s + 1e-11 >= k / 100), 0) as tp, coalesce(sum(w) filter (s + 1e-11 >= k / 100), 0) as fl, sum(w) filter (y = 1) as pos from g, l group by k),
r as (select k / 100 as t, tp / greatest(fl, 1e-12) as a, tp / greatest(pos, 1e-12) as b from c), f as (select t, case when a + b = 0 then 0 else 2 * a * b / (a + b) end as f1 from r)"""


def sweep(spark, sf_dir) -> DataFrame:
    rows = papers(spark, sf_dir).filter("Label in ('0', '1')")
    return metrics.threshold_sweep(rows, (F.col("Label") == "0").cast("int"), F.col("proba"), F.col("StratumWeight"))


@query(f"with {_SWEEP} select t, round(f1, 9) as f1 from f")
def threshold_sweep(spark, sf_dir):
    return sweep(spark, sf_dir).select("t", F.round("f1", 9).alias("f1"))


@query(f"with {_SWEEP} select t, round(f1, 9) as f1 from f order by round(f1, 12) desc, t limit 1")
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(sweep(spark, sf_dir).withColumn("f1", F.round("f1", 12))).select("t", F.round("f1", 9).alias("f1"))


@query("""with m as (select count(*)::bigint as n, avg((quality = toxic)::int) as a, avg(quality) as p, avg(toxic) as q from labels)
select n, round(a, 9) as agreement, round((a - (p * q + (1 - p) * (1 - q))) / nullif(1 - (p * q + (1 - p) * (1 - q)), 0), 9) as kappa from m""")
def kappa(spark, sf_dir):
    out = metrics.kappa(table(spark, sf_dir, "labels"), [], F.col("quality"), F.col("toxic"))
    return out.select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query("""with r as (select d.source, avg(l.toxic) filter (l.quality = 1) as tpr, avg(l.toxic) filter (l.quality = 0) as fpr from labels l join documents d on l.doc_id = d.doc_id group by 1)
select source, round(tpr * 0.08 / greatest(1e-9, tpr * 0.08 + fpr * 0.92), 9) as precision from r where tpr is not null and fpr is not null""")
def prec_at_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    r = rows.groupBy("source").agg(F.avg(F.when(F.col("quality") == 1, F.col("toxic"))).alias("tpr"), F.avg(F.when(F.col("quality") == 0, F.col("toxic"))).alias("fpr")).dropna()
    return r.select("source", F.round(metrics.precision_at_rate(F.col("tpr"), F.col("fpr"), F.lit(0.08)), 9).alias("precision"))


@query("select quality, count(*)::bigint as n, round((select count(*) from labels) / ((select count(distinct quality) from labels) * count(*)), 9) as weight from labels group by quality")
def class_weights(spark, sf_dir):
    return metrics.class_weights(table(spark, sf_dir, "labels"), "quality").select("quality", "n", F.round("weight", 9).alias("weight"))


@query(f"""with {P}, a as (select author, avg(({CATEGORY} = 'survey')::int) as s, coalesce(sum(citationCount) filter ({CATEGORY} = 'survey'), 0) / greatest(1, coalesce(sum(citationCount), 0)) as c from p group by author),
b as (select *, least(greatest((s - 0.05) / greatest(0.8 - 0.05, 1e-9), 0), 1) as pi from a)
select author, round(pi, 9) as papers, round(case when s > 0 then least(greatest(0.8 * pi / s, 0), 1) else 0 end * c + case when s < 1 then least(greatest(0.2 * pi / (1 - s), 0), 1) else 0 end * (1 - c), 9) as citations from b""")
def corrected_shares(spark, sf_dir):
    survey = category() == "survey"
    a = papers(spark, sf_dir).groupBy("author").agg(F.avg(survey.cast("int")).alias("s"), (F.coalesce(F.sum(F.when(survey, F.col("citationCount"))), F.lit(0.0)) / F.greatest(F.lit(1), F.coalesce(F.sum("citationCount"), F.lit(0.0)))).alias("c"))
    papers_share, cites_share = metrics.corrected_shares(F.col("s"), F.col("c"), F.lit(0.8), F.lit(0.05))
    return a.select("author", F.round(papers_share, 9).alias("papers"), F.round(cites_share, 9).alias("citations"))


@query(f"""with {P}, s as (select Stratum, any_value(StratumWeight) as w, count(*)::bigint as sampled, count(*) filter (Label in ('0', '1'))::bigint as labeled, count(*) filter (Label = '0')::bigint as surveys from p group by Stratum)
select Stratum, round_even(w * sampled, 0)::bigint as pool, sampled, labeled, surveys, round(surveys / labeled, 9) as share from s""")
def sampling_design(spark, sf_dir):
    s = papers(spark, sf_dir).groupBy("Stratum").agg(F.max("StratumWeight").alias("w"), F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("Label").isin("0", "1")).alias("labeled"), F.count_if(F.col("Label") == "0").alias("surveys"))
    return s.select("Stratum", F.bround(F.col("w") * F.col("sampled"), 0).cast("long").alias("pool"), "sampled", "labeled", "surveys", F.round(F.try_divide("surveys", "labeled"), 9).alias("share"))


REPLICATES = 2000
_DRAWS = f"""r as (select doc_id, quality, toxic, count(*) over (partition by quality) as n, row_number() over (partition by quality order by md5(concat_ws('-', doc_id::varchar, '7')), doc_id) as place from labels),
d as (select quality, rep, (1 + ('0x' || substr(md5(concat_ws('-', '7', rep::varchar, place::varchar, quality::varchar)), 1, 8))::bigint % n) as place from r, (select unnest(range(1, {REPLICATES + 1})) as rep)),
b as (select d.rep, r.quality, r.toxic from d join r on d.quality = r.quality and d.place = r.place)"""


@query(f"""with {_DRAWS}, f as (select rep, 2 * count(*) filter (quality = 1 and toxic = 1) / greatest(1, 2 * count(*) filter (quality = 1 and toxic = 1) + count(*) filter (quality <> toxic)) as f1 from b group by rep)
select round(quantile_cont(f1, 0.025), 9) as low, round(quantile_cont(f1, 0.975), 9) as high from f""")
def bootstrap_ci(spark, sf_dir):
    draws = sampling.bootstrap_draws(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["quality"], "doc_id", REPLICATES, 7)
    scores = metrics.confusion(draws, ["rep"], F.col("quality"), F.col("toxic"))
    return sampling.interval(scores, [], F.col("f1")).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"""with {_DRAWS}, f as (select rep, 2 * count(*) filter (quality = 1 and toxic = 1) / greatest(1, 2 * count(*) filter (quality = 1 and toxic = 1) + count(*) filter (quality <> toxic)) as f1, 2 * count(*) filter (quality = 1) / greatest(1, 2 * count(*) filter (quality = 1) + count(*) filter (quality = 0)) as g1 from b group by rep)
select round(quantile_cont(f1 - g1, 0.025), 9) as low, round(quantile_cont(f1 - g1, 0.975), 9) as high from f""")
def paired_bootstrap(spark, sf_dir):
    draws = sampling.bootstrap_draws(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["quality"], "doc_id", REPLICATES, 7)
    both = draws.select("rep", "quality", F.explode(F.array(F.struct(F.lit("a").alias("m"), F.col("toxic").alias("p")), F.struct(F.lit("b").alias("m"), F.lit(1).alias("p")))).alias("f")).select("rep", "quality", "f.*")
    f1 = metrics.confusion(both, ["rep", "m"], F.col("quality"), F.col("p")).groupBy("rep").agg((F.max(F.when(F.col("m") == "a", F.col("f1"))) - F.max(F.when(F.col("m") == "b", F.col("f1")))).alias("delta"))
    return sampling.interval(f1, [], F.col("delta")).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


# Models ---------------------------------------------------------------------------------------------------------------


@query()
def hybrid_fit(spark, sf_dir):
    """Predictions of the hybrid on the papers it was fitted on, embeddings included; papers without one have zeros and a mark."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat("embedding", F.array(F.lit(0.0).cast("float"))).alias("embedding"))
    labelled = profiles.normalize(papers(spark, sf_dir), keep=("id", "Label")).filter("Label in ('0', '1')").join(vectors, "id", "left")
    none = F.concat(F.array_repeat(F.lit(0.0).cast("float"), 64), F.array(F.lit(1.0).cast("float")))
    labelled = labelled.withColumn("embedding", F.coalesce("embedding", none))
    rows = features.hybrid_features(labelled, None, "embedding", keep=("id", "Label")).select("id", F.lit("all").alias("stratum"), "features", (F.col("Label") == "0").cast("double").alias("y"), F.lit(1.0).alias("w"))
    rows = rows.cache()  # for the fit and the predictions
    return hybrid.fit_selected(rows, "id", "stratum").predict(rows).select("id", F.round("hybrid_proba", 4).alias("hybrid_proba"), "is_survey")


def _text_model(spark, sf_dir):
    """The text model trained on the papers with a label, and those papers with their parts."""
    labelled = profiles.normalize(papers(spark, sf_dir), keep=("id", "Label")).filter("Label in ('0', '1')")
    return pipelines.train_text_model(labelled)


@query()
def text_scores(spark, sf_dir):
    """Probability and verdict of the trained text model on every paper, with the part that it had in the training."""
    model, parts = _text_model(spark, sf_dir)
    every = profiles.normalize(papers(spark, sf_dir), keep=("id",)).join(parts.select("id", "Split"), "id", "left")
    return model.score(every).select("id", "Split", F.round("proba", 4).alias("proba"), (F.col("proba") >= model.threshold).cast("int").alias("p"))


@query()
def text_model_metrics(spark, sf_dir):
    """Methods on the part of the papers that the text model has not seen."""
    model, parts = _text_model(spark, sf_dir)
    out = pipelines.evaluate_methods(parts.filter("Split = 'test'").drop("Split"), scorer=model)
    return out.select("method", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def _cross_validated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Labelled papers (id, Stratum, features, y, w) less the rare stratum, and out-of-fold predictions (id, rep, pred) on them."""
    labelled = profiles.normalize(papers(spark, sf_dir), keep=("id", "Label", "Stratum", "StratumWeight")).filter("Label in ('0', '1')")
    rows = features.hybrid_features(labelled, None, keep=("id", "Label", "Stratum", "StratumWeight"))
    rows = rows.select("id", "Stratum", "features", (F.col("Label") == "0").cast("double").alias("y"), F.col("StratumWeight").alias("w"))
    rare = F.col("Stratum") == "title_kw"
    return rows.filter(~rare), hybrid.nested_cv(rows.filter(~rare), "id", "Stratum", rows.filter(rare))


@query()
def nested_cv(spark, sf_dir):
    """Out-of-fold predictions of the hybrid without embeddings, the rare stratum's papers as fixed rows."""
    return _cross_validated(spark, sf_dir)[1]


def _rate_samples(spark, sf_dir) -> DataFrame:
    rows, found = _cross_validated(spark, sf_dir)
    both = found.join(rows.select("id", "Stratum", "y", "w"), "id")
    return resampling.rate_samples(both, ["Stratum"], "id", "rep", F.col("y"), F.col("pred"), F.col("w"), REPLICATES)


@query()
def error_rate_samples(spark, sf_dir):
    """Rates of the cross-validated hybrid with 95 % intervals over 2000 stratified replicates."""
    samples = _rate_samples(spark, sf_dir).cache()
    ends = [F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(f"_{c}") for c in ("tpr", "fpr")]
    point = samples.filter("rep = 0").select("tpr", "fpr")
    wide = samples.filter("rep > 0").agg(*ends)  # one row
    out = point.crossJoin(F.broadcast(wide))
    return out.select(*[c for n in ("tpr", "fpr") for c in (F.round(n, 6).alias(n), F.round(F.col(f"_{n}")[0], 6).alias(f"{n}_low"), F.round(F.col(f"_{n}")[1], 6).alias(f"{n}_high"))])


@query()
def method_intervals(spark, sf_dir):
    """F1 of the rule methods on labelled papers, their 95 % intervals and how much better than the title words they are."""
    rows = profiles.normalize(papers(spark, sf_dir), keep=("id", "Label", "Stratum", "StratumWeight")).filter("Label in ('0', '1')")
    methods = pipelines.method_flags(*(F.col(c) for c in ("Title", "Abstract", "Venue", "Type")))
    out = evaluation.method_intervals(rows, methods, (F.col("Label") == "0").cast("int"), "id", ("Stratum",), F.col("StratumWeight"), "Keyword only", REPLICATES)
    return out.select("method", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query()
def corrected_impact(spark, sf_dir):
    """Shares of surveys and of their citations by author, corrected by the cross-validated error rates, with intervals."""
    survey, cites = F.col("_survey"), F.coalesce(F.sum("citationCount"), F.lit(0.0))
    flagged = papers(spark, sf_dir).select("author", "citationCount", (category() == "survey").alias("_survey"))  # once a paper
    shares = flagged.groupBy("author").agg(F.avg(survey.cast("int")).alias("flagged"), (F.coalesce(F.sum(F.when(survey, F.col("citationCount"))), F.lit(0.0)) / F.greatest(F.lit(1), cites)).alias("cites")).cache()  # a row an author, read several times
    samples = _rate_samples(spark, sf_dir).cache()
    point = samples.filter("rep = 0").first()
    out = verification.corrected_table(shares, "author", (float(point.tpr or 0), float(point.fpr or 0)), samples.filter("rep > 0"))
    return out.select("author", *[F.round(c, 6).alias(c) for c in ("papers", "papers_low", "papers_high", "citations", "citations_low", "citations_high")])


@query(f"""with {P}, s as (select id, case Stratum when 'title_kw' then 'validation' when 'abstract_cue' then 'llm' else 'hand' end as source, StratumWeight * (1 + id % 3) as w from p),
t as (select source, count(*) as n, avg(w) as m from s group by source), l as (select coalesce(sum(n), 0) as n from t where source = 'llm')
select s.id, s.source, round(case s.source when 'llm' then w / m when 'validation' then 0.25 * l.n / t.n else w end, 9) as w from s join t on s.source = t.source, l""")
def source_weights(spark, sf_dir):
    source = F.when(F.col("Stratum") == "title_kw", "validation").when(F.col("Stratum") == "abstract_cue", "llm").otherwise("hand")
    rows = papers(spark, sf_dir).select("id", source.alias("source"), (F.col("StratumWeight") * (1 + F.col("id") % 3)).alias("w"))
    return hybrid.source_weights(rows, "source", "w").select("id", "source", F.round("w", 9).alias("w"))


_TERMS = """d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as w from documents),
g as (select doc_id, unnest(list_concat(w, case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)) as term from d),
c as (select doc_id, term, count(*) as tf from g group by all),
f as (select term, ln((1 + (select count(*) from documents)) / (1 + count(*))) + 1 as idf from c group by term having count(*) >= 2),
r as (select doc_id, c.term, (1 + ln(tf)) * idf as x from c join f on c.term = f.term)"""


@query(f"with {_TERMS} select doc_id, term, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) as weight from r")
def tfidf_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return baselines.tfidf_weights(docs, "doc_id", F.col("text")).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query()
def tfidf_svm(spark, sf_dir):
    """Held-out predictions of the baseline: trained on the papers of earlier years."""
    rows = papers(spark, sf_dir).filter("Label in ('0', '1')").select("id", "year", X.paper_text(F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("text"), (F.col("Label") == "0").cast("int").alias("y"))
    out = baselines.tfidf_svm(rows.filter("year < 2020"), rows.filter("year >= 2020"), "id", F.col("text"), "y")
    return out.select("id", "p", F.round("margin", 3).alias("margin"))


# Verification ---------------------------------------------------------------------------------------------------------


_TOP = f"{P}, k as (select id, author, {key_sql('title')} as k, year, coalesce(citationCount, 0)::bigint as c, {CATEGORY} as cat, case when Label = '0' then 'S' when Label = '1' then 'R' else 'B' end as truth from p), r as (select id as ref, author, truth, year, case when year % 3 = 0 then left(k, 24) else k end as k from k)"


def _profile(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Keyed papers, and the reference list: all of them, of every third year only the beginnings of the titles."""
    truth = F.when(F.col("Label") == "0", "S").when(F.col("Label") == "1", "R").otherwise("B")
    k = papers(spark, sf_dir).select("id", "author", X.norm_title(F.col("title")).alias("k"), "year", F.coalesce("citationCount", F.lit(0)).cast("long").alias("c"), category().alias("cat"), truth.alias("truth"))
    refs = k.select(F.col("id").alias("ref"), "author", "truth", "year", F.when(F.col("year") % 3 == 0, F.substring("k", 1, 24)).otherwise(F.col("k")).alias("k"))
    return k, refs


@query(f"""with {_TOP} select r.author, count(*) filter (exists (select 1 from k where k.author = r.author and k.year < 2022 and case when length(r.k) >= 20 then starts_with(k.k, r.k) else k.k = r.k end))::bigint as found, count(*)::bigint as total from r group by r.author""")
def title_coverage(spark, sf_dir):
    k, refs = _profile(spark, sf_dir)
    return verification.coverage(refs, k.filter("year < 2022"), "author", "k")


@query(f"""with {_TOP}, h as (select r.author, r.truth, r.year, k.cat from r left join k on r.ref = k.id and k.year < 2022),
o as (select author, truth = 'S' and cat = 'survey' or truth = 'R' and cat = 'research' or truth = 'B' and cat in ('research', 'non-paper') as ok, year >= 2015 as fresh from h where cat is not null)
select coalesce(author, 'Total') as author, count(*) filter (ok)::bigint as correct, count(*)::bigint as total, count(*) filter (ok and fresh)::bigint as unseen_correct, count(*) filter (fresh)::bigint as unseen_total from o group by rollup (author)""")
def top_verification(spark, sf_dir):
    k, refs = _profile(spark, sf_dir)
    checked = refs.select("ref", "author", "truth", "year").join(k.filter("year < 2022").select(F.col("id").alias("ref"), "cat"), "ref", "left").withColumn("seen", F.col("year") < 2015)
    return verification.agreement(checked, "author", "truth", "cat", "seen")


@query(f"""with {_TOP}, s as (select *, case when year < 2018 then 'A' else 'B' end as source from k), q as (select author || '|' || source as g, c, id from s), i as ({h_sql('q', 'g', 'c')}),
f as (select author || '|' || source as g, count(*)::bigint as found from s join labels on id = doc_id group by all)
select split_part(i.g, '|', 1) as author, split_part(i.g, '|', 2) as source, papers, citations, h_index, i10_index, coalesce(found, 0)::bigint as found from i left join f on i.g = f.g""")
def profile_completeness(spark, sf_dir):
    k = _profile(spark, sf_dir)[0].withColumn("source", F.when(F.col("year") < 2018, "A").otherwise("B"))
    out = verification.completeness(k, k.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id").select("author", "source"), "author", "source", "c")
    return out.select("author", "source", "papers", "citations", "h_index", "i10_index", "found")


@query("""with c as (select l_suppkey, l_shipmode, count(*)::bigint as n from (select *, l_linestatus || l_returnflag as l_shipmode from lineitem) group by all)
select l_suppkey, round(100 * sum(case when l_shipmode in ('OR', 'FA') then 0 else n end) / greatest(1, sum(n)), 9) as outside from c group by l_suppkey""")
def outside_share(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.concat("l_linestatus", "l_returnflag").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return verification.outside_share(c, "l_suppkey", "g", "n", ("OR", "FA")).select("l_suppkey", F.round("outside", 9).alias("outside"))


@query(r"""with n as (select c_custkey, ['Li-Wei Chen ' || c_nationkey, 'li wei chen ' || c_nationkey, 'L. Chen', 'Chen', c_mktsegment || ' Chen', 'Wei Chen', 'Li Chen', 'Wei Li Chen'] as v from customer),
u as (select c_custkey, unnest(v) as variant, generate_subscripts(v, 1) as p from n),
f as (select *, lower(replace(variant, '-', ' ')) as k from u where p = 1 or not contains(variant, '.') and contains(variant, ' ')),
d as (select c_custkey, arg_min(variant, p) as variant, min(p) as p from f group by c_custkey, k)
select c_custkey, variant, place from (select c_custkey, variant, row_number() over (partition by c_custkey order by p)::int as place from d) where place <= 4""")
def name_variants(spark, sf_dir):
    nation = F.col("c_nationkey").cast("string")
    others = F.array(F.concat(F.lit("li wei chen "), nation), F.lit("L. Chen"), F.lit("Chen"), F.concat("c_mktsegment", F.lit(" Chen")), F.lit("Wei Chen"), F.lit("Li Chen"), F.lit("Wei Li Chen"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Li-Wei Chen "), nation).alias("name"), others.alias("others"))
    return verification.name_variants(rows, "c_custkey", "name", "others")


_RATES = "e as (select doc_id % 3 as rep, quality as y, toxic as p, 1 + doc_id % 4 as w from labels), a as (select rep, sum(w) filter (y = 1 and p = 1) / sum(w) filter (y = 1) as tpr, coalesce(sum(w) filter (y = 0 and p = 1), 0) / sum(w) filter (y = 0) as fpr from e group by rep)"


def _rated(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select((F.col("doc_id") % 3).alias("rep"), "quality", "toxic", (1 + F.col("doc_id") % 4).alias("w"))


@query(f"with {_RATES} select round(avg(coalesce(tpr, 0)), 9) as tpr, round(avg(fpr), 9) as fpr from a")
def error_rates(spark, sf_dir):
    out = verification.error_rates(_rated(spark, sf_dir), [], "rep", F.col("quality"), F.col("toxic"), F.col("w"))
    return out.select(F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query(f"""with {P}, a as (select author, avg(({CATEGORY} = 'survey')::int) as q, coalesce(sum(citationCount) filter ({CATEGORY} = 'survey'), 0) / greatest(1, coalesce(sum(citationCount), 0)) as c from p group by author),
s as (select unnest(range(0, 50)) as rep), r as (select author, q, c, -1 as rep, 0.8 as tpr, 0.05 as fpr from a union all select author, q, c, rep, 0.7 + rep * 0.004 as tpr, 0.01 + (rep * 7 % 50) * 0.002 as fpr from a, s),
b as (select *, least(greatest((q - fpr) / greatest(tpr - fpr, 1e-9), 0), 1) as pi from r),
m as (select author, rep, q, c, pi as papers, case when q > 0 then least(greatest(tpr * pi / q, 0), 1) else 0 end * c + case when q < 1 then least(greatest((1 - tpr) * pi / (1 - q), 0), 1) else 0 end * (1 - c) as citations from b),
w as (select author, rep, q, c, papers, citations from m union all select 'Average', rep, avg(q), avg(c), avg(papers), avg(citations) from m group by rep)
select author, round(any_value(papers) filter (rep < 0), 6) as papers, round(quantile_cont(papers, 0.025) filter (rep >= 0), 6) as papers_low, round(quantile_cont(papers, 0.975) filter (rep >= 0), 6) as papers_high,
 round(any_value(citations) filter (rep < 0), 6) as citations, round(quantile_cont(citations, 0.025) filter (rep >= 0), 6) as citations_low, round(quantile_cont(citations, 0.975) filter (rep >= 0), 6) as citations_high from w group by author""")
def corrected_table(spark, sf_dir):
    survey, cites = F.col("_survey"), F.coalesce(F.sum("citationCount"), F.lit(0.0))
    flagged = papers(spark, sf_dir).select("author", "citationCount", (category() == "survey").alias("_survey"))  # once a paper
    shares = flagged.groupBy("author").agg(F.avg(survey.cast("int")).alias("flagged"), (F.coalesce(F.sum(F.when(survey, F.col("citationCount"))), F.lit(0.0)) / F.greatest(F.lit(1), cites)).alias("cites"))
    samples = spark.range(50).select(F.col("id").alias("rep"), (0.7 + F.col("id") * 0.004).alias("tpr"), (0.01 + (F.col("id") * 7 % 50) * 0.002).alias("fpr"))
    out = verification.corrected_table(shares, "author", (0.8, 0.05), samples)
    return out.select("author", *[F.round(c, 6).alias(c) for c in ("papers", "papers_low", "papers_high", "citations", "citations_low", "citations_high")])


@query("""select d.source, count(*)::bigint as papers, round(coalesce(count(*) filter (quality = 1 and toxic = 1) / nullif(count(*) filter (quality = 1), 0), 0), 9) as recall,
 round(2 * count(*) filter (quality = 1 and toxic = 1) / greatest(1, 2 * count(*) filter (quality = 1 and toxic = 1) + count(*) filter (quality <> toxic)), 9) as f1 from labels l join documents d on l.doc_id = d.doc_id group by 1""")
def recall_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    out = metrics.confusion(rows, ["source"], F.col("quality"), F.col("toxic"))
    return out.select("source", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("long").alias("papers"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


@query("""with e as (select doc_id, quality from labels), s as (select doc_id, toxic from labels where quality = 1)
select e.doc_id, quality, toxic, 'all' as part from e join s on e.doc_id = s.doc_id where quality = 1 union all
select e.doc_id, quality, toxic, 'some' from e join s on e.doc_id = s.doc_id where not exists (select 1 from e where quality <> 1)""")
def aligned_predictions(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    known, rows = labels.filter("quality = 1").select("doc_id", "toxic"), labels.select("doc_id", "quality")
    whole = verification.aligned(rows.filter("quality = 1"), known, "doc_id").withColumn("part", F.lit("all"))
    return whole.unionByName(verification.aligned(rows, known, "doc_id").withColumn("part", F.lit("some")))
