"""Registered queries of the composite plans, the index lookups and the smaller operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import indices, lookup, matching, metrics, profiles, rules, sampling, scoring
from . import dataset, evaluation, pipelines
from .papers import papers
from .registry import _CUES, _FLAGS, _MATCHED, CA, CATEGORY, CT, INDEXER, KEYWORD, P, STRICT, TOOL, category, flagged, h_sql, has_sql, impact_sql, key_sql, query, table, text_sql, words_sql

# Index lookups --------------------------------------------------------------------------------------------------------


@query(f"with {P} select id, title from p where abstract is not null and type = 'article' order by md5(concat_ws('-', id::varchar, '7')), id limit 200")
def seeded_sample(spark, sf_dir):
    """200 articles with an abstract, at random."""
    return lookup.seeded_sample(papers(spark, sf_dir).filter("abstract is not null and type = 'article'"), "id", 200, 7).select("id", "title")


@query("select o_custkey, count(*)::bigint as count from orders group by 1 order by 2 desc, 1 limit 200")
def group_count(spark, sf_dir):
    return lookup.group_count(table(spark, sf_dir, "orders"), "o_custkey", 200)


@query("select count(*) filter (l_returnflag = 'R' and l_quantity > 10)::bigint as count from lineitem")
def filtered_count(spark, sf_dir):
    return lookup.filtered_count(table(spark, sf_dir, "lineitem"), (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 10))


@query("select n.s_suppkey, s_name from (select distinct l_suppkey as s_suppkey from lineitem where l_returnflag = 'R') n left join supplier s on n.s_suppkey = s.s_suppkey")
def lookup_by_ids(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey")
    return lookup.by_ids(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), wanted, "s_suppkey")


_AUTHORS = f"{P}, a as (select author as name, count(*)::bigint as works, min(id) as id from p group by author)"


@query(f"with {_AUTHORS} select id, name, works, row_number() over (order by works desc, id) = 1 as chosen from a where contains(lower(name), 'author') and contains(lower(name), '1') order by works desc, id limit 5")
def find_author(spark, sf_dir):
    """Candidates for a name, and the one with most works."""
    authors = papers(spark, sf_dir).groupBy(F.col("author").alias("name")).agg(F.count(F.lit(1)).alias("works"), F.min("id").alias("id"))
    return lookup.find_author(authors, "author 1").select("id", "name", "works", "chosen")


@query(f"with h as ({h_sql('lineitem', 'l_suppkey', 'l_quantity')}) select min(h_index) as low, max(h_index) as high from h")
def value_range(spark, sf_dir):
    return lookup.value_range(indices.h_index(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity"), "h_index")


# Records --------------------------------------------------------------------------------------------------------------


@query(f"""with {P} select 'W' || id as id, {text_sql('title')} as title, case when id % 2 = 0 then 'we ' || {text_sql('type')} || ' we end' else '' end as abstract, {text_sql('authors')} as authors, coalesce(citationCount, 0)::bigint as citationCount,
 (id % 9)::bigint as ReferenceCount, {text_sql('venue')} as venue, year, {text_sql('type')} as type, case when id % 3 = 0 then '' else 'https://doi.org/10.1/' || id end as doi from p""")
def work_rows(spark, sf_dir):
    """Flat rows of nested index records."""
    index = F.map_from_arrays(F.array(F.lit("we"), F.concat(F.lit("\u0001"), X.text_of(F.col("type"))), F.lit("end")), F.array(F.array(F.lit(0), F.lit(2)), F.array(F.lit(1)), F.array(F.lit(3))))
    people = F.transform(F.split("authors", "; "), lambda n: F.struct(F.struct(F.lit("A1").alias("id"), n.alias("display_name")).alias("author")))
    works = papers(spark, sf_dir).select(
        F.concat(F.lit("https://index.org/W"), "id").alias("id"), "title", F.when(F.col("id") % 2 == 0, index).alias("abstract_inverted_index"), people.alias("authorships"),
        F.col("citationCount").cast("long").alias("cited_by_count"), (F.col("id") % 9).alias("referenced_works_count"),
        F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"), F.col("year").alias("publication_year"), "type",
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("https://doi.org/10.1/"), "id")).alias("doi"),
    )
    return profiles.work_to_row(works).withColumn("abstract", F.translate("abstract", "\u0001", ""))


@query(f"""with {P} select id, title, citationCount, coalesce(array_to_string(list_filter(list_transform(string_split("references", ';'), lambda x: trim(x)), lambda x: x <> ''), '; '), '') as "references", {text_sql('type')} as type, {text_sql('authors')} as authors from p""")
def record_rows(spark, sf_dir):
    """Flat rows of paper records with references as structs."""
    records = papers(spark, sf_dir).select(
        F.col("id").alias("paperId"), "title", "abstract", F.transform(F.split("authors", "; "), lambda n: F.struct(n.alias("name"))).alias("authors"), "citationCount",
        F.transform(F.split("references", ";"), lambda r: F.struct(F.nullif(F.trim(r), F.lit("")).alias("paperId"))).alias("references"), "venue", "year",
        F.when(F.col("type").isNotNull(), F.split("type", "; ")).alias("publicationTypes"),
    )
    return profiles.record_to_row(records).select("id", "title", "citationCount", "references", "type", "authors")


@query(f"with {P} select id, case when id % 4 = 0 then null else lower('10.1/Ab' || id) end as doi from p")
def doi_keys(spark, sf_dir):
    prefix = F.when(F.col("id") % 4 == 1, "https://doi.org/").when(F.col("id") % 4 == 2, "http://dx.doi.org/").otherwise("")
    return papers(spark, sf_dir).select("id", X.doi_key(F.when(F.col("id") % 4 != 0, F.concat(prefix, F.lit("10.1/Ab"), "id"))).alias("doi"))


# Datasets -------------------------------------------------------------------------------------------------------------


@query(f"""with {P}, t as (select id, Label::int as Label, case when {CA} <> '' then {CT} || '. ' || {CA} else {CT} end as Text from p where Label in ('0', '1') and title is not null and abstract is not null)
select id, Label, Text from (select *, row_number() over (partition by Text order by id) as rn from t where length(Text) > 20) where rn = 1""")
def dataset_load(spark, sf_dir):
    p = papers(spark, sf_dir).select("id", "Label", F.col("title").alias("Title"), F.col("abstract").alias("Abstract"))
    return dataset.load(p, "id").select("id", "Label", "Text")


def _rows(spark, sf_dir):
    """Labelled rows of one group for the dataset plans."""
    p = papers(spark, sf_dir).filter("Label in ('0', '1')")
    return p.select(
        X.text_of(F.col("title")).alias("Title"), X.text_of(F.col("abstract")).alias("Abstract"), F.col("Label").cast("int").alias("Label"), F.col("venue").alias("Venue"),
        F.lit("all").alias("Group"), F.col("year").alias("Year"), F.col("type").alias("Type"), F.col("id").alias("OpenAlexId"),
    )


_ROUTE = f"""w as (select id, year, {key_sql('title')} as k, Label::int as Label, case when {text_sql('title')} = '' or {words_sql(text_sql('abstract'))} < {V.MIN_WORDS_TRAIN} or {has_sql(text_sql('title'), V.JUNK_TITLES)} then 'unusable'
 when Label = '0' and coalesce(type not in ('article', 'review'), true) then 'no survey type' when Label = '1' and (coalesce(type <> 'article', true) or {has_sql(text_sql('title'), V.TITLE_TERMS)}) then 'hard case' else 'kept' end as Route from p where Label in ('0', '1'))"""


@query(f"with {P}, {_ROUTE} select Label, Route, count(*)::bigint as n from w group by all")
def dataset_routes(spark, sf_dir):
    return dataset.routed(_rows(spark, sf_dir)).groupBy("Label", "Route").agg(F.count(F.lit(1)).alias("n"))


_HASH = _MATCHED.replace("o_orderkey", "id")
_ASSEMBLE = f"""s as (select * from (select *, row_number() over (partition by Label, k order by id) as one from w where Route = 'kept') where one = 1),
c as (select * from s where k not in (select k from s group by k having count(distinct Label) > 1) and k not in (select k from x)),
need as (select year, count(*) as need from c where Label = 0 group by year),
r as (select c.id, c.Label, c.year, coalesce(need, 0) as need, row_number() over (partition by c.year order by {_HASH}, c.id) as rn from c left join need on c.year = need.year where c.Label = 1),
f as (select sum(greatest(0, need.need - coalesce(h.n, 0))) as short, sum(need.year * need.need) / greatest(1, sum(need.need)) as mean from need left join (select year, count(*) as n from r group by year) h on need.year = h.year),
l as (select r.*, row_number() over (order by abs(r.year - f.mean), {_HASH}, id) as pos, f.short from r, f where rn > need),
d as (select id, Label from c where Label = 0 union all select id, Label from r where rn <= need union all select id, Label from l where pos <= short)"""


@query(f"with {P}, {_ROUTE}, x as (select {key_sql('title')} as k from p where Label = 'skip'), {_ASSEMBLE} select id, Label, row_number() over (order by {_HASH}, id)::int as Place from d")
def dataset_build(spark, sf_dir):
    """Surveys and year-matched research papers, without titles of both classes and those of the skipped papers."""
    skipped = papers(spark, sf_dir).filter("Label = 'skip'").select(X.norm_title(F.col("title")).alias("k"))
    kept = dataset.routed(_rows(spark, sf_dir)).filter("Route = 'kept'")
    return dataset.assemble(kept, [skipped], ["all"]).select(F.col("OpenAlexId").alias("id"), "Label", "Place")


_RECORDS = f"r0 as (select {key_sql('title')} as k, min(id) as record from p where venue like 'arXiv%' and {key_sql('title')} <> '' group by 1)"


@query(f"with {P}, {_RECORDS} select id, record from p join r0 on {key_sql('title')} = k")
def matched_records(spark, sf_dir):
    """Papers with the preprint of the same title."""
    p = papers(spark, sf_dir)
    records = p.filter("venue like 'arXiv%'").select("title", F.col("id").alias("record"))
    return dataset.matched_records(p, records).select("id", "record")


@query(f"""with {P}, {_RECORDS}, {_ROUTE.replace("from p where Label in ('0', '1')", f"from p where Label in ('0', '1') and {key_sql('title')} in (select k from r0)")}, x as (select {key_sql('title')} as k from p where Label = 'skip'), {_ASSEMBLE} select id, Label from d""")
def external_build(spark, sf_dir):
    """The same for papers that have a preprint: a test set from an outside collection."""
    p = papers(spark, sf_dir)
    records = p.filter("venue like 'arXiv%'").select(F.col("title").alias("Title"), F.col("id").alias("record"))
    rows = dataset.matched_records(_rows(spark, sf_dir), records, "Title").drop("_key", "record")
    skipped = p.filter("Label = 'skip'").select(X.norm_title(F.col("title")).alias("k"))
    return dataset.assemble(dataset.routed(rows).filter("Route = 'kept'"), [skipped], ["all"]).select(F.col("OpenAlexId").alias("id"), "Label")


@query(f"""with {P}, b as (select Label, title, abstract, StratumWeight as w from p where Label in ('0', '1') union all select Label, title, '' as abstract, StratumWeight from p where Label in ('0', '1')), l as (select (Label = '0')::int as y, {_CUES} as s, w from b),
g as (select unnest(range(1, 100))::int as k), c as (select k, coalesce(sum(w) filter (y = 1 and s + 1e-11 >= k / 100), 0) as tp, coalesce(sum(w) filter (s + 1e-11 >= k / 100), 0) as fl, sum(w) filter (y = 1) as pos from g, l group by k),
r as (select k / 100 as t, tp / greatest(fl, 1e-12) as a, tp / greatest(pos, 1e-12) as b from c), f as (select t, case when a + b = 0 then 0 else 2 * a * b / (a + b) end as f1 from r)
select t, round(f1, 9) as f1 from f order by round(f1, 12) desc, t limit 1""")
def threshold_reselect(spark, sf_dir):
    """The threshold chosen anew over 99 candidates, on papers and their title-only copies."""
    rows = papers(spark, sf_dir).filter("Label in ('0', '1')").select("Label", F.col("title").alias("Title"), F.col("abstract").alias("Abstract"), "StratumWeight")
    both = dataset.with_copies(rows, scoring.cue_score)
    sweep = metrics.threshold_sweep(both, (F.col("Label") == "0").cast("int"), F.col("proba"), F.col("StratumWeight"), 1, 99)
    return metrics.best_threshold(sweep.withColumn("f1", F.round("f1", 12))).select("t", F.round("f1", 9).alias("f1"))


# Evaluation -----------------------------------------------------------------------------------------------------------


@query(f"with {P}, {_FLAGS} select method, round(sum(y * w) / sum(w), 9) as true_rate, round(sum(p * w) / sum(w), 9) as predicted_rate from m group by method")
def survey_rates(spark, sf_dir):
    out = evaluation.survey_rates(flagged(spark, sf_dir), ["method"], F.col("y"), F.col("p"), F.col("w"))
    return out.select("method", F.round("true_rate", 9).alias("true_rate"), F.round("predicted_rate", 9).alias("predicted_rate"))


_F1 = "round(coalesce(2 * count(*) filter (y = 1 and p = 1 and {0}) / nullif(2 * count(*) filter (y = 1 and p = 1 and {0}) + count(*) filter (y <> p and {0}), 0), 0), 9)"


@query(f"with {P}, {_FLAGS.replace('select id,', 'select id, proba,')}, s as (select *, case when proba > 0.8 or proba < 0.2 then 'H' when proba > 0.6 or proba < 0.4 then 'M' else 'L' end as sure from m) select method, {_F1.format('true')} as f1, {_F1.format(chr(39).join(['sure in (', 'H', ', ', 'M', ')']))} as f1_confident from s group by method")
def confidence_subset(spark, sf_dir):
    sure = papers(spark, sf_dir).select("id", F.expr("case when proba > 0.8 or proba < 0.2 then 'H' when proba > 0.6 or proba < 0.4 then 'M' else 'L' end").alias("sure"))
    out = evaluation.confident_f1(flagged(spark, sf_dir).join(sure, "id"), ["method"], F.col("y"), F.col("p"), "sure")
    return out.select("method", F.round("f1", 9).alias("f1"), F.round("f1_confident", 9).alias("f1_confident"))


_SPACED = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))".format(text_sql("title"))
_IMPACT = impact_sql("src as (select *, {} as cat from p)".format(CATEGORY), "author", "citationCount", "cat = 'survey'").removeprefix("with ")


@query(f"""with {P}, seen as (select distinct {_SPACED} as k from p where Label = '0'), i as (with {_IMPACT}), c as (select author, count(*) filter ({CATEGORY} = 'non-paper')::bigint as non_papers, count(seen.k)::bigint as in_training from p left join seen on {_SPACED} = seen.k group by author),
nm as (select author, name from (select author, name, row_number() over (partition by author order by count(*) desc, name) as rn from (select author, trim(unnest(string_split(authors, ';'))) as name from p) where name <> '' group by author, name) where rn = 1)
select i.author, papers, surveys, citations, citations_kept, h_index, h_index_kept, h_drop, round(i10_reduction, 6) as i10_reduction, non_papers, in_training, nm.name from i join c on i.author = c.author left join nm on i.author = nm.author""")
def author_report(spark, sf_dir):
    p = papers(spark, sf_dir)
    out = evaluation.author_report(p, "author", category(), p.filter("Label = '0'").select("title"))
    return out.select("author", "papers", "surveys", "citations", "citations_kept", "h_index", "h_index_kept", "h_drop", F.round("i10_reduction", 6).alias("i10_reduction"), "non_papers", "in_training", "name")


_BY_METHOD = f"""m as (select author, citationCount, unnest(['Keyword only', 'Title phrases', 'Indexer type', 'Strict phrases']) as method, unnest([{KEYWORD}, {TOOL}, {INDEXER}, {STRICT}]) as o from p),
f as (select author || '|' || method as g, citationCount, o from m), a as ({h_sql('f', 'g', 'citationCount')}), b as ({h_sql('f', 'g', 'citationCount', 'not o')}),
t as (select split_part(a.g, '|', 1) as author, split_part(a.g, '|', 2) as method, 100 * (a.papers - coalesce(b.papers, 0)) / a.papers::double as excluded, 100 * (a.citations - coalesce(b.citations, 0)) / greatest(1, a.citations)::double as citations, a.h_index - coalesce(b.h_index, 0) as h_drop from a left join b on a.g = b.g)"""
_NAMES = [f"Author {i}" for i in range(20)]
_MEANS = "round(avg(excluded){0}, 6) as excluded{1}, round(avg(citations){0}, 6) as citations{1}, round(avg(h_drop){0}, 6) as h_drop{1}"


def _by_method(spark, sf_dir):
    p = papers(spark, sf_dir)
    return indices.by_method(p, "author", pipelines.method_flags(*(F.col(c) for c in ("title", "abstract", "venue", "type"))))


@query(f"with {P}, {_BY_METHOD} select method, {_MEANS.format('', '')}, " + ", ".join(f"max(h_drop) filter (author = '{n}') as \"{n}\"" for n in _NAMES) + " from t group by method")
def method_pivot(spark, sf_dir):
    out = evaluation.method_table(_by_method(spark, sf_dir), "author", _NAMES)
    return out.select("method", *[F.round(c, 6).alias(c) for c in ("excluded", "citations", "h_drop")], *_NAMES)


_FIRST = "author in ('Author 1', 'Author 2', 'Author 3', 'Author 4', 'Author 5')"


@query(f"with {P}, {_BY_METHOD} select method, " + ", ".join(_MEANS.format(f" filter ({test})", tag) for test, tag in ((_FIRST, "_a"), (f"not ({_FIRST})", "_b"))) + " from t group by method")
def cohort_comparison(spark, sf_dir):
    t = _by_method(spark, sf_dir)
    out = evaluation.cohort_comparison(t.filter(_FIRST), t.filter(f"not ({_FIRST})"))
    return out.select("method", *[F.round(f"{c}_{x}", 6).alias(f"{c}_{x}") for x in "ab" for c in ("excluded", "citations", "h_drop")])


_H = f"h as ({h_sql('lineitem', 'l_suppkey', 'l_quantity')})"


@query(f"""with {_H}, n as (select h.*, coalesce(c.few, 0)::bigint as few from h left join (select l_suppkey, count(*) as few from lineitem where l_returnflag = 'R' group by 1) c on h.l_suppkey = c.l_suppkey),
co as (select * from n where l_suppkey <= 3), top as (select * from n order by papers desc, l_suppkey limit 60)
select l_suppkey, papers, h_index, few from top where l_suppkey not in (select l_suppkey from co) and h_index between (select min(h_index) from co) and (select max(h_index) from co) and few <= 200 order by papers desc, l_suppkey limit 5""")
def cohort_select(spark, sf_dir):
    """The first five of sixty candidates whose h-index lies in a cohort's range and who have few works of a kind."""
    lines = table(spark, sf_dir, "lineitem")
    few = lines.filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("few"))
    rows = indices.h_index(lines, ["l_suppkey"], "l_quantity").join(few, "l_suppkey", "left").na.fill(0, ["few"])
    out = evaluation.select_cohort(rows, rows.filter("l_suppkey <= 3"), "l_suppkey", "h_index", "papers", "few", 200)
    return out.select("l_suppkey", "papers", "h_index", "few")


@query(f"""with {P}, w as (select author, '10.1/' || id as doi, coalesce(citationCount, 0) as c, authors from p where type is not null), t as (select *, row_number() over (partition by author order by c desc, doi) as rn from w),
a as (select author, trim(unnest(string_split(authors, ';'))) as name from t where rn <= 300)
select author, 'id ' || name as author_id, name as author_name from a where split_part(name, ' ', 2) = split_part(author, ' ', 2) group by all""")
def ids_by_doi(spark, sf_dir):
    """Author ids on the most cited works with a DOI whose name is the person's."""
    p = papers(spark, sf_dir)
    works = p.filter("type is not null").select("author", F.col("author").alias("name"), F.concat(F.lit("10.1/"), "id").alias("doi"), "citationCount")
    people = F.transform(F.split("authors", ";"), lambda n: F.struct(F.concat(F.lit("id "), F.trim(n)).alias("id"), F.trim(n).alias("name")))
    records = p.select(F.concat(F.lit("10.1/"), "id").alias("doi"), people.alias("authors"))
    return evaluation.ids_by_doi(works, records, "author", "name")


@query("""with w as (select o_custkey as author, o_orderpriority as i, count(*)::bigint as n from orders group by all), t as (select author, sum(n) as works from w group by author),
top as (select w.author, i as institution, n / works as share, row_number() over (partition by w.author order by n desc, i) as rn from w join t on w.author = t.author),
o as (select o_custkey as author, round(100 * count(*) filter (o_orderstatus <> 'F') / count(*), 9) as outside from orders group by 1)
select top.author, institution, share, outside from top join o on top.author = o.author where rn = 1""")
def record_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    works = o.select("o_custkey", F.array(F.struct(F.struct(F.col("o_custkey").alias("id")).alias("author"), F.array(F.struct(F.col("o_orderpriority").alias("display_name"))).alias("institutions"))).alias("authorships"))
    fields = o.groupBy(F.col("o_custkey").alias("author"), F.col("o_orderstatus").alias("field")).agg(F.count(F.lit(1)).alias("n"))
    out = evaluation.record_check(matching.affiliations(works, F.col("o_custkey")), fields, "author", ("F",))
    return out.select("author", "institution", "share", F.round("outside", 9).alias("outside"))


@query(f"with {P}, t as (select {key_sql('title')} as k from p where year < 2018) select id from p where year >= 2018 and {key_sql('title')} not in (select k from t)")
def unseen_papers(spark, sf_dir):
    """Papers whose titles no model was trained on."""
    p = papers(spark, sf_dir)
    return evaluation.unseen(p.filter("year >= 2018"), "title", p.filter("year < 2018").select("title")).select("id")


@query(f"""with {P}, r as (select coalesce(venue, '') as venue, case when {text_sql('title')} = '' or {words_sql(text_sql('abstract'))} < {V.MIN_WORDS_TRAIN} or {has_sql(text_sql('title'), V.JUNK_TITLES)} then 'unusable' else 'usable' end as reason from p) select venue, reason, count(*)::bigint as n from r group by all""")
def venue_counters(spark, sf_dir):
    """Usable and unusable records of each venue."""
    p = papers(spark, sf_dir).select(X.text_of(F.col("venue")).alias("venue"), X.text_of(F.col("title")).alias("t"), X.text_of(F.col("abstract")).alias("a"))
    return p.select("venue", F.when(rules.usable_record(F.col("t"), F.col("a")), "usable").otherwise("unusable").alias("reason")).groupBy("venue", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {P} select id, row_number() over (order by {_HASH}, id)::int as place from p")
def global_shuffle(spark, sf_dir):
    return sampling.shuffled(papers(spark, sf_dir).select("id"), "id", 42)


@query(f"with {P} select id, case when {has_sql(text_sql('title'), V.TITLE_TERMS)} then 'title_kw' when {has_sql(text_sql('abstract'), V.SAMPLER_CUE)} then 'abstract_cue' else 'random' end as stratum from p")
def strata(spark, sf_dir):
    return papers(spark, sf_dir).select("id", rules.stratum(X.text_of(F.col("title")), X.text_of(F.col("abstract"))).alias("stratum"))
