"""A publication table derived from documents by expressions that every SQL engine reads alike.

The invented prose of documents holds none of the cues that the rules look for, so titles, types, venues and the first
words of abstracts come from templates chosen by doc_id. Abstracts are reduced to ASCII: engines differ on word
boundaries next to accented letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TITLES = (
    "'A Survey of Topic '", "'Review: Methods for Class '", "'Fast Routing for Network '", "'Guest Editorial: Issue '", "'Corrigendum to Paper '",
    "'<b>Tutorial</b> on $x^2$ for \\emph{item} '", "'Adaptive Coding Scheme in Wide Band Links '", "'Adaptive Coding Scheme in Wide Band Links '", "'State-of-the-art and Taxonomy '", "null",
    "'Обзор методов'", "'Trends and Challenges in Area '", "'Overview of Field '", "'Analysis of Data Set '", "'Roadmap '", "'Numerical Results for Case '",
)
_TYPES = ("article", "review", "article", "editorial", "erratum", "article", "preprint", "article", "review", None, "article", "JournalArticle; Review", "book-chapter", "dataset", "", "conference-paper")
_VENUES = ("IEEE Network", "ACM Computing Surveys", "IEEE Transactions on X", "IEEE Communications Magazine", "Computer", "arXiv.org", "arXiv (Cornell University)", "IEEE Transactions on X", "Proceedings of the IEEE", None, "", "Trends in Y", "Springer", "Zenodo", "", "IEEE Micro")
_CUES = {0: "This survey provides an overview of open issues. ", 1: "Abstract: We review the field, a literature review. ", 2: "We propose a scheme. Simulation results show it outperforms. ", 5: "In this article, we design a code. ", 8: "We summarize the existing work; future research directions follow. "}


def _choose(values: tuple) -> str:
    quoted = ("null" if v is None else "'" + v + "'" for v in values)
    return "case doc_id % 16 " + " ".join(f"when {i} then {v}" for i, v in enumerate(quoted)) + " end"


def columns() -> dict[str, str]:
    """Column name -> expression over documents."""
    titles = " ".join(f"when {i} then {t}" + ("" if i in (9, 10) else " || cast((doc_id - doc_id % 16) / 16 as bigint)" if i in (6, 7) else " || cast(doc_id as bigint)") for i, t in enumerate(_TITLES))
    cues = " ".join(f"when {i} then '{c}'" for i, c in _CUES.items())
    return {
        "id": "cast(doc_id as bigint)",
        "author": "'Author ' || cast(doc_id % 20 as bigint)",
        "authors": "'Author ' || cast(doc_id % 20 as bigint) || '; Author ' || cast(doc_id % 7 as bigint)",
        "title": f"case doc_id % 16 {titles} end",
        "abstract": f"case when doc_id % 16 = 14 then null when doc_id % 16 = 12 then '' else (case doc_id % 16 {cues} else '' end) || regexp_replace(text, '[^ -~]', ''@G) end",
        "venue": _choose(_VENUES),
        "type": _choose(_TYPES),
        "year": "cast(2010 + doc_id % 15 as int)",
        "citationCount": "case when doc_id % 29 = 0 then null else cast((doc_id * 37) % 101 as double) end",
        "references": "case doc_id % 4 when 0 then 'a; b; ; c' when 1 then '' when 2 then 'x' else null end",
        "Label": "case when doc_id % 11 = 0 then 'skip' when doc_id % 16 in (0, 1, 5, 8, 12) then '0' else '1' end",
        "Stratum": "case doc_id % 3 when 0 then 'title_kw' when 1 then 'abstract_cue' else 'random' end",
        "StratumWeight": "case doc_id % 3 when 0 then 1.5e0 when 1 then 2.25e0 else 4e0 end",
        "proba": "cast((doc_id * 7919) % 1000 as double) / 1000e0",
    }


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr(*[f"{e.replace('@G', '').replace(chr(92), chr(92) * 2)} as {n}" for n, e in columns().items()])


def papers_sql() -> str:
    """The same table as a DuckDB query."""
    return "select " + ", ".join(f"{e.replace('@G', ', ' + chr(39) + 'g' + chr(39))} as {n}" for n, e in columns().items()) + " from documents"
