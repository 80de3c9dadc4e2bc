"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dart_minhash, hamerly, html_extract, language_id, mixing, multi_index, packing, quality_rules, suffix_dedup, token_alignment, toxicity, url_filter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> tuple[str, str]:
    """Rank file and split pattern of the public byte-level vocabulary with 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def alignment_paths() -> tuple[str, str, str]:
    """Rank file and split pattern of the byte-level vocabulary and the model of the one with byte fallback."""
    import public_tokenizers

    return *vocabulary(), public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"), keep=None).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry=["doc_id"])
    return out.select("_row.doc_id", "language", "posterior", F.col("accepted").alias("kept"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicate_classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(_read(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), *vocabulary())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), carry=["doc_id"]).select("_row.doc_id", "size", "source_size", "target", "taken")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_read(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_read(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), carry=["doc_id"])
    return out.select("_row.doc_id", "held_out", "score", "predicted")


def op12_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hamerly.cluster_vectors(_read(spark, sf_dir, "embeddings"), carry=["vec_id"])
    return out.select("_row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_alignment.align_tokens(_read(spark, sf_dir, "documents"), *alignment_paths(), carry=["doc_id"])
    return out.select("_row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_dedup, op2_language_id, op3_warc, op4_dart_minhash, op5_multi_index, op6_packing, op7_url_filter, op8_mixing, op9_html_extract, op10_quality_rules,
        op11_toxicity, op12_hamerly, op13_token_alignment,
    )
    return {f.__name__: f for f in found}


OP3_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as hex from p),
b as (
  select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
    min(page_id) over (partition by hex, payload_bytes) as first_id
  from d)
select page_id, payload_bytes, payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from b
"""

OP10_SQL = r"""
with t as (select doc_id, source, coalesce(text, '') as b from documents),
w as (
  select doc_id, source, b, regexp_extract_all(b, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from t),
h as (
  select *, case when len(w) < 3 then [] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end as g
  from w),
u as (select doc_id, source, unnest(g) as g, generate_subscripts(g, 1) as i from h),
r as (select doc_id, source, i from (select *, count(*) over (partition by doc_id, source, g) as n from u) where n > 1),
c as (select doc_id, source, count(distinct i + k)::bigint as n_repeat_words from r, (select unnest([0, 1, 2]) as k) group by all),
f as (
  select h.doc_id, h.source, len(w)::bigint as n_words, length(regexp_replace(b, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(b) - length(regexp_replace(b, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l)::bigint as n_lines,
    coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words
  from h left join c on h.doc_id = c.doc_id and h.source is not distinct from c.source),
q as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    (n_symbols > 0.5::double * n_words)::int as f_symbols, (n_dup_lines > 0.5::double * n_lines)::int as f_lines,
    (word_chars > 15.0::double * n_words)::int as f_long
  from f),
s as (
  select source, count(*)::double as n, sum(base_failed::int)::double as a, sum(f_symbols)::double as b, sum(f_lines)::double as c, sum(f_long)::double as d
  from q group by source),
e as (select source, n, unnest([1, 2, 3, 4]) as rule, unnest([a, b, c, d]) as f from s),
m as (select rule, sum(f) / sum(n) as m from e group by rule),
v as (select e.rule, any_value(m.m) as m, avg((f / n - m.m) * (f / n - m.m)) as v from e join m on e.rule = m.rule group by e.rule),
z as (select rule, m, case when v > 0 then least(greatest(m * (1 - m) / v - 1, 1.0), 10000.0) else 10000.0 end as k from v),
x as (select source, bool_or((f + m * k) / (n + k) > 0.5) as host_failed from e join z on e.rule = z.rule group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_failed as kept
from q join x on q.source is not distinct from x.source
"""


def _clusters_sql(rounds: int = 3) -> str:
    """Every vector against every centroid, round by round."""
    parts = ["""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as x
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
s as (select *, row_number() over (order by sha256('1:' || vec_id)) as c from v),
c0 as (select c, x from s where c <= 16)"""]
    for i in range(rounds + 1):
        parts.append(f"""
d{i} as (select vec_id, v.x, c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c{i}.x[i]) * (v.x[i] - c{i}.x[i])))::bigint as d from v, c{i}),
a{i} as (select * from d{i} qualify row_number() over (partition by vec_id order by d, c) = 1)""")
        if i < rounds:
            parts.append(f"""
u{i} as (select c, unnest(x) as x, generate_subscripts(x, 1) as i from a{i}),
m{i} as (select c, i, sum(x)::bigint as s, count(*) as n from u{i} group by c, i),
n{i} as (select c, list((s - ((s % n) + n) % n) // n order by i) as x from m{i} group by c),
c{i + 1} as (select c, coalesce(n{i}.x, c{i}.x) as x from c{i} left join n{i} using (c))""")
    return ",".join(parts) + f"""
select vec_id, (c - 1)::int as cluster, d as distance, sum(d) over (partition by c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
  sha256(array_to_string(c{rounds}.x, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (c)
"""


OP12_SQL = _clusters_sql()


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op10_quality_rules": OP10_SQL, "op12_hamerly": OP12_SQL}
