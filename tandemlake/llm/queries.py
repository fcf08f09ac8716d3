"""Registered queries of the training-data operators, op1 to op13, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, importance, jaccard_join, language_id, license_scan, line_dedup, lm_scoring, mixing, nn_descent, packing, token_alignment, token_counts, url_filter
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(read(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op3_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(read(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(read(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents labelled as of good quality."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.difference(read(spark, sf_dir, "documents"), good)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.linked(read(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files named source/lang/doc_id, a null source or language as `-`, a null doc_id by its text's hash."""
    docs = read(spark, sf_dir, "documents")
    part = [F.coalesce(F.translate(c, "/", "_"), F.lit("-")) for c in ("source", "lang")]
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("without-id-"), F.coalesce(F.md5("text"), F.lit(""))))
    out = license_scan.scanned(docs.select(F.concat_ws("/", *part, name).alias("path"), "text"))
    return out.select(F.element_at(F.split("path", "/"), -1).try_cast("long").alias("doc_id"), "license", "score", "origin", "license_dir")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dropped(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.linked(read(spark, sf_dir, "documents"))
    return found.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: the texts of benchmark."""
    return importance.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: op2_source_mix and the like, by name.
QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_counts, op2_source_mix, op3_sequence_packing, op4_document_fingerprint, op5_lm_scoring, op6_embedding_near_dedup, op7_url_filter, op8_license_scan, op9_jaccard_join, op10_language_id, op11_line_dedup, op12_token_alignment, op13_importance_resampling)}

OP2_SQL = r"""
with d as (
  select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5('mix-1:' || coalesce(cast(doc_id as varchar), md5(text), 'null')), 1, 13) as bigint) as bits,
    coalesce(length(text), 0) as chars from documents),
k as (select *, chars / greatest(size, 1) as mean from d),
m as (select doc_id, source, size, -ln((bits + 0.5) / 4503599627370496.0)
    / case when mean between 3 and 10 then 1.0 when mean between 2 and 16 then 0.75 else 0.5 end as k from k),
s as (select source, cast(sum(size) as bigint) as source_size from m group by source),
p as (select *, row_number() over (order by source nulls last) as place from s),
w as (select *, [3.0, 1.0, 2.0][(place - 1) % 3 + 1]::double as weight, source_size * 2.0::double as most from p),
l as (select *, sum(source_size) over () * 1.5::double as total, sum(weight) over () as weights,
    coalesce(sum(most) over o, 0) as full_size, coalesce(sum(weight) over o, 0) as gone from w
    window o as (order by most / weight, place rows between unbounded preceding and 1 preceding)),
v as (select *, (total - full_size) / (weights - gone) as level from l),
lev as (select arg_min(level, most / weight) as level from v where most / weight >= level),
t as (select source, source_size, round(least(most, coalesce((select level from lev) * weight, most)), 6) as target from v),
e as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
x as (select m.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    sum(m.size) over (partition by m.source order by k, m.size, m.doc_id rows between unbounded preceding and current row) as upto
    from m join e on m.source is not distinct from e.source),
c as (select *, epochs + case when source_size > 0 and upto - size / 2 <= rest then 1 else 0 end as copies from x)
select doc_id, size::bigint as size, source_size, target::double as target, (size * copies)::bigint as taken, source, copies::bigint as copies from c
"""

OP7_SQL = r"""
with u as (select page_id, url, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') as h,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered from pages),
p as (select *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from u),
j as (select page_id, host, path, lowered,
    case when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
         when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
         when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
         when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/' end as rule,
    case when regexp_matches(lowered, '/wp-login\.php') then 'login' when regexp_matches(lowered, '://([^/?#]*[^a-z0-9_/?#])?casino([^a-z0-9_]|$)') then 'casino'
         when regexp_matches(lowered, '^[^?#]*\.(exe)(\?|#|$)') then 'binary' when regexp_matches(lowered, '^[^?#]*\.(zip)(\?|#|$)') then 'archive'
         when regexp_matches(lowered, '://([^/?#]*[^a-z0-9_/?#])?porn([^a-z0-9_]|$)') then 'adult' when regexp_matches(lowered, '/wp-admin/') then 'admin'
         when regexp_matches(lowered, '://([^/?#]*\.)?doubleclick\.') then 'ad-server' end as pattern_rule from p)
select page_id, host, path, rule, pattern_rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
       when pattern_rule is not null then 'block' else 'allow' end as verdict from j
"""

OP11_SQL = r"""
with d as (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
l as (select n, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as place from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key from k where key <> '' group by key having count(distinct n) >= 10)
select doc_id, count(*)::bigint as n_lines, count(r.key)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where r.key is null), '')) as kept_sha256
from k left join r on k.key = r.key group by n, doc_id
"""

ORACLE_SQL: dict[str, str] = {"op2_source_mix": OP2_SQL, "op7_url_filter": OP7_SQL, "op11_line_dedup": OP11_SQL}
