"""The queries of problems 4 and 5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.spelling import canonical_model, squeezed
from tracemill.operators import delivery, drift
from tracemill.session import table

def _messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    r = canonical_model(table(spark, sf_dir, "results"), table(spark, sf_dir, "model_registry"))
    return r, [F.col("model_key"), squeezed(F.col("case_id"))]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = _messages(spark, sf_dir)
    rows = rows.select("model_key", "case_id", "error", "seq", "batch")
    index = delivery.index_of(rows, keys, F.col("error"), F.col("seq"), F.col("batch"))
    return delivery.redundant(rows, index, keys).select("seq")


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = _messages(spark, sf_dir)
    index = delivery.index_of(rows, keys, F.col("error"), F.col("seq"), F.col("batch"))
    return delivery.deduplicated(rows, index, keys).select("seq", "model_key", squeezed(F.col("case_id")).alias("case_key"), "batch")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.found(table(spark, sf_dir, "raw_results"))


def p5_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.headers(table(spark, sf_dir, "raw_results"))


def p5_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.log(table(spark, sf_dir, "raw_results"))


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified(table(spark, sf_dir, "raw_results"))


QUERIES = {"p4_found": p4_found, "p4_kept": p4_kept, "p5_found": p5_found, "p5_headers": p5_headers, "p5_log": p5_log, "p5_unified": p5_unified}

_EDGE = r"[\s\p{Z}\p{Cc}\p{Cf}]+"


def _squeezed(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({c}, '^{_EDGE}|{_EDGE}$', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


_RANKED = f"""
names as (select {_squeezed('n')} nm, min({_squeezed('model')}) k from (select model, unnest([model, display_name, route]) n from model_registry) group by 1),
keyed as (select r.seq, r.batch, coalesce(n.k, {_squeezed('r.model')}) mk, {_squeezed('r.case_id')} ck,
  coalesce(regexp_replace(r.error, '[\\s\\p{{Z}}\\p{{Cf}}]+', '', 'g'), '') <> '' bad
  from results r left join names n on n.nm = {_squeezed('r.model')}),
ranked as (select *, row_number() over (partition by mk, ck order by bad, seq desc) rn from keyed)
"""
ORACLE = {
    "p4_found": f"with {_RANKED} select seq from ranked where rn > 1 and mk is not null and ck is not null",
    "p4_kept": f"with {_RANKED} select seq, mk as model_key, ck as case_key, batch from ranked where rn = 1 or mk is null or ck is null",
    "p5_headers": """with v as (select run_id, file_no, line from raw_results where run_id is not null and file_no is not null and json_valid(line) and json_type(case when json_valid(line) then line end) = 'OBJECT'),
one as (select v.run_id, v.file_no, k.key, json_type(line, '$."' || k.key || '"') t, json_extract(line, '$."' || k.key || '"') x from v, (select distinct unnest(json_keys(line)) as key, line as l from v) k where k.l = v.line),
two as (select run_id, file_no, key || '.' || k2 as path, json_type(x, '$."' || k2 || '"') t from (select run_id, file_no, key, x, unnest(json_keys(x)) k2 from one where t = 'OBJECT')),
cells as (select run_id, file_no, key as path, t from one where t <> 'OBJECT' or len(json_keys(x)) = 0 union all select * from two),
kinds as (select run_id, file_no, path, list(distinct case t when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end) filter (where t <> 'NULL') k from cells group by 1, 2, 3)
select run_id, file_no, path, case when len(k) = 1 then k[1] when len(k) > 1 then 'mixed' end as kind from kinds""",
}
