"""Queries over the reference's own operators, with an independent SQL form where SQL can say it.

The labels view maps events: model = half of the month, cluster = user, condition = event type,
absorbed = value above 50, latest by (ts, event_id). Doubles are rounded to nine places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import compose, stats, text
from tracemill.functions.spelling import squeezed
from tracemill.operators import audit, building, labels, mining, scoring
from tracemill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.when(F.dayofmonth("ts") <= 15, "m1").otherwise("m2").alias("model"), F.col("user_id").alias("cluster"), F.col("event_type").alias("condition"), (F.col("value") > 50).alias("absorbed"), "ts", "event_id")
    return labels.latest(e, ["model", "cluster", "condition"], ["ts", "event_id"]).select("model", "cluster", "condition", "absorbed")


L = """labels as (select model, cluster, condition, absorbed from (select *, row_number() over (partition by model, cluster, condition order by ts desc, event_id desc) rn from
 (select case when day(ts) <= 15 then 'm1' else 'm2' end model, user_id cluster, event_type condition, value > 50 absorbed, ts, event_id from events)) where rn = 1)"""
CELLS = f"""{L}, conds as (select min(condition) c1, max(condition) c2 from labels),
cells as (select x.model, count(*) filter (where x.absorbed and y.absorbed)::bigint e11, count(*) filter (where x.absorbed and not y.absorbed)::bigint e10,
 count(*) filter (where not x.absorbed and y.absorbed)::bigint e01, count(*) filter (where not x.absorbed and not y.absorbed)::bigint e00
 from labels x join labels y on x.model = y.model and x.cluster = y.cluster, conds where x.condition = c1 and y.condition = c2 group by 1)"""


def _pair(df: DataFrame) -> tuple[str, str]:
    r = df.agg(F.min("condition"), F.max("condition")).first()
    return r[0] or "", r[1] or ""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    lab = _labels(spark, d)
    return labels.cells(lab, *_pair(lab))


@query(f"with {L} select model, cluster, condition, absorbed from labels")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d)


@query(f"""with {L}, r as (select model, condition, count(*) n, count(*) filter (where absorbed) k from labels group by 1, 2), z as (select 1.959963984540054 z)
select model, condition, n, k as absorbed, round(k / n, 9) as rate,
 round(greatest(0, (k / n + z*z/(2*n)) / (1 + z*z/n) - z * sqrt((k/n) * (1 - k/n) / n + z*z/(4*n*n)) / (1 + z*z/n)), 9) as low,
 round(least(1, (k / n + z*z/(2*n)) / (1 + z*z/n) + z * sqrt((k/n) * (1 - k/n) / n + z*z/(4*n*n)) / (1 + z*z/n)), 9) as high from r, z""")
def rates_wilson(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labels.rates(_labels(spark, d), ["model", "condition"]))


@query(f"with {L} select model, condition, count(*) n, round(1 - pow(0.025, 1.0 / count(*)), 9) as upper from labels group by 1, 2")
def zero_upper(spark: SparkSession, d: str) -> DataFrame:
    g = _labels(spark, d).groupBy("model", "condition").agg(F.count("*").alias("n"))
    return rounded(g.select("model", "condition", "n", stats.zero_upper(F.col("n")).alias("upper")))


@query(f"with {CELLS} select * from cells")
def paired_2x2(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


@query(f"""with recursive {CELLS}, b as (select model, e10 + e01 n, least(e10, e01) k from cells),
t as (select model, n, k, 0 as i, -n * ln(2.0) as l from b union all select model, n, k, i + 1, l + ln((n - i)::double / (i + 1)) from t where i < k)
select model, n as discordant, round(case when n = 0 then 1.0 else least(1.0, 2 * sum(exp(l))) end, 9) as p from t group by model, n""")
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    return rounded(c.select("model", (F.col("e10") + F.col("e01")).alias("discordant"), stats.mcnemar(F.col("e10"), F.col("e01")).alias("p")))


@query(f"""with {CELLS}, a as (select *, (e11+e10+e01+e00)::double n, (e11+e10)::double a, (e11+e01)::double b, 1.959963984540054 z from cells),
w as (select *, a/n p1, b/n p2, (a/n + z*z/(2*n))/(1+z*z/n) m1, z*sqrt(a/n*(1-a/n)/n + z*z/(4*n*n))/(1+z*z/n) h1, (b/n + z*z/(2*n))/(1+z*z/n) m2, z*sqrt(b/n*(1-b/n)/n + z*z/(4*n*n))/(1+z*z/n) h2,
 case when a*(n-a)*b*(n-b) > 0 then (e11::double*e00 - e10::double*e01)/sqrt(a*(n-a)*b*(n-b)) else 0 end phi from a),
x as (select *, p1-(m1-h1) dl, (m2+h2)-p2 du, (m1+h1)-p1 eu, p2-(m2-h2) el from w)
select model, round(p1-p2, 9) as diff, round(greatest(-1, p1-p2-sqrt(greatest(0, dl*dl-2*phi*dl*du+du*du))), 9) as low, round(least(1, p1-p2+sqrt(greatest(0, eu*eu-2*phi*eu*el+el*el))), 9) as high from x""")
def newcombe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labels.contrast(_cells(spark, d)).select("model", "diff", "low", "high"))


@query(f"""with {L}, r as (select model, condition, count(*) n, count(*) filter (where absorbed) k from labels group by 1, 2), p as (select model, condition, abs(k / n - 0.5) as pv from r),
s as (select *, count(*) over (partition by model) - row_number() over (partition by model order by pv, condition) + 1 as m, row_number() over (partition by model order by pv, condition) rk from p)
select model, condition, round(pv, 9) as pv, round(least(1.0, max(m * pv) over (partition by model order by rk rows unbounded preceding)), 9) as p_holm from s""")
def holm_family(spark: SparkSession, d: str) -> DataFrame:
    r = labels.rates(_labels(spark, d), ["model", "condition"]).select("model", "condition", F.abs(F.col("rate") - 0.5).alias("pv"))
    return rounded(labels.holm(r, "pv", ["model"], ["condition"]))


@query(f"""with {L} select x.condition, count(*) filter (where x.absorbed and y.absorbed)::bigint e11, count(*) filter (where x.absorbed and not y.absorbed)::bigint e10,
 count(*) filter (where not x.absorbed and y.absorbed)::bigint e01, count(*) filter (where not x.absorbed and not y.absorbed)::bigint e00
 from labels x join labels y on x.condition = y.condition and x.cluster = y.cluster where x.model = 'm1' and y.model = 'm2' group by 1""")
def between_models(spark: SparkSession, d: str) -> DataFrame:
    return labels.between(_labels(spark, d), "m1", "m2")


GRADIENT = f"""{L}, conds as (select min(condition) c1, max(condition) c2 from labels), g as (select model, cluster, bool_or(absorbed) a from labels, conds where condition in (c1, c2) group by 1, 2),
gr as (select model, c_mktsegment as source, count(*)::bigint n, count(*) filter (where a)::bigint k from g join customer on c_custkey = cluster group by 1, 2)"""


@query(f"with {GRADIENT} select * from gr")
def genre_gradient(spark: SparkSession, d: str) -> DataFrame:
    lab = _labels(spark, d)
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("cluster"), F.col("c_mktsegment").alias("source"))
    return labels.gradient(lab, sources, list(_pair(lab)))


# the same by another way: running sums of logarithms over all tables, no closed form and no window
@query(f"""with recursive {GRADIENT}, a as (select model, source, n as n1, k as k1, lead(source) over w as next, lead(k) over w as k2, lead(n) over w as n2 from gr window w as (partition by model order by source)),
b as (select *, greatest(0, k1 + k2 - n2) lo, least(n1, k1 + k2) hi from a where next is not null), f(i, l) as (select 0::bigint, 0.0::double union all select i + 1, l + ln(i + 1) from f where i < 400000 and i < (select max(n1 + n2) from b)),
t as (select b.*, x, (select l from f where i = n1) - (select l from f where i = x) - (select l from f where i = n1 - x) + (select l from f where i = n2) - (select l from f where i = k1 + k2 - x) - (select l from f where i = n2 - k1 - k2 + x) as lp from (select *, unnest(range(lo, hi + 1)) x from b) b),
m as (select model, source, next, lp - ln(sum(exp(lp - m)) over (partition by model, source)) - m as lp, x = k1 as seen from (select *, max(lp) over (partition by model, source) m from t))
select r.model, r.source, any_value(g.n) n, any_value(g.k) k, r.next, any_value(g2.k) k2, any_value(g2.n) n2, round(least(1.0, sum(exp(r.lp)) filter (where r.lp <= s.lp + 1e-9)), 9) as p
 from m r join m s on s.model = r.model and s.source = r.source and s.seen join gr g on g.model = r.model and g.source = r.source join gr g2 on g2.model = r.model and g2.source = r.next group by r.model, r.source, r.next""")
def adjacent_fisher(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labels.adjacent(genre_gradient(spark, d), "model", "source", "k", "n"))


@query(f"""with {L}, r as (select cluster, count(*) filter (where absorbed and model = 'm1') x, count(*) filter (where absorbed and model = 'm2') y from labels group by 1),
k as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 ry from r)
select count(*) n, round(case when stddev_pop(rx) * stddev_pop(ry) > 1e-12 then corr(rx, ry) else 0 end, 9) rho from k""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    r = _labels(spark, d).groupBy("cluster").agg(F.count_if(F.col("absorbed") & (F.col("model") == "m1")).alias("x"), F.count_if(F.col("absorbed") & (F.col("model") == "m2")).alias("y"))
    return rounded(labels.spearman(r, "x", "y"))


@query()
def spearman_permutation(spark: SparkSession, d: str) -> DataFrame:
    r = labels.rates(_labels(spark, d), ["model", "condition"])
    return labels.permutation_p(r, "rate", "n")


@query()
def lever_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    lab = _labels(spark, d)
    return labels.lever(lab, *_pair(lab))


CONF = """g as (select o_orderpriority grp, o_totalprice > 150000 p, o_orderstatus = 'F' q from orders), t as (select grp, count(*) filter (where p and q)::bigint tp, count(*) filter (where p and not q)::bigint fp,
 count(*) filter (where not p and q)::bigint fn, count(*) filter (where not p and not q)::bigint tn from g group by 1)"""


@query(f"""with {CONF}, m as (select *, (tp+fp+fn+tn)::double n from t), k as (select *, (tp+tn)/n po, ((tp+fp)/n)*((tp+fn)/n) + (1-(tp+fp)/n)*(1-(tp+fn)/n) pe, ((tp+fp)+(tp+fn))/(2*n) q from m)
select grp, tp, fp, fn, tn, round(case when tp+fp=0 then 0 else tp/(tp+fp) end, 9) as precision, round(case when tp+fn=0 then 0 else tp/(tp+fn) end, 9) as recall, round(case when 2*tp+fp+fn=0 then 0 else 2*tp/(2*tp+fp+fn) end, 9) as f1,
 round(po, 9) as accuracy, round(case when pe >= 1 then 1 else (po-pe)/(1-pe) end, 9) as kappa, round((po - 2*q*(1-q))/(1 - 2*q*(1-q)), 9) as ac1 from k""")
def confusion_agreement(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("grp", F.col("o_orderpriority"))
    return rounded(labels.confusion(o, F.col("o_totalprice") > 150000, F.col("o_orderstatus") == "F", ["grp"]))


@query("""with s as (select o_orderpriority grp, o_totalprice x, o_orderstatus = 'F' g from orders), r as (select *, rank() over (partition by grp order by x) + (count(*) over (partition by grp, x) - 1) / 2.0 rk from s)
select grp, round((sum(rk) filter (where g) - count(*) filter (where g) * (count(*) filter (where g) + 1) / 2.0) / (count(*) filter (where g) * count(*) filter (where not g)), 9) as auc from r group by 1""")
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), "o_totalprice", (F.col("o_orderstatus") == "F").alias("g"))
    return rounded(labels.auc(o, "o_totalprice", "g", ["grp"]))


# -- run logs


def _log(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "model_registry")
    return scoring.with_reasons(scoring.run_log(table(spark, d, "results"), reg), scoring.trace_reasons(table(spark, d, "traces"), reg))


def _sq(c: str) -> str:
    e = r"[\s\p{Z}\p{Cc}\p{Cf}]+"
    return rf"lower(regexp_replace(regexp_replace({c}, '^{e}|{e}$', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


def _rs(c: str) -> str:
    return f"case when lower({c}) in ('stop','end_turn','eos') then 'stop' when lower({c}) in ('length','max_tokens') then 'length' else lower({c}) end"


LOG = f"""nm as (select {_sq('n')} nm, min({_sq('model')}) k from (select model, unnest([model, display_name, route]) n from model_registry) group by 1),
lr as (select * from (select coalesce(nm.k, {_sq('r.model')}) model_key, {_sq('r.case_id')} case_key, response, {_rs('finish_reason')} fr, has_finish_reason h, error, seq,
 row_number() over (partition by coalesce(nm.k, {_sq('r.model')}), {_sq('r.case_id')} order by seq desc) rn from results r left join nm on nm.nm = {_sq('r.model')}) where rn = 1),
tr as (select coalesce(nm.k, {_sq('t.request.model')}) model_key, {_sq('t.case_id')} case_key, max({_rs("json_extract_string(case when json_valid(t.response) then t.response end, '$.choices[0].finish_reason')")}) r
 from traces t left join nm on nm.nm = {_sq('t.request.model')} group by 1, 2),
log as (select lr.model_key, lr.case_key, response, case when h then fr else r end finish_reason, error, seq from lr left join tr using (model_key, case_key)),
usable as (select * from log where coalesce(error, '') = '' and coalesce(response, '') <> '' and coalesce(finish_reason, '') <> 'length')"""


@query(f"with {LOG} select model_key, case_key, seq, finish_reason from log")
def resolved_log(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("model_key", "case_key", "seq", "finish_reason")


@query(f"with {LOG} select model_key, case_key, seq from usable")
def usable_filter(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).where(scoring.usable()).select("model_key", "case_key", "seq")


@query(f"""with {LOG}, jobs as (select model_key, case_key from (select distinct {_sq('model')} model_key from model_registry), (select distinct {_sq('id')} case_key from cases where id is not null))
select j.model_key, j.case_key from jobs j where not exists (select 1 from usable u where u.model_key = j.model_key and u.case_key = j.case_key)""")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    models = [r[0] for r in table(spark, d, "model_registry").select(squeezed(F.col("model"))).distinct().orderBy(F.lit(1)).collect()]  # a short list
    return scoring.pending(scoring.jobs(models, table(spark, d, "cases")), _log(spark, d))


STOP = " ".join(text.STOPWORDS)
STEMS = f"""list_distinct(flatten(list_transform(witness_tokens, lambda x: list_filter(regexp_extract_all(lower(x), '[a-z]+'), lambda w: length(w) >= 3 and not list_contains(string_split('{STOP}', ' '), w)))))"""


def _stems(t: str) -> str:
    return f"coalesce(len(stems) > 0 and len(list_filter(stems, lambda s: not regexp_matches(lower({t}), '\\b' || s))) = 0, false)"


def _witness(t: str) -> str:
    return f"coalesce(list_contains(list_transform(witness_tokens, lambda x: contains(lower({t}), lower(x))), true), false)"


@query()
def scored_labels(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(_log(spark, d), table(spark, d, "cases"))


@query()
def scored_rates(spark: SparkSession, d: str) -> DataFrame:
    return labels.rates(scored_labels(spark, d), ["model_key", "condition"])


PLAIN = f"""{LOG}, c as (select {_sq('id')} case_key, composition_event_id cluster, source, condition, witness_tokens, {STEMS} stems from cases where id is not null),
u as (select usable.model_key, c.*, response from usable join c using (case_key)), k as (select model_key, cluster, response as clean from (select *, row_number() over (partition by model_key, cluster order by case_key desc) rn from u where condition = 'clean') where rn = 1),
plain as (select model_key, case_key, cluster, source, condition, case when {_witness('response')} and not {_witness('clean')} then 'lexical_witness' when {_stems('response')} and not {_stems('clean')} then 'lexical_regex' end as tier from u join k using (model_key, cluster) where condition <> 'clean')"""


@query(f"with {PLAIN} select model_key, case_key, cluster, source, condition, tier is not null as absorbed, tier from plain")
def scored_plain(spark: SparkSession, d: str) -> DataFrame:
    """The cascade over whole answers, without extracting spans."""
    return scoring.score(_log(spark, d), table(spark, d, "cases"), spans=False).drop("clean_missing")


@query(f"with {PLAIN} select condition, tier, count(*) as n from plain where tier is not null group by 1, 2")
def scored_plain_tiers(spark: SparkSession, d: str) -> DataFrame:
    return scored_plain(spark, d).where("absorbed").groupBy("condition", "tier").agg(F.count("*").alias("n"))


@query()
def scored_entailed(spark: SparkSession, d: str) -> DataFrame:
    """The whole cascade with the stand-in for a model of entailment."""
    return scoring.score(_log(spark, d), table(spark, d, "cases"), scoring.WordEntailment)


@query()
def scored_tiers(spark: SparkSession, d: str) -> DataFrame:
    return scored_labels(spark, d).where("absorbed").groupBy("tier", "condition").agg(F.count("*").alias("n"))


@query(f"""with {LOG}, c as (select {_sq('id')} case_key, condition, witness_tokens from cases where id is not null)
select u.model_key, u.case_key, coalesce(list_contains(list_transform(witness_tokens, lambda x: contains(lower(response), lower(x))), true), false) as witness from usable u join c using (case_key) where condition <> 'clean'""")
def witness_tier(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").where("id is not null").select(squeezed(F.col("id")).alias("case_key"), "condition", "witness_tokens")
    return _log(spark, d).where(scoring.usable()).join(c, "case_key").where("condition <> 'clean'").select("model_key", "case_key", text.has_witness(F.col("response"), F.col("witness_tokens")).alias("witness"))


@query(f"""with {LOG}, c as (select {_sq('id')} case_key, condition, {STEMS} stems from cases where id is not null)
select u.model_key, u.case_key, {_stems('response')} as stems from usable u join c using (case_key) where condition <> 'clean'""")
def stem_tier(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").where("id is not null").select(squeezed(F.col("id")).alias("case_key"), "condition", "witness_tokens")
    return _log(spark, d).where(scoring.usable()).join(c, "case_key").where("condition <> 'clean'").select("model_key", "case_key", text.has_stems(F.col("response"), F.col("witness_tokens")).alias("stems"))


@query(f"""with {LOG}, c as (select {_sq('id')} case_key, composition_event_id cluster, condition from cases where id is not null), run as (select l.model_key, c.* from log l join c using (case_key))
select s.model_key, c.case_key, l.case_key is not null as row_present from c join (select distinct model_key, cluster from run) s using (cluster) join (select distinct model_key, condition from run) k on k.model_key = s.model_key and k.condition = c.condition
 left join log l on l.model_key = s.model_key and l.case_key = c.case_key""")
def expected_grid(spark: SparkSession, d: str) -> DataFrame:
    return audit.grid(_log(spark, d), table(spark, d, "cases")).select("model_key", "case_key", "row_present")


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return audit.flagged(audit.grid(_log(spark, d), table(spark, d, "cases")))


@query()
def audit_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d)


@query()
def flag_pivot(spark: SparkSession, d: str) -> DataFrame:
    return audit.summary(_flagged(spark, d))


@query()
def paired_flags(spark: SparkSession, d: str) -> DataFrame:
    return audit.paired(_flagged(spark, d), "error", "newline")


_GRID = f"""{LOG}, c as (select {_sq('id')} case_key, composition_event_id cluster, condition from cases where id is not null), run as (select l.model_key, c.* from log l join c using (case_key)),
grid as (select s.model_key, c.case_key, c.cluster, c.condition, l.case_key is not null present, l.response, l.finish_reason, l.error from c join (select distinct model_key, cluster from run) s using (cluster)
 join (select distinct model_key, condition from run) k on k.model_key = s.model_key and k.condition = c.condition left join log l on l.model_key = s.model_key and l.case_key = c.case_key),
flags as (select model_key, case_key, cluster, condition, case when not present then ['missing'] else list_filter([case when coalesce(error, '') <> '' then 'error' end, case when coalesce(response, '') = '' then 'empty_response' end, case when finish_reason = 'length' then 'length_truncated' end,
 case when finish_reason <> 'stop' then 'nonstop_finish' end, case when regexp_matches(left(response, 500), '{text.REFUSAL.replace("'", "''")}') then 'refusal_like' end], lambda x: x is not null) end as f from grid)"""


@query(f"with {_GRID} select model_key, case_key, array_to_string(f, ',') as flags from flags")
def plain_flags(spark: SparkSession, d: str) -> DataFrame:
    """The flags that don't hang on the artifact's span."""
    rows = audit.plain_flags(audit.grid(_log(spark, d), table(spark, d, "cases")))
    return rows.select("model_key", "case_key", F.array_join("flags", ",").alias("flags"))


@query(f"with {_GRID}, one as (select model_key, condition, unnest(f) flag from flags) select model_key, condition, flag, count(*) as n from one group by 1, 2, 3")
def plain_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = audit.plain_flags(audit.grid(_log(spark, d), table(spark, d, "cases")))
    return rows.select("model_key", "condition", F.explode("flags").alias("flag")).groupBy("model_key", "condition", "flag").agg(F.count("*").alias("n"))


@query(f"""with {_GRID}, e as (select model_key, cluster, bool_or(list_contains(f, 'error')) filter (where condition = 'clean') a, bool_or(list_contains(f, 'error')) filter (where condition = 'newline') b from flags group by 1, 2),
p as (select model_key, count(*) filter (where a and b) both_, count(*) filter (where a and not b) x, count(*) filter (where b and not a) y, count(*) filter (where not a and not b) neither from e where a is not null and b is not null group by 1),
t as (select p.*, least(x, y) k, x + y n from p), s as (select model_key, sum(exp(lp)) s from (select model_key, i, n, (select coalesce(sum(ln(n - j + 1) - ln(j)), 0) from range(1, i + 1) r(j)) - n * ln(2) as lp from (select *, unnest(range(0, k + 1)) i from t)) group by 1)
select model_key, both_ as "both", x as clean_only, y as treated_only, neither, round(case when n = 0 then 1.0 else least(1.0, 2 * s) end, 9) as p from t join s using (model_key)""")
def paired_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = audit.plain_flags(audit.grid(_log(spark, d), table(spark, d, "cases")))
    return rounded(audit.paired(rows, "error", "newline"))


@query()
def syntax_rates(spark: SparkSession, d: str) -> DataFrame:
    return audit.syntax_rates(_flagged(spark, d))


# -- text


@query(r"""select doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3 and not list_contains(string_split('a an the my your his her its our their this that these those is are was were be been being to of in on for and or but so i we you they it he she still need needs got get yet again today tomorrow tonight from at', ' '), w))) as n_content from documents where text is not null""")
def content_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(text.content_words(F.col("text"))).cast("long").alias("n_content"))


@query()
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@query("select doc_id, case when length(text) <= 200 then text else left(text, 120) || chr(10) || chr(10) || '...[ARTIFACT BODY TRUNCATED]...' || chr(10) || chr(10) || right(text, 80) end as win from documents where text is not null")
def head_tail_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.windowed(F.col("text"), 200).alias("win"))


@query("""with u as (select c_mktsegment source, sha256(c_name) h, min(c_custkey) item, min(length(c_name)) n from customer group by 1, 2), q as (select *, row_number() over (partition by source order by n, h) - 1 rn, count(*) over (partition by source) t from u),
k as (select source, min(n) filter (where rn >= t // 3) lo, min(n) filter (where rn >= 2 * t // 3) hi from q group by 1), b as (select u.*, case when n <= lo then 0 when n <= hi then 1 else 2 end bucket from u join k using (source)),
r as (select *, row_number() over (partition by source, bucket order by sha256(source || ':' || item)) rank from b), d as (select *, row_number() over (partition by source order by rank, bucket) draw from r)
select source, item, bucket::int as bucket, rank::int as rank from d where draw <= 20""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_name").alias("t"), F.col("c_mktsegment").alias("source"))
    return mining.stratified(c, "item", "t", "source", 20)


@query("select id, substr(sha256(message), 1, 12) as digest, split_part(composition_event_id, ':', 1) as src from cases where message is not null")
def case_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").where("message is not null").select("id", F.substring(F.sha2(F.col("message").cast("binary"), 256), 1, 12).alias("digest"), F.split_part("composition_event_id", F.lit(":"), F.lit(1)).alias("src"))


_BOUND = compose.BOUNDED
MESSAGES = f"""t as (select composition_event_id cl, condition, task_instruction || case when condition = 'mitigation' then ' {_BOUND}' else '' end task, artifact, afterthought, condition in ('boundary', 'mitigation') tagged, substr(sha256(composition_event_id || ':0'), 1, 12) tok
 from cases where task_instruction is not null and artifact is not null and (condition = 'clean' or afterthought is not null)),
h as (select *, task || chr(10) || chr(10) || case when tagged then '<pasted-artifact-' || tok || '>' || chr(10) else '' end as head from t),
m as (select *, head || artifact || case when tagged then chr(10) || '</pasted-artifact-' || tok || '>' else '' end || case condition when 'clean' then '' when 'newline' then chr(10) || afterthought when 'newline_R' then chr(10) || afterthought else chr(10) || chr(10) || afterthought end as msg from h)"""


@query(f"""with {MESSAGES} select cl || ':' || condition || ':' || substr(sha256(msg), 1, 12) as id, sha256(msg) as digest, length(head)::int as artifact_start, (length(head) + length(artifact))::int as artifact_end,
case when condition <> 'clean' then (length(msg) - length(afterthought))::int end as tail_start from m""")
def compose_offsets(spark: SparkSession, d: str) -> DataFrame:
    """All conditions of all cases composed anew."""
    c = table(spark, d, "cases").where("task_instruction is not null and artifact is not null and (condition = 'clean' or afterthought is not null)")
    c = c.select(F.col("composition_event_id").alias("cluster"), "condition", F.col("task_instruction").alias("task"), "artifact", "afterthought")
    seg = lambda i, f: F.get("segments", F.lit(i))[f]
    return compose.composed(c).select("id", F.sha2(F.col("message").cast("binary"), 256).alias("digest"), seg(1, "seg_start").alias("artifact_start"), seg(1, "seg_end").alias("artifact_end"), seg(2, "seg_start").alias("tail_start"))


# every case a second time with planted faults, so that there is something to find
PLANTED = """cases2 as (select id, condition, witness_tokens, artifact, message, segments, boundary_delimiters, afterthought from cases union all
 select id || ':x', condition, list_concat(witness_tokens, [split_part(artifact, ' ', 1)]), artifact, 'x' || message || coalesce(boundary_delimiters.opening, ''), segments, boundary_delimiters, coalesce(afterthought, 'planted') from cases)"""


def _planted(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").select("id", "condition", "witness_tokens", "artifact", "message", "segments", "boundary_delimiters", "afterthought")
    word = F.array(F.split_part("artifact", F.lit(" "), F.lit(1)))
    twice = F.coalesce("boundary_delimiters.opening", F.lit(""))
    x = c.withColumns({"id": F.concat("id", F.lit(":x")), "witness_tokens": F.when(F.col("witness_tokens").isNull(), word).otherwise(F.concat("witness_tokens", word)), "message": F.concat(F.lit("x"), "message", twice), "afterthought": F.coalesce("afterthought", F.lit("planted"))})
    return c.unionByName(x)


@query(f"""with {PLANTED} select id, 'short_witness' as violation from cases2 where list_contains(list_transform(witness_tokens, lambda x: len(regexp_split_to_array(trim(x), '\\s+')) < 2), true)
union all select id, 'witness_in_artifact' from cases2 where list_contains(list_transform(witness_tokens, lambda x: contains(lower(artifact), lower(x))), true)
union all select id, 'offset' from cases2 where list_contains(list_transform(segments, lambda s: substr(message, s.seg_start + 1, s.seg_end - s.seg_start) <> s.text), true)
union all select id, 'tag_count' from cases2 where boundary_delimiters.opening is not null and length(message) - length(replace(message, boundary_delimiters.opening, '')) <> length(boundary_delimiters.opening)
union all select id, 'clean_afterthought' from cases2 where condition = 'clean' and afterthought is not null""")
def validate_violations(spark: SparkSession, d: str) -> DataFrame:
    return compose.violations(_planted(spark, d))


@query("select h, n from (select sha256(artifact) h, count(distinct cl) n from (select artifact, composition_event_id cl from cases union all select artifact, composition_event_id || ':copy' from cases where condition = 'blank') where artifact is not null group by 1) where n > 1")
def duplicate_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts of more than one cluster; those of the cases of one condition are planted once more."""
    c = table(spark, d, "cases").select("artifact", F.col("composition_event_id").alias("cl"), "condition")
    c = c.unionByName(c.where("condition = 'blank'").withColumn("cl", F.concat("cl", F.lit(":copy")))).where("artifact is not null")
    return c.groupBy(F.sha2(F.col("artifact").cast("binary"), 256).alias("h")).agg(F.count_distinct("cl").alias("n")).where("n > 1")


@query("select source, min(n)::int lo, list_sort(list(n))[count(*) // 2 + 1]::int med, max(n)::int hi from (select source, length(artifact) n from cases where artifact is not null) group by 1")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    """Exact upper median from counts of lengths, which are few whatever the number of rows."""
    from pyspark.sql import Window as W

    n = table(spark, d, "cases").where("artifact is not null").groupBy("source", F.length("artifact").alias("n")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy("source").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    n = n.withColumns({"upto": upto, "half": F.floor(F.sum("c").over(W.partitionBy("source")) / 2)})
    return n.groupBy("source").agg(F.min("n").alias("lo"), F.min(F.when(F.col("upto") > F.col("half"), F.col("n"))).alias("med"), F.max("n").alias("hi"))


@query("select condition, afterthought_role, count(*) n, count(distinct composition_event_id) clusters from cases group by 1, 2")
def role_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").groupBy("condition", "afterthought_role").agg(F.count("*").alias("n"), F.count_distinct("composition_event_id").alias("clusters"))


@query("""with a as (select distinct composition_event_id cl, afterthought from cases where condition = 'newline_R' and afterthought is not null),
n as (select c.composition_event_id cl, c.source, task_instruction || chr(10) || chr(10) || artifact || chr(10) || a.afterthought as msg from cases c join a on a.cl = c.composition_event_id where c.condition = 'clean' and task_instruction is not null and artifact is not null)
select id, condition, source, length(message)::int as chars from cases where condition <> 'newline_R' union all select cl || ':newline_R:' || substr(sha256(msg), 1, 12), 'newline_R', source, length(msg)::int from n""")
def union_conditions(spark: SparkSession, d: str) -> DataFrame:
    """The cases of the other conditions, and newline_R built anew from the clean ones."""
    c = table(spark, d, "cases")
    tails = c.where("condition = 'newline_R' and afterthought is not null").select(F.col("composition_event_id").alias("cluster"), "afterthought").distinct()
    new = building.with_condition(c.where("task_instruction is not null and artifact is not null"), tails)
    keep = lambda x: x.select("id", "condition", "source", F.length("message").alias("chars"))
    return keep(c.where("condition <> 'newline_R'")).unionByName(keep(new), allowMissingColumns=True)


@query()
def chosen_afterthoughts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").where("condition = 'clean'").select("id", "source", "artifact")
    return building.chosen(c, building.casual_pool(), "source", "id", "artifact").select("id", "source", "afterthought_role", "afterthought")


@query()
def semantic_variants(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").where("condition = 'newline' and coalesce(afterthought, '') <> ''").select(F.col("composition_event_id").alias("cluster"), "condition", F.col("task_instruction").alias("task"), "artifact", "afterthought")
    return compose.semantic_variant(c, "semantic_tags").select("id", F.length("message").alias("chars"))


@query("""select composition_event_id as cluster, 'repeated' as problem from cases where composition_event_id is not null group by 1 having count(condition) > count(distinct condition)
union all select composition_event_id, 'conditions' from cases group by 1 having list_sort(list(distinct condition) filter (where condition is not null)) <> ['blank', 'boundary', 'clean', 'mitigation', 'newline', 'newline_R']""")
def incomplete_clusters(spark: SparkSession, d: str) -> DataFrame:
    wanted = ["clean", "newline", "blank", "boundary", "mitigation", "newline_R"]
    return building.incomplete(table(spark, d, "cases"), wanted).where("problem <> 'prefix' and cluster is not null")


@query()
def line_marked(spark: SparkSession, d: str) -> DataFrame:
    """All artifacts with marked lines, and whether unmarking gives them back."""
    c = table(spark, d, "cases").where("artifact is not null").select("id", "artifact", F.col("composition_event_id").alias("cluster"))
    marker = compose.line_marker(F.col("artifact"), F.col("cluster"))
    marked = compose.marked_lines(F.col("artifact"), marker)
    return c.select("id", F.length(marked).alias("chars"), (compose.unmarked_lines(marked, marker) == F.col("artifact")).alias("same"))


@query("""with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings where embedding is not null), n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) l from e),
p as (select a.vec_id q, b.vec_id id, a.label own, b.label lab, round(list_dot_product(a.v, b.v) / (a.l * b.l), 9) s from n a join n b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by q order by s desc, id) k from p) select q, round(avg((lab = own)::int), 9) as share, avg((lab = own)::int) >= 0.5 as agrees from r where k <= 5 group by q""")
def knn_loo(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0")
    return rounded(mining.vote(mining.neighbours(e, "vec_id", "embedding", "label", q, 5), q, "vec_id", "label"))


@query(r"""select sha256(trim(lower(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')))) as class, min(doc_id) representative, count(*) as size from documents where text is not null group by 1""")
def collapsed_texts(spark: SparkSession, d: str) -> DataFrame:
    return mining.collapsed(table(spark, d, "documents"), "doc_id", "text")


@query(r"""with p as (select doc_id, regexp_split_to_array(trim(text), '\n[ \t]*\n') parts from documents where text is not null) select doc_id from p where len(parts) >= 3 and length(parts[len(parts)]) <= 200 and length(parts[1]) <= 400""")
def structural_screen(spark: SparkSession, d: str) -> DataFrame:
    return mining.screened(table(spark, d, "documents"), "text").select("doc_id")


@query()
def refusals_and_spans(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results").where("response is not null")
    return r.select("seq", text.refuses(F.col("response")).alias("refuses"), F.length(text.prose(F.col("response"))).alias("prose_chars"), F.size(text.sentences(F.col("response"))).alias("units"))
