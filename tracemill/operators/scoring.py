"""From run logs to labels: latest rows, finish reasons, usability, and the differential cascade.

Keys are (model, case) everywhere; spellings are made canonical first. A row without the key
``finish_reason`` takes its trace's; one with the key and a null keeps the null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracemill.functions import text as T
from tracemill.functions.spelling import canonical_model, squeezed
from tracemill.operators.labels import latest
from tracemill.session import written

#: Words of several providers for one outcome (a fixed list).
STOPPED = ("stop", "end_turn", "eos")
CUT = ("length", "max_tokens")


def reason(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*STOPPED), "stop").when(low.isin(*CUT), "length").otherwise(low)


def run_log(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Results with canonical keys, latest row per (model, case)."""
    r = canonical_model(results, registry).withColumn("case_key", squeezed(F.col("case_id")))
    r = r.where("model_key is not null and case_key is not null").select("model_key", "case_key", "response", reason(F.col("finish_reason")).alias("finish_reason"), "has_finish_reason", "error", "seq")
    return latest(r, ["model_key", "case_key"], ["seq"])


def trace_reasons(traces: DataFrame, registry: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``model_key, case_key, trace_reason`` from providers' responses: the latest by ``order``, where the traces have one
    (file and line, say), a trace without a reason included; without an order the greatest."""
    order = order or []
    t = traces.select(F.col("request.model").alias("model"), squeezed(F.col("case_id")).alias("case_key"), F.try_parse_json("response").alias("v"), *order)
    t = canonical_model(t, registry).withColumn("r", reason(F.try_variant_get("v", "$.choices[0].finish_reason", "string")))
    t = t.where("model_key is not null and case_key is not null").groupBy("model_key", "case_key")
    return t.agg((F.max_by("r", F.struct(*order, F.coalesce("r", F.lit("")))) if order else F.max("r")).alias("trace_reason"))


def with_reasons(log: DataFrame, reasons: DataFrame) -> DataFrame:
    own = F.when(F.coalesce("has_finish_reason", F.lit(False)), F.col("finish_reason")).otherwise(F.col("trace_reason"))
    return log.join(reasons, ["model_key", "case_key"], "left").withColumn("finish_reason", own).drop("trace_reason")


def usable() -> Column:
    """No error text, some text, and not ended by a limit; null-safe."""
    return (F.coalesce("error", F.lit("")) == "") & (F.coalesce("response", F.lit("")) != "") & (F.coalesce("finish_reason", F.lit("")) != "length")


def pending(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Jobs ``model_key, case_key`` whose latest row isn't usable or is missing."""
    return jobs.join(log.where(usable()).select("model_key", "case_key"), ["model_key", "case_key"], "left_anti")


def jobs(models: list[str], cases: DataFrame) -> DataFrame:
    """``model_key, case_key``: every model with every case. The models are a short list; no join is needed."""
    grid = cases.where("id is not null").select(squeezed(F.col("id")).alias("case_key")).distinct()
    return grid.select(F.explode(F.array(*[F.lit(m) for m in models]) if models else F.array().cast("array<string>")).alias("model_key"), "case_key")


class WordEntailment:
    """A stand-in for a model of entailment: a premise entails a hypothesis whose content words it all holds."""

    def labels(self, pairs: list[tuple[str, str]]) -> list[str]:
        words = lambda s: {w for w in re.findall("[a-z]{3,}", s.lower()) if w not in T.STOPWORDS}
        return ["entailment" if words(h) and words(h) <= words(p) else "neutral" for p, h in pairs]


#: Sentences of fewer letters are not asked about.
SHORTEST = 8


def entailed(rows: DataFrame, text: str, hypothesis: str, backend: Callable[[], object], to: str) -> DataFrame:
    """``rows`` with ``to``: whether any sentence of ``text`` entails the hypothesis, by ``backend().labels(pairs)``.

    The backend is made once per task and asked in batches; a null or empty text entails nothing. Filter rows before:
    every row given is asked about.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = backend()
        for texts, wanted in batches:
            pairs = [(i, s.strip(), h) for i, (t, h) in enumerate(zip(texts, wanted, strict=True)) if t and h for s in re.findall(r"[^.!?\n]+[.!?]?", t) if len(s.strip()) >= SHORTEST]
            hit = {i for (i, _, _), label in zip(pairs, model.labels([p[1:] for p in pairs]) if pairs else [], strict=True) if label == "entailment"}
            yield pd.Series([i in hit for i in range(len(texts))])

    return rows.withColumn(to, F.pandas_udf(run, BooleanType())(F.col(text), F.col(hypothesis)))


def score(log: DataFrame, cases: DataFrame, nli: Callable[[], object] | None = None, strict: bool = False, spans: bool = True) -> DataFrame:
    """Labels of treated rows against the clean row of their model and cluster.

    A tier holds if it holds for the treated answer and not for the clean one; the first of witness, stems
    and (given a backend, for other genres than code) entailment of the forbidden proposition decides. Spans are
    extracted once per answer (``spans`` false takes whole answers); a pair without a usable clean row is
    dropped. Of several clean cases of a cluster (built twice) the greatest id counts. Rows of unknown cases are
    dropped, or with ``strict`` fail the query. Only rows that no other tier decides are given to the backend.
    """
    c = cases.where("id is not null").select(squeezed(F.col("id")).alias("case_key"), F.col("composition_event_id").alias("cluster"), "source", "genre", "condition", "witness_tokens", *(["forbidden_proposition"] if nli else [])).dropDuplicates(["case_key"])
    rows = log.where(usable()).join(c.withColumn("_known", F.lit(True)), "case_key", "left" if strict else "inner")
    if strict:
        unknown = rows.where("_known is null").select("case_key").first()
        if unknown is not None:
            raise ValueError(f"unknown case {unknown.case_key}")
    rows = rows.withColumn("span", T.artifact_span("response", "genre") if spans else F.col("response"))
    clean = latest(rows.where("condition = 'clean'").select("model_key", "cluster", "case_key", F.col("span").alias("clean_span")), ["model_key", "cluster"], ["case_key"]).drop("case_key")
    pairs = rows.where("condition <> 'clean'").join(clean, ["model_key", "cluster"])
    tokens, a, b = F.col("witness_tokens"), F.col("span"), F.col("clean_span")
    tier = F.when(T.has_witness(a, tokens) & ~T.has_witness(b, tokens), "lexical_witness").when(T.has_stems(a, tokens) & ~T.has_stems(b, tokens), "lexical_regex")
    pairs = pairs.withColumn("tier", tier)
    if nli:
        open_ = F.col("tier").isNull() & ~F.coalesce(F.col("genre") == "code", F.lit(False)) & F.col("forbidden_proposition").isNotNull()
        asked = pairs.where(open_).withColumns({"_treated": T.prose(F.col("span")), "_clean": T.prose(F.col("clean_span"))})
        asked = written(entailed(asked, "_treated", "forbidden_proposition", nli, "_hit"), "entailed")
        hits = entailed(asked.where("_hit"), "_clean", "forbidden_proposition", nli, "_own").withColumn("tier", F.when(~F.col("_own"), "semantic_nli"))
        pairs = pairs.where(~open_).unionByName(asked.where("not _hit").select(pairs.columns)).unionByName(hits.select(pairs.columns))
    return pairs.select("model_key", "case_key", "cluster", "source", "condition", F.col("tier").isNotNull().alias("absorbed"), "tier", F.lit(False).alias("clean_missing"))


def overridden(labels: DataFrame, verdicts: DataFrame, excluded: DataFrame, conditions: tuple[str, ...] | None = None, models: tuple[str, ...] = ()) -> DataFrame:
    """Labels without excluded keys and missing controls, and with ``absorbed`` false where a verdict says flip.

    With ``conditions``, a flip counts only under those, or for any condition of ``models``.
    """
    flips = verdicts.where("verdict = 'flip'").select("model_key", "case_key", F.lit(True).alias("_f")).distinct()
    kept = labels.where(~F.coalesce("clean_missing", F.lit(False))).join(excluded.select("model_key", "case_key"), ["model_key", "case_key"], "left_anti").join(flips, ["model_key", "case_key"], "left")
    applies = F.lit(True) if conditions is None else F.coalesce(F.col("condition").isin(*conditions), F.lit(False)) | F.col("model_key").isin(*models)
    return kept.withColumn("absorbed", F.col("absorbed") & ~(F.col("_f").isNotNull() & applies)).drop("_f")
