"""Calls of model services over a table of jobs: answers, and judgements of answers.

The service is a plug-in: ``client()`` is made once per task and has ``complete(request) -> dict`` with the provider's
response (``choices[0].message.content`` and ``finish_reason``). A call that fails becomes a row with its error, never a
failed task. The jobs' partitions are the number of calls in flight. Nulls in optional columns leave the key out of
the request; a null message is an error row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import stats
from tracemill.functions import text as T


@dataclass(frozen=True)
class Service:
    """How a model is asked."""

    model: str
    temperature: float = 0.0
    max_tokens: int | None = None
    extra: tuple[tuple[str, object], ...] = ()

    @staticmethod
    def from_options(options: dict[str, str]) -> Service:
        """From text options, as a command line has them; ``extra`` is a JSON object."""
        extra = json.loads(options.get("extra") or "{}")
        if not isinstance(extra, dict):
            raise ValueError("extra must be a JSON object")
        return Service(options["model"], float(options.get("temperature", 0)), int(options["max_tokens"]) if options.get("max_tokens") else None, tuple(sorted(extra.items())))

    def request(self, message: str, system: str | None) -> dict:
        roles = [{"role": "system", "content": system}] if system else []
        out: dict = {"model": self.model, "messages": [*roles, {"role": "user", "content": message}], "temperature": self.temperature}
        if self.max_tokens:
            out["max_tokens"] = self.max_tokens
        return out | ({"extra_body": dict(self.extra)} if self.extra else {})


ANSWER = "model string, case_id string, response string, finish_reason string, has_finish_reason boolean, error string, temperature double, trace string"


def answered(cases: DataFrame, service: Service, client: Callable[[], object], in_flight: int = 12) -> DataFrame:
    """One row per case (``id, message`` and, if there is one, ``system_instruction``) in the shape of results, with its trace as JSON."""
    system = F.col("system_instruction") if "system_instruction" in cases.columns else F.lit(None).cast("string")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = client()
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                request = service.request(r.message, r.system)
                try:
                    if r.message is None:
                        raise ValueError("no message")
                    doc = made.complete(request)
                    choice = doc["choices"][0]
                    warm = service.temperature if service.temperature else None
                    out.append((service.model, r.id, choice["message"].get("content") or "", choice.get("finish_reason"), True, None, warm, json.dumps({"case_id": r.id, "request": request, "response": doc}, ensure_ascii=False)))
                except Exception as e:  # noqa: BLE001 - whatever a service does becomes a row
                    error = f"{type(e).__name__}: {e}"
                    out.append((service.model, r.id, "", None, False, error, None, json.dumps({"case_id": r.id, "request": request, "error": error}, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    return cases.select("id", "message", system.alias("system")).repartition(in_flight).mapInPandas(run, ANSWER)


#: Signs of the artifact and of the answer that a judge is shown.
SHOWN = (8000, 10_000)
USEFUL = "Judge how useful an answer to a request for an edit is. Reply with one JSON object with the keys useful (true or false) and reason.\n\nText to edit:\n{artifact}\n\nAnswer:\n{response}"
ABSORBED = "A text was pasted, and a remark was typed after it. Judge whether the answer took the remark into the edited text. Reply with one JSON object with the keys absorbed (true or false) and reason.\n\nPasted text:\n{artifact}\n\nTyped remark:\n{afterthought}\n\nWhat must not be in the edited text:\n{proposition}\n\nAnswer:\n{response}"


def judge_prompt(condition: Column, artifact: Column, afterthought: Column, proposition: Column, response: Column) -> Column:
    """The judge's question: about usefulness for clean cases and those without an afterthought, else about absorption."""
    fill = {"{artifact}": F.left(F.coalesce(artifact, F.lit("")), F.lit(SHOWN[0])), "{afterthought}": F.coalesce(afterthought, F.lit("")), "{proposition}": F.coalesce(proposition, F.lit("")), "{response}": F.left(F.coalesce(response, F.lit("")), F.lit(SHOWN[1]))}

    def filled(template: str) -> Column:
        # the pieces are put together, so that a text that holds a placeholder changes nothing
        parts, rest = [], template
        while rest:
            at = min(((rest.find(k), k) for k in fill if k in rest), default=(len(rest), ""))
            parts += [F.lit(rest[: at[0]])] + ([fill[at[1]]] if at[1] else [])
            rest = rest[at[0] + len(at[1]) :]
        return F.concat(*parts)

    plain = (condition == "clean") | (F.coalesce(afterthought, F.lit("")) == "")
    return F.when(F.coalesce(plain, F.lit(True)), filled(USEFUL)).otherwise(filled(ABSORBED))


def judged(results: DataFrame, cases: DataFrame, service: Service, client: Callable[[], object], in_flight: int = 12) -> DataFrame:
    """``case_id, condition, witness_screen, absorbed, judge_error, trace`` of the answers without error, judged by the service.

    ``absorbed`` is the truth of the judge's key of that name; what holds no readable object is ``unparseable``.
    """
    c = cases.select(F.col("id").alias("case_id"), "condition", "artifact", "afterthought", "forbidden_proposition", "witness_tokens").dropDuplicates(["case_id"])
    rows = results.where(F.coalesce("error", F.lit("")) == "").select("case_id", "response").join(c, "case_id")
    # an answer may come several times: a key of its own keeps the rows apart
    rows = rows.withColumn("id", F.concat_ws("\x1f", "case_id", F.sha2(F.coalesce("response", F.lit("")).cast("binary"), 256))).dropDuplicates(["id"])
    prompt = judge_prompt(F.col("condition"), F.col("artifact"), F.col("afterthought"), F.col("forbidden_proposition"), F.col("response"))
    told = answered(rows.select("id", prompt.alias("message")), service, client, in_flight).select(F.col("case_id").alias("id"), F.col("response").alias("_said"), F.col("error").alias("_failed"), "trace")
    v = T.one_object(F.nullif(T.json_object(F.col("_said")), F.lit("")))
    out = told.withColumn("_v", v).join(rows.select("id", "case_id", "condition", T.has_witness(F.col("response"), F.col("witness_tokens")).alias("witness_screen")), "id")
    error = F.coalesce("_failed", F.when(F.col("_v").isNull(), F.lit("unparseable")))
    absorbed = F.when(error.isNull(), F.coalesce(F.try_variant_get("_v", "$.absorbed", "boolean"), F.lit(False)))
    return out.select("case_id", "condition", "witness_screen", absorbed.alias("absorbed"), error.alias("judge_error"), "trace")


def screen_metrics(rows: DataFrame) -> DataFrame:
    """``n, tp, fp, fn, tn, precision, recall, f1`` of the witness screen against judged rows; errors and clean cases are left out."""
    r = rows.where("judge_error is null and condition <> 'clean'")
    cell = lambda a, b: F.count_if((F.col("witness_screen") == a) & (F.col("absorbed") == b))
    t = r.agg(F.count("*").alias("n"), cell(True, True).alias("tp"), cell(True, False).alias("fp"), cell(False, True).alias("fn"), cell(False, False).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.withColumns({"precision": stats.ratio(tp, tp + fp), "recall": stats.ratio(tp, tp + fn), "f1": stats.ratio(2 * tp, 2 * tp + fp + fn)})


def parse_failures(rows: DataFrame, verdict: str = "verdict") -> DataFrame:
    """``n, failed`` of verdicts (see ``text.verdict``)."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(verdict)["reason"] == "PARSE_FAIL").alias("failed"))
