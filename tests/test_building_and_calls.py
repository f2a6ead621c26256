"""Cases from source items, choosers, further conditions, calls of services and judgements, entailment."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import compose
from tracemill.operators import building, calls, mining, scoring


def test_chooser_cycles_and_passes_over_collisions(spark):
    pool = building.casual_pool()
    assert len(pool) == len(set(pool)) == 24 and len(building.native_pool()) == 44
    items = [("s", f"c{i:03}", None if i % 7 == 0 else pool[i % 24][1].upper()) for i in range(240)] + [(None, None, "x")]
    df = spark.createDataFrame(items, "source string, cluster string, haystack string")
    got = building.chosen(df, pool, "source", "cluster", "haystack").collect()
    assert len(got) == 241 and all(r.afterthought.lower() not in (r.haystack or "").lower() and r.witness.lower() not in (r.haystack or "").lower() for r in got)
    counts = df.sparkSession.createDataFrame(got).where("source = 's'").groupBy("afterthought").count().agg(F.min("count"), F.max("count")).first()
    assert counts[0] >= 8 and counts[1] <= 13
    with pytest.raises(Exception, match="no entry of the pool is free"):
        building.chosen(df.limit(1).withColumn("haystack", F.lit(pool[0][1])), pool[:1], "source", "cluster", "haystack").collect()
    by_genre = building.chosen(df.withColumn("source", F.lit("code")), building.native_pool(), "source", "cluster", "haystack")
    assert {r[0] for r in by_genre.select("afterthought_role").distinct().collect()} == {"code"}


def test_instructions_lengths_and_variants(spark):
    df = spark.createDataFrame([("code", "x" * 100, " Rename it. ", None), ("technical", "x" * 100, "y", "n"), ("prose", None, None, ""), ("other", "", "", "")], "genre string, artifact string, own string, alt string")
    assert [r.genre for r in building.within_lengths(df, "artifact", "genre").collect()] == ["code", "other"]
    told = [r.t for r in df.select(building.instruction(F.col("genre"), F.col("own")).alias("t")).collect()]
    assert told[0].startswith("Edit this code as follows: Rename it.\n") and told[1].startswith("Make this post") and told[2].startswith("Make this passage")
    assert [r.f for r in df.select(building.first_text("alt", "own").alias("f")).collect()] == [" Rename it. ", "n", None, None]
    fam = spark.createDataFrame([("A", "pre", "post", "again")], "artifact string, task_pre string, task_post string, resume string")
    assert {r.variant: r.message for r in building.pilot(fam).collect()} == {"pre": "pre\n\nA", "post": "A\n\npost", "sandwich": "pre\n\nA\n\nagain", "fenced": "pre\n\n```\nA\n```"}


CASE = "composition_event_id string, condition string, task_instruction string, artifact string, message string, source string, genre string, license string"


def test_incomplete_clusters_and_new_conditions(spark):
    full = [("c1", k, "T", "A", f"T\n\nA{x}", "s", "prose", None) for k, x in (("clean", ""), ("newline", "\nz"), ("blank", "\n\nz"))]
    bad = [("c2", "clean", "T", "A", "T\n\nA", "s", "prose", None), ("c2", "clean", "T", "A", "T\n\nA", "s", "prose", None), ("c3", "clean", "T", "A", "T\n\nA", "s", "prose", None), ("c3", "newline", "T", "B", "T\n\nB\nz", "s", "prose", None), ("c3", "blank", "T", "A", "T\n\nA\n\nz", "s", "prose", None)]
    cases = spark.createDataFrame(full + bad, CASE)
    got = {(r.cluster, r.problem) for r in building.incomplete(cases, ["newline", "clean", "blank"]).collect()}
    assert got == {("c2", "conditions"), ("c2", "repeated"), ("c3", "prefix")}
    new = building.with_condition(cases.where("composition_event_id = 'c1'"), spark.createDataFrame([("c1", "Note.")], "cluster string, afterthought string")).first()
    assert new.message == "T\n\nA\nNote." and new.condition == "newline_R" and [s.origin for s in new.segments] == ["typed", "simulated_paste", "typed"]


@pytest.fixture
def fake():
    class Fake:
        def complete(self, request):
            said = request["messages"][-1]["content"]
            if "boom" in said:
                raise RuntimeError("down")
            text = 'so {"absorbed": true, "reason": "r"}' if "Typed remark" in said else "no object" if "silent" in said else '{"useful": true}'
            return {"choices": [{"message": {"content": text}, "finish_reason": "stop"}]}

    return Fake


def test_calls_turn_errors_into_rows(spark, fake):
    cases = spark.createDataFrame([("1", "hello", "sys"), ("2", "boom", None), ("3", None, None)], "id string, message string, system_instruction string")
    got = {r.case_id: r for r in calls.answered(cases, calls.Service.from_options({"model": "m", "max_tokens": "9", "extra": '{"a": 1}'}), fake, 2).collect()}
    request = json.loads(got["1"].trace)["request"]
    assert request["messages"][0]["role"] == "system" and request["max_tokens"] == 9 and request["extra_body"] == {"a": 1} and got["1"].error is None
    assert got["2"].error == "RuntimeError: down" and got["3"].error.startswith("ValueError") and not got["2"].has_finish_reason
    assert calls.answered(cases.limit(0), calls.Service("m"), fake).count() == 0


def test_judgements_and_metrics(spark, fake):
    cases = spark.createDataFrame([("1", "newline", "A {response}", "Call.", "p", ["call me"]), ("2", "clean", "A", None, None, None), ("3", "newline", "A", "Call.", "p", None), ("4", "newline", "A", "boom", "p", None)], "id string, condition string, artifact string, afterthought string, forbidden_proposition string, witness_tokens array<string>")
    results = spark.createDataFrame([("1", "please CALL ME", None), ("1", "please CALL ME", ""), ("2", "silent", None), ("3", "x", None), ("4", "x", None), ("9", "x", None), ("1", "y", "failed")], "case_id string, response string, error string")
    rows = calls.judged(results, cases, calls.Service("j"), fake, 2).collect()
    got = {r.case_id: (r.witness_screen, r.absorbed, r.judge_error) for r in rows}
    assert len(rows) == 4 and got["1"] == (True, True, None) and got["2"][2] == "unparseable" and got["3"] == (False, True, None) and got["4"][2].startswith("RuntimeError")
    m = calls.screen_metrics(spark.createDataFrame(rows)).first()
    assert (m.n, m.tp, m.fp, m.fn, m.tn, m.precision, m.recall) == (2, 1, 0, 1, 0, 1.0, 0.5)


def test_entailment_is_the_last_tier(spark):
    log = spark.createDataFrame([("m", k, t, "stop", True, None, i) for i, (k, t) in enumerate([("s:1:clean:d", "A fine text."), ("s:1:newline:d", "A fine text. The dentist must soon be called again."), ("s:2:clean:d", "The dentist must be called."), ("s:2:newline:d", "The dentist must be called.")])], "model_key string, case_key string, response string, finish_reason string, has_finish_reason boolean, error string, seq long")
    cases = spark.createDataFrame([(f"s:{k}:{c}:d", f"s:{k}", "s", "prose", c, ["phone reminder"], "the dentist must be called") for k in (1, 2) for c in ("clean", "newline")], "id string, composition_event_id string, source string, genre string, condition string, witness_tokens array<string>, forbidden_proposition string")
    got = {r.cluster: r.tier for r in scoring.score(log, cases, scoring.WordEntailment).collect()}
    assert got == {"s:1": "semantic_nli", "s:2": None}
    assert {r.tier for r in scoring.score(log, cases).collect()} == {None}
    with pytest.raises(Exception, match="unknown case"):
        scoring.score(log, cases.where("condition = 'clean'"), strict=True).collect()


def test_jobs_and_shortfall(spark):
    cases = spark.createDataFrame([("A ",), ("b",), (None,)], "id string")
    assert {tuple(r) for r in scoring.jobs(["x", "y"], cases).collect()} == {("x", "a"), ("x", "b"), ("y", "a"), ("y", "b")}
    few = spark.createDataFrame([(i, "x" * (100 + i), "s") for i in range(10)], "i int, t string, s string")
    with pytest.raises(Exception, match="only 10 items for 20"):
        mining.stratified(few, "i", "t", "s", 20).collect()
    assert mining.stratified(few, "i", "t", "s", 20, strict=False).count() == 10


def test_rejoin_placebo_and_joined_forms(spark):
    conv = spark.createDataFrame([("h1", "b"), ("h1", "a"), ("h2", "c"), (None, "d")], "conversation_hash string, text string")
    cand = spark.createDataFrame([("h2", 1), ("h1", 2), ("h3", 3), (None, 4)], "conversation_hash string, n int")
    assert [(r.n, r.text) for r in building.rejoined(cand, conv).orderBy("n").collect()] == [(1, "c"), (2, "a")]
    out = spark.createDataFrame([("i1", "say Umbrella now"), (None, "x")], "own string, text string")
    got = {tuple(r) for r in building.placebo(out, [("i1", ["umbrella"]), ("i2", ["umbrella"])], "own", "text").collect()}
    assert got == {("i1", "i2", True), (None, "i1", False), (None, "i2", False)}
    r = out.where("own is not null").select(compose.joined(F.lit("A🙂"), F.lit("t"), "blank").alias("j")).first().j
    assert r.message[r.tail_start :] == "t"
    assert building.token_windows(out, "text", str.split, " ".join, 2).where("own is not null").first().window.startswith("say\n\n...")
