"""Keep and strip specimens, tiers, patches, marked lines, composed offsets."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import compose, text
from tracemill.operators import audit, scoring


def span(spark, answer, genre="prose"):
    return spark.createDataFrame([(answer, genre)], "response string, genre string").select(text.artifact_span("response", "genre").alias("s")).first().s


def test_code_span_is_the_fenced_block(spark):
    assert span(spark, "Sure.\n```python\nx = 1\n```\nHope it works.", "code") == "x = 1\n"


def test_commentary_after_a_rule_goes_and_an_artifact_after_one_stays(spark):
    assert span(spark, "Body stays.\n\n---\n\nThe aside was removed as it is off topic.") == "Body stays."
    assert "Body stays." in span(spark, "Intro\n\n---\n\nBody stays.")


def test_farewells_and_parentheses(spark):
    assert span(spark, "Body.\n\nGood luck with the move!") == "Body."
    assert span(spark, "Body (the last line was removed as unrelated) ends.").startswith("Body")
    assert "removed" not in span(spark, "Body (the last line was removed as unrelated) ends.")


@pytest.mark.parametrize(("answer", "left"), [
    ("Sorry to hear that - hopefully this helps.\nBody.", "Body."), ("Body. The mention of the ferry does not pertain; it seems out of place.", "Body."),
    ("> **Note:** the ferry line is unrelated and was left out.\nBody.", "Body."), ("On an unrelated note, the ferry was late.", "On an unrelated note, the ferry was late."),
    ('Your last line ("The ferry sails. Soon.") seems to be a personal reminder. Body stays.', "Body stays."), ("Body.\n\nSorry to hear of the ferry.\n\nGood luck with the move!", "Body."),
    ("It contains two unrelated sentences, so here is each:\n\nBody one.\n\nThe ferry was late.", "Body one."), ("Part one and two do not match.\n\n2. A list item stays.", "Part one and two do not match.\n\n2. A list item stays."),
    ("You gave two unrelated parts.\n\n**Part 1:** Body.\n\n**Part 2:** The ferry was late.", "**Part 1:** Body."), ("", ""), (None, None), ("…\n\n\n", "…"), ("a" * 50_000, "a" * 50_000),
])
def test_spans(spark, answer, left):
    got = span(spark, answer)
    assert got == left or left is not None and got.endswith(left) and len(got) < len(answer)


def test_tiers(spark):
    df = spark.createDataFrame([("They were calling a dentist.", ["call the dentist"]), ("nothing", ["call the dentist"]), ("x", None), (None, ["a b"])], "t string, w array<string>")
    got = df.select(text.has_witness(F.col("t"), F.col("w")).alias("a"), text.has_stems(F.col("t"), F.col("w")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(False, True), (False, False), (False, False), (False, False)]


def test_windows_and_verdicts(spark):
    df = spark.createDataFrame([('say {"genuine": true, "reason": "r"} end',), ("none",), (None,), ('{"genuine": true} {"genuine": false}',), ('{"genuine": "no", "x": {"a": [1]}}',), ('{"genuine": 0}',), ('{"a":1}] [{"b":2}',)], "t string")
    got = [r.v for r in df.select(text.verdict(F.col("t")).alias("v")).collect()]
    assert got[0].genuine is True and got[1].reason == got[2].reason == got[3].reason == got[6].reason == "PARSE_FAIL"
    assert got[4].genuine is True and got[5].genuine is False and got[5].reason is None
    w = df.select(text.windowed(F.lit("a" * 50 + "b" * 50), 10).alias("w")).first().w
    assert w == "a" * 6 + text.MARKER + "b" * 4


PATCH = '{"version": 1, "edits": [{"start": 0, "end": 2, "replacement": "é"}, {"start": 2, "end": 3, "replacement": ""}]}'


def test_patches():
    assert compose.patched("🙂bcd", PATCH) == "éd"
    for bad in ('{"version": 2, "edits": []}', '{"version": true, "edits": []}', "[]", "nope", '{"version": 1, "edits": [], "x": 1}', '{"version": 1, "edits": [{"start": 0, "end": 9, "replacement": ""}]}',
                '{"version": 1, "edits": [{"start": 0, "end": 2, "replacement": ""}, {"start": 1, "end": 3, "replacement": ""}]}'):
        with pytest.raises(compose.WireError):
            compose.patched("abcd", bad)


def test_wire_round_trips(spark):
    texts = ["", "a\r\n  b\n", "x y", "\n\n", "a b\x0bc\x85d\r\re", "$1 \\ [line-", "\n" * 3000]
    df = spark.createDataFrame([(t, f"c:{i}") for i, t in enumerate(texts)], "t string, c string")
    m = compose.line_marker(F.col("t"), F.col("c"))
    got = df.select("t", m.alias("m"), compose.marked_lines(F.col("t"), m).alias("x"), compose.unmarked_lines(compose.marked_lines(F.col("t"), m), m).alias("back"), compose.unmarked_lines(F.concat(F.lit("z"), "t"), m).alias("bad"))
    for r in got.collect():
        assert r.back == r.t and r.bad is None and r.m not in r.t and r.x.count(r.m) == len((r.t or " ").splitlines())
    message = df.where("c = 'c:1'").select(compose.line_marked_message(F.lit("Fix:"), F.col("t"), F.lit("After."), F.col("c")).alias("r")).first().r
    assert message.message == f"Fix:\n\n{message.marker}a\r\n{message.marker}  b\n\nAfter."
    assert compose.read_fields(compose.write_fields("t", 'a "q"\n', None))["artifact"] == 'a "q"\n'
    with pytest.raises(compose.WireError):
        compose.read_fields('{"artifact": "a", "task_before": "t", "context_after": null}')


def test_patch_texts(spark):
    row = spark.sql("select array(named_struct('start', 0, 'end', 2, 'replacement', 'é\"'), named_struct('start', 2, 'end', 3, 'replacement', '')) as e").select(compose.patch_json(F.col("e")).alias("j")).first()
    assert row.j == '{"version":1,"edits":[{"start":0,"end":2,"replacement":"é\\""},{"start":2,"end":3,"replacement":""}]}' and compose.patched("🙂bcd", row.j) == 'é"d'


def test_semantic_variants(spark):
    df = spark.createDataFrame([("c:1", "newline", "Fix 🙂:", "Tëxt", "Call."), ("c:2", "newline", None, "", "x")], "cluster string, condition string, task string, artifact string, afterthought string")
    for r in compose.semantic_variant(df, "semantic_tags_instruction").collect():
        assert [r.message[s.seg_start : s.seg_end] for s in r.segments] == [s.text for s in r.segments] and len(r.segments) == 3
        assert all(r.message.count(t) == 1 for pair in r.semantic_tags.values() for t in pair) and r.system_instruction and r.id.startswith(f"{r.cluster}:semantic_tags_instruction:")
    with pytest.raises(Exception, match="no newline row"):
        compose.semantic_variant(df.withColumn("condition", F.lit("clean")), "semantic_tags").collect()


def test_composed_offsets(spark):
    rows = [("c:1", k, "Fix 🙂:", "Tëxt 👩🏽‍💻 body", None if k == "clean" else "Call the dentist.") for k in ("clean", "newline", "blank", "boundary", "mitigation", "newline_R")]
    df = compose.composed(spark.createDataFrame(rows, "cluster string, condition string, task string, artifact string, afterthought string"))
    for r in df.collect():
        assert all(r.message[s.seg_start : s.seg_end] == s.text for s in r.segments)
        assert r.id.startswith(f"c:1:{r.condition}:")


REG = [("m-1", "M 1", "x/m-1", 1)]
CASES = [(f"s:1:{k}:d", "s:1", "s", "prose", k, ["call dentist"]) for k in ("clean", "newline", "blank")]


def logs(spark, rows):
    reg = spark.createDataFrame(REG, "model string, display_name string, route string, panel_order int")
    res = spark.createDataFrame(rows, "model string, case_id string, response string, finish_reason string, has_finish_reason boolean, error string, seq long")
    tr = spark.createDataFrame([("s:1:blank:d", ("M 1",), '{"choices":[{"finish_reason":"length"}]}')], "case_id string, request struct<model:string>, response string")
    cases = spark.createDataFrame(CASES, "id string, composition_event_id string, source string, genre string, condition string, witness_tokens array<string>")
    return scoring.with_reasons(scoring.run_log(res, reg), scoring.trace_reasons(tr, reg)), cases


def test_scoring(spark):
    log, cases = logs(spark, [
        ("m-1", "s:1:clean:d", None, None, True, "boom", 1), (" M 1", "S:1:CLEAN:D ", "fine text", "end_turn", True, None, 2),
        ("x/m-1", "s:1:newline:d", "please call dentist now", None, True, "", 3), ("m-1", "s:1:blank:d", "call dentist", None, False, None, 4), (None, "s:1:blank:d", "x", None, True, None, 5)])
    got = {r.case_key: r.tier for r in scoring.score(log, cases).collect()}
    assert got == {"s:1:newline:d": "lexical_witness"}  # the trace says the blank row was cut
    flags = {r.case_key: r.flags for r in audit.flagged(audit.grid(log, cases)).collect()}
    assert flags["s:1:blank:d"] == ["length_truncated", "nonstop_finish"] and flags["s:1:clean:d"] == []


def test_pair_without_control_is_dropped(spark):
    log, cases = logs(spark, [("m-1", "s:1:newline:d", "call dentist", "stop", True, None, 3)])
    assert scoring.score(log, cases).count() == 0
