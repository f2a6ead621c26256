"""Deduplication against brute force, index runs over several batches, drift of small runs."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracemill.operators import delivery, drift

SCHEMA = "model string, case_id string, error string, seq long, batch string"
keys = lambda: [F.col("model"), F.col("case_id")]
args = lambda: (F.col("error"), F.col("seq"), F.col("batch"))


def survivors(rows):
    best = {}
    for m, c, e, s, _ in rows:
        k = (m, c) if m is not None and c is not None else ("row", s)
        best[k] = max(best.get(k, (False, -1)), (not (e or "").strip(), s))
    return {v[1] for v in best.values()}


def made(n, hot=0.4):
    r = random.Random(7)
    return [(None if r.random() < 0.02 else "m", "c0" if r.random() < hot else f"c{r.randrange(n // 3)}", r.choice([None, "", " ", "bad"]), s, r.choice(["b1", "b2", None])) for s in range(n)]


def test_exactly_one_stays(spark):
    rows = made(600)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("clean", F.lit("clashing name"))
    index = delivery.index_of(df, keys(), *args())
    gone = {r.seq for r in delivery.redundant(df, index, keys()).collect()}
    assert gone == {r[3] for r in rows} - survivors(rows)
    assert {r.seq for r in delivery.deduplicated(df, index, keys()).collect()} == survivors(rows)


def test_batches_one_after_the_other(spark, tmp_path):
    rows = made(300)
    parts = [spark.createDataFrame(rows[i : i + 100], SCHEMA) for i in (0, 100, 200)]
    index = delivery.batches(iter(parts), keys(), *args(), path=f"file://{tmp_path}/index", expected=300)
    whole = {r.seq for r in delivery.survivors(index).collect()}
    assert whole == {s for s in survivors(rows) if rows[s][0] is not None}


def test_runs_merge_and_collide():
    runs = delivery.Runs(max_runs=2)
    one = lambda *v: np.array(v, np.int64)
    first = None
    for k in range(6):
        runs.add(one(5, 5, k + 10), one(1, 2, 0), np.array([True, False, True]), one(k, k + 100, k))
        first = first or [a.copy() for a in runs.runs[0]]
        assert len(runs.runs) <= 2
    runs.merge()
    seqs = set(runs.runs[0][3].tolist())
    assert 5 in seqs and 105 in seqs and len(seqs) == 2 + 5  # colliding high halves stay apart


def test_only_touched_prefixes_are_written_and_runs_stay(spark, tmp_path):
    path = f"{tmp_path}/index"
    index = delivery.Index(spark, f"file://{path}", 2_000_000, max_runs=2)
    rows = lambda ids, base: delivery.message_rows(spark.createDataFrame([("m", i, None, base + n, "b") for n, i in enumerate(ids)], SCHEMA), keys(), *args())
    index.add(rows([f"c{i}" for i in range(200)], 0))
    import pathlib

    def files():
        return {p: p.read_bytes() for p in pathlib.Path(path).rglob("*.parquet")}

    before, some = files(), ["c1", "c2"]
    for n in range(4):
        index.add(rows(some, 1000 * (n + 1)))
        assert all(files()[p] == b for p, b in before.items())
        assert len(list(pathlib.Path(f"{path}/runs/batch={n + 1}").glob("prefix=*"))) <= 2
    assert all(len(v) <= 2 for v in index.manifest.values())
    again = delivery.Index.opened(spark, f"file://{path}", 4, 2_000_000)
    got = {r.seq for r in delivery.survivors(again.table()).collect()}
    assert got == {i for i in range(200) if i not in (1, 2)} | {4000, 4001}
    index.add(rows(some, 0).limit(0))
    assert {r.seq for r in delivery.survivors(index.table()).collect()} == got


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    index = delivery.index_of(df, keys(), *args())
    assert delivery.redundant(df, index, keys()).count() == 0


def lines(*files):
    out = []
    for n, rows in enumerate(files, 1):
        out += [("r", n, f"f{n}", k, None, None, x) for k, x in enumerate(rows)]
    return out


RAW = "run_id string, file_no int, file_name string, line_no int, written_at timestamp, loaded_at timestamp, line string"


def test_changes(spark):
    a = ['{"model":"m","temperature":0.2,"seed":42}', '{"model":"m","temperature":0.7,"seed":null}', "", "{broken"]
    b = ['{"model":"m","params":{"temp":0.2},"seed":"42"}', '{"model":"m","params":{"temp":0.7},"seed":"42"}', '{"model":"m","params":{"temp":0.7},"seed":"42"}']
    c = ['{"model":"m","params":{"temp":0.2},"note":"hello there"}']
    raw = spark.createDataFrame(lines(a, b, c) + lines(a)[:1], RAW)
    got = {tuple(r) for r in drift.found(raw).collect()}
    assert got == {("r", 2, "renamed", "temperature", "params.temp"), ("r", 2, "retyped", "seed", "seed"), ("r", 3, "removed", "seed", ""), ("r", 3, "added", "", "note")}
    table = drift.unified(raw).orderBy("file_no", "line_no").collect()
    assert len(table) == 6 and [r.temperature for r in table] == [0.2, 0.7, 0.2, 0.7, 0.7, 0.2]


def test_fields_of_schemas():
    assert drift.fields("OBJECT<a: BIGINT, b: OBJECT<`c d`: STRING, e: OBJECT<>>, f: ARRAY<OBJECT<x: VOID>>, g: DECIMAL(3,1), h: VOID>") == [
        ("a", "number"), ("b.c d", "string"), ("b.e", "object"), ("f", "array"), ("g", "number"), ("h", None)]
    assert drift.fields("OBJECT<>") == []


def test_deep_fields_glued_lines_and_all_cells(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":1}}}}}}},"model":"m","it\'s":"q","x.y":true}'
    raw = spark.createDataFrame(lines([deep, deep + " x", deep + deep, "[1]", "{}", '{"temperature":"warm","model":null}']), RAW)
    head = {r.path: r.kind for r in drift.headers(raw).collect()}
    assert head == {"a.b.c.d.e.f.g.h": "number", "model": "string", "it's": "string", "x.y": "boolean", "temperature": "string"}
    rows = {r.line_no: r for r in drift.unified(raw).collect()}
    assert set(rows) == {0, 4, 5} and rows[0].model == "m" and rows[0].others == {"a.b.c.d.e.f.g.h": "1.0", "it's": "q", "x.y": "true"}
    assert rows[5].temperature is None and rows[5].others == {"temperature": "warm"} and not rows[0].has_finish_reason


def test_every_left_name_finds_its_best_partner(spark):
    a = ['{"p":"aa bb cc","q":"aa bb cc dd"}', '{"p":"xx","q":"yy"}'] * 3
    b = ['{"r":"aa bb cc","s":"aa bb cc dd"}', '{"r":"xx","s":"yy"}'] * 3
    got = [tuple(r)[2:] for r in drift.log(spark.createDataFrame(lines(a, b), RAW)).orderBy("step").collect()]
    assert [g[1] for g in got] == ["renamed", "renamed"] and {g[2] for g in got} == {"p", "q"} and {g[3] for g in got} == {"r", "s"}


def test_no_lines(spark):
    raw = spark.createDataFrame([("r", 1, "f", 1, None, None, "nothing")], RAW)
    assert drift.found(raw).count() == 0
    assert drift.unified(raw).count() == 0
