"""Logs, sinks, samples and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import mining
from tracemill.sources import logs
from tracemill.streaming import log as stream_log


def test_jsonl_keeps_order_and_keys(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"model":"m","case_id":"1","finish_reason":null}\n\n{"model":"m","case_id":"2"}\n')
    (tmp_path / "a.jsonl").write_text('{"model":"n","case_id":"1"}\n')
    rows = logs.read_jsonl(spark, [f"{tmp_path}/b.jsonl", f"{tmp_path}/a.jsonl"]).orderBy("file_no", "line_no").collect()
    assert [(r.file_no, r.line_no, "finish_reason" in r["keys"]) for r in rows] == [(0, 1, True), (0, 3, False), (1, 1, False)]
    (tmp_path / "c.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="unreadable line 1"):
        logs.read_jsonl(spark, f"{tmp_path}/c.jsonl").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "a string, b string")
    logs.write_jsonl(df, f"{tmp_path}/out")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        logs.write_jsonl(df, f"{tmp_path}/out")
    logs.write_jsonl(df, f"{tmp_path}/out", resume=True)
    assert spark.read.text(f"{tmp_path}/out").distinct().first().value == '{"a":"é","b":null}'
    assert logs.canonical({"b": 1, "a": "é"})[0].startswith('{\n  "a": "é"')


def test_pages_back_off():
    waits, calls = [], []

    def opened(url, timeout):
        calls.append(url)
        raise OSError

    with pytest.raises(OSError):
        logs.get_json("x", opened=opened, sleep=waits.append)
    assert waits == [1, 2, 4] and len(calls) == 4


def test_sample_is_even(spark):
    df = spark.createDataFrame([(i, "x" * (100 + 37 * i), "s") for i in range(90)] + [(500, "x" * 100, "s"), (501, None, "s")], "i int, t string, s string")
    got = mining.stratified(df, "i", "t", "s", 30).groupBy("bucket").count().collect()
    assert {r["count"] for r in got} == {10}


def test_neighbours_by_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v[i].tolist(), i % 3) for i in range(60)] + [(99, None, 0)], "id int, e array<double>, l int")
    got = mining.neighbours(df, "id", "e", "l", df.where("id % 7 = 0"), 4, block=3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 60, 7):
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:4]
        assert [r.id for r in got.where(F.col("q") == q).orderBy("rank").collect()] == want


def test_stream_keeps_latest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "model string, case_id string, response string, seq long"
    for k, rows in enumerate([[("m", "1", "bad", 1)], [("m", "1", "good", 2), ("m", "2", "x", 3)]]):
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(["model", "case_id", "response", "seq"], r, strict=True))) for r in rows))
        q = stream_log.keep_latest(stream_log.read_log(spark, str(src), schema), f"{tmp_path}/table", f"{tmp_path}/ck", ["model", "case_id"], ["seq"])
        q.awaitTermination()
    kind = spark.createDataFrame([], schema).schema
    got = stream_log.table_at(spark, f"{tmp_path}/table", 1, kind).orderBy("seq").collect()
    assert [(r.case_id, r.response) for r in got] == [("1", "good"), ("2", "x")]
    assert [r.response for r in stream_log.table_at(spark, f"{tmp_path}/table", 0, kind).collect()] == ["bad"]
    with pytest.raises(Exception, match="epoch=6|PATH_NOT_FOUND"):
        stream_log.upserted(got_df(spark, schema), 7, f"{tmp_path}/table", ["model", "case_id"], ["seq"])


def got_df(spark, schema):
    return spark.createDataFrame([("m", "3", "y", 9)], schema)


def test_windows_of_a_stream_drop_what_is_late(spark, tmp_path):
    src = tmp_path / "w"
    src.mkdir()
    schema = "ts timestamp, model string, error string"
    days = [["2026-03-01 10:00:00", "2026-03-01 11:00:00"], ["2026-03-09 10:00:00"], ["2026-03-01 12:00:00", "2026-03-20 00:00:00"]]
    for k, ts in enumerate(days):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"ts": t, "model": "m", "error": "bad" if i else None}) for i, t in enumerate(ts)))
        counts = stream_log.windowed_counts(stream_log.read_log(spark, str(src), schema), "ts", "model")
        q = counts.writeStream.format("parquet").option("path", f"{tmp_path}/windows").option("checkpointLocation", f"{tmp_path}/wck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {str(r.window.start)[:10]: (r.n, r.failed) for r in spark.read.parquet(f"{tmp_path}/windows").collect()}
    assert got["2026-03-01"] == (2, 1)


def test_equal_names_in_two_folders_keep_their_order(spark, tmp_path):
    for k, name in enumerate(["two/a.jsonl", "one/a.jsonl", "one/ba.jsonl"]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"model": "m", "case_id": "1", "response": str(k)}) + "\n")
    rows = logs.read_jsonl(spark, [f"{tmp_path}/two/a.jsonl", f"{tmp_path}/one/a.jsonl", f"{tmp_path}/one/ba.jsonl"])
    assert [(r.file_no, r.response) for r in rows.orderBy("file_no").collect()] == [(0, "0"), (1, "1"), (2, "2")]
    assert [r.response for r in logs.merged_histories(rows, ["model", "case_id"]).collect()] == ["2"]
    assert [r.file_no for r in logs.read_jsonl(spark, [f"{tmp_path}/one", f"{tmp_path}/two/a.jsonl"]).orderBy("file_no").collect()] == [0, 0, 1]


def test_line_numbers_over_parts_of_a_file(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(json.dumps({"model": "m", "case_id": str(i)}) + "\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = logs.read_jsonl(spark, f"{tmp_path}/big.jsonl")
        assert rows.where(F.col("line_no") != F.col("case_id").cast("int") + 1).count() == 0 and rows.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_first_shard_wins_and_reports_compare(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([("h", str(k)), (None, "x")], "hash string, text string").coalesce(1).write.parquet(f"{tmp_path}/s{k}.parquet")
    assert [tuple(r) for r in logs.read_shards(spark, f"{tmp_path}/s*.parquet", ["hash", "text"], "hash").collect()] == [("h", "0")]
    text, _ = logs.canonical({"a": 1, "b": 2})
    assert logs.check({"b": 2, "a": 1}, text) == [] and logs.check({"a": 1, "b": 3}, text) == ['-  "b": 2', '+  "b": 3']
    assert set(logs.LOADERS) >= {"jsonl", "parquet", "paged", "sequential"}


def test_pages_one_after_the_other(monkeypatch):
    pages = {1: {"items": [1, 2], "has_more": True}, 2: {"items": [3], "has_more": False}}
    monkeypatch.setattr(logs, "get_json", lambda url: pages[int(url)])
    got = list(logs.SequentialReader({"url": "{page}"}).read(None))
    assert got == [(1, "1"), (1, "2"), (2, "3")]
    monkeypatch.setattr(logs, "get_json", lambda url: {"rows": [{"k": url}] * 3})
    reader = logs.PagedReader({"url": "{offset}", "rows": "5", "page": "3"})
    assert [k for p in reader.partitions() for k, _ in reader.read(p)] == [0, 1, 2, 3, 4]
