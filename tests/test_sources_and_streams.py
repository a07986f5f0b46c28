"""Session logs from files, and streams against their batch forms."""

import json

import zstandard
from pyspark.sql import functions as F

from sessionloom.functions import tools
from sessionloom.sources import session_logs
from sessionloom.streaming import live


def put(folder, lines):
    folder.mkdir(parents=True)
    (folder / "session.jsonl.zstd").write_bytes(zstandard.ZstdCompressor().compress("\n".join(lines).encode()))


def test_session_logs(spark, tmp_path):
    record = lambda kind, **data: json.dumps({"type": kind, "time": 5, "data": data})
    head = json.dumps({"type": "session", "id": "s1", "cwd": "/w"})
    put(tmp_path / "a" / "1", [record("turn/start", turn=1), head, "", "{bad", record("odd"), head, record("tool/call", callId="c")])
    put(tmp_path / "a" / "2", [record("turn/start")] * 3)
    put(tmp_path / "b" / "3", [record("step/start")] * 60 + [head])
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "session.jsonl.zstd").write_bytes(b"not compressed")
    records, bad = session_logs.normalise_records(session_logs.read_session_logs(spark, str(tmp_path)))
    kinds = {r["type"]: r["count"] for r in records.groupBy("type").count().collect()}
    assert kinds == {"turn/start": 1, "session": 2, "tool/call": 1, "step/start": 50}
    reasons = {r["reason"]: r["count"] for r in bad.groupBy("reason").count().collect()}
    assert reasons == {"unreadable": 1, "malformed": 1, "unknown": 1, "later_header": 1, "no_header": 3, "early": 10}


def test_snapshots(spark, tmp_path):
    good = {"session": {"id": "s", "createdAt": 5}, "events": [{"type": "turn/start", "time": 1, "data": {"turn": 1}}]}
    lines = [{"schema": "x", "operation": "report", "options": {}}, good, {"kind": "session", "snapshot": good | {"session": {}}}, {"header": {"id": "s"}, "events": []}, {"session": {}, "events": 3}]
    (tmp_path / "good.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "bad.jsonl").write_text("[1]")
    records, bad = session_logs.normalise_records(session_logs.read_snapshots(spark, str(tmp_path)))
    rows = records.orderBy("path", "seq").collect()
    assert sorted((r["path"].split("#")[1][:2] == "s", r["type"]) for r in rows) == [(False, "session"), (False, "turn/start"), (True, "session"), (True, "turn/start")]
    assert all(json.loads(r["data"]).get("createdAt") == 5 for r in rows if r["type"] == "session" and r["path"].endswith("#s"))
    assert [r["reason"] for r in bad.collect()] == ["unreadable"] * 3


def test_refresh_of_a_stored_table(spark, tmp_path):
    from sessionloom.sources import incremental

    stored, scratch, asked = f"{tmp_path}/stored", f"{tmp_path}/scratch", []

    def parse(df):
        asked.append(sorted(r["path"] for r in df.collect()))
        return df.select("path", F.explode(F.split("body", " ")).alias("word"))

    def go(rows):
        df = incremental.with_fingerprint(spark.createDataFrame(rows, "path string, body string"), ["body"], "v1")
        return incremental.refresh_table(df, stored, parse, scratch, parts=4)

    first = [(f"p{i}", f"a b{i}") for i in range(8)]
    assert go(first) == {"hits": 0, "misses": 8, "invalid": 0, "removed": 0, "write_errors": 0}
    assert go(first)["hits"] == 8 and len(asked) == 1
    second = [("p0", "x y z"), *first[1:6], ("p9", "n"), (None, "lost")]
    assert go(second) == {"hits": 5, "misses": 1, "invalid": 1, "removed": 2, "write_errors": 0} and asked[-1] == ["p0", "p9"]
    want = sorted((p, w) for p, body in second if p for w in body.split(" "))
    assert sorted(map(tuple, incremental.stored_rows(spark, stored).select("path", "word").collect())) == want
    assert incremental.is_storage_error(RuntimeError("job aborted: java.io.IOException: No space left on device")) and not incremental.is_storage_error(ValueError("bad column"))
    assert go([("p9", "n")])["removed"] == 6 and incremental.stored_rows(spark, stored).count() == 1


def test_sinks(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([("b1", 1), ("b1", 2), ("b2", 3)], "batch_id string, n int")
    with pytest.raises(ValueError):
        session_logs.write_report(df, f"{tmp_path}/src/out", f"{tmp_path}/src")
    session_logs.write_report(df, f"{tmp_path}/out", f"{tmp_path}/src")
    session_logs.write_batches(df, f"{tmp_path}/batches")
    assert spark.read.json(f"{tmp_path}/out").count() == 3 and sorted(p.name for p in (tmp_path / "batches").glob("batch*")) == ["batch_id=b1", "batch_id=b2"]


def test_nested_results(spark):
    message = lambda **m: json.dumps({"message": m})
    rows = [
        ("c1", "", json.dumps({"callId": "c1"})),
        ("c2", "", message(source={"callId": "c2"})),
        ("c3", "a\nb", message(content=[{"toolCallId": "", "text": "a"}, {"toolCallId": "c3", "content": [{"type": "text", "text": "b"}, {"type": "Image", "text": "no"}]}])),
        ("", "x y", message(content=[{"type": "text", "text": "data:zz"}, {"text": "x y"}, {"text": "q1" * 300}])),
        ("", "", "{}"),
    ]
    df = spark.createDataFrame(rows, "want string, said string, data string")
    got = df.select("want", "said", session_logs.call_id(F.col("data")).alias("id"), tools.walk_json(F.get_json_object("data", "$.message"))["text"].alias("text"))
    got = [tuple(r) for r in got.collect()]
    assert [r[2:] for r in got] == [r[:2] for r in got]


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(100)


def test_streams_equal_batches(spark):
    folder = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{folder}/events.parquet")
    stream = lambda: live.stream_files(spark, folder, batch.schema, "events.parquet")
    for name, make in {
        "live_counts": lambda r: live.window_counts(r, "ts", ["event_type"], "1 hour", "10 minutes"),
        "live_sliding": lambda r: live.window_counts(r, "ts", ["event_type"], "1 hour", "10 minutes", "30 minutes"),
        "live_sessions": lambda r: live.closed_sessions(r, "ts", ["user_id"], "30 minutes", "10 minutes"),
    }.items():
        run(make(stream()), name, "complete")
        want = make(batch.withColumn("ts", F.col("ts").cast("timestamp")))
        got = spark.table(name)
        assert got.count() == want.count() > 0 and not got.exceptAll(want).count()
    run(live.usage_once(stream(), "ts", ["user_id"], "10 minutes"), "live_usage", "append")
    assert spark.table("live_usage").count() == batch.select("user_id").distinct().count()


def test_live_retries_equal_the_batch(spark):
    from sessionloom.operators import ordered

    folder = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{folder}/events.parquet")
    kind = F.col("event_type")

    def steps(df):
        return df.select(
            F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.isin("view", "click").alias("is_call"),
            F.get_json_object("props", "$.k").alias("print"), F.when(F.col("event_id") % 7 == 0, "all").otherwise("default").alias("mode"), (kind == "click").alias("polls"),
            (kind == "error").alias("failed"), (kind == "purchase").alias("changed"),
        )

    run(live.live_retries(steps(live.stream_files(spark, folder, batch.schema, "events.parquet")), "1 hour"), "live_retry", "append")
    want = ordered.classify_retries(steps(batch), ["session"], "print", ["ts", "event_id"], F.col("is_call"), F.col("polls"), F.col("failed"), F.col("changed"), mode="mode").select("session", "event_id", "retry")
    got = spark.table("live_retry")
    assert got.count() == want.count() > 0 and not got.exceptAll(want).count()


def test_live_usage_prefers_messages(spark, tmp_path):
    rows = [("s", 1, 1, 0, 10), ("s", 1, 1, 1, 20), ("s", 1, 1, 0, 30), ("s", 2, 1, 0, 5), ("s", 2, 1, 0, 7)]
    df = spark.createDataFrame([(a, b, c, bool(m), i, t) for i, (a, b, c, m, t) in enumerate(rows)], "session string, turn int, step int, message boolean, seq int, tokens int")
    df.withColumn("ts", F.timestamp_seconds(F.col("seq"))).coalesce(1).write.parquet(f"{tmp_path}/u")
    stream = live.stream_files(spark, f"{tmp_path}/u", spark.read.parquet(f"{tmp_path}/u").schema)
    run(live.usage_best(stream, "ts", ["session", "turn", "step"], "message", ["seq"], "tokens", "1 hour"), "live_best", "complete")
    assert sorted(map(tuple, spark.table("live_best").collect())) == [("s", 1, 1, 20), ("s", 2, 1, 7)]


def test_landing_goes_on(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("source", "out", "mark"))
    for n in (3, 8):
        spark.range(n).write.mode("append").parquet(source)
        live.land(live.stream_files(spark, source, "id long"), out, mark).awaitTermination(100)
    assert spark.read.parquet(out).count() == 11
