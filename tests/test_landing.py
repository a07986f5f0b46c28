"""The log source, read and streamed, and landing: against one batch fold of the same files."""

import json
import os
from datetime import datetime, timezone

import pytest
import zstandard
from pyspark.sql import functions as F
from test_sessions import CASES, NINE, T, call, head, put, rec, says

from sessionloom.sessions import fold
from sessionloom.sources import log_source, session_logs
from sessionloom.streaming import landing


def rows(df, *drop):
    return sorted((tuple(map(str, r)) for r in df.drop(*drop).collect()), key=str)


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    for name, records in list(CASES.items())[:6]:
        put(root, name, [head(name), *records] if not any(r["type"] == "session" for r in records) else records)
    put(root, "nine", NINE)
    folder = root / "sessions" / "--k--" / "broken"
    folder.mkdir(parents=True)
    (folder / "session.jsonl.zstd").write_bytes(zstandard.ZstdCompressor().compress(b'{"type": "session"}\n' * 400)[:-9] + b"xxxxxxxxx")
    two = root / "sessions" / "--k--" / "frames"
    two.mkdir(parents=True)
    c = zstandard.ZstdCompressor()
    (two / "session.jsonl.zstd").write_bytes(c.compress(json.dumps(head("frames")).encode() + b"\n") + c.compress(json.dumps(says("hi \udcff")).encode()))
    return root


def test_source_reads_what_binary_files_give(spark, logs):
    log_source.register(spark)
    mine = spark.read.format("session_logs").option("partBytes", 200).load(str(logs))
    assert mine.rdd.getNumPartitions() > 3
    theirs = session_logs.read_session_logs(spark, str(logs)).withColumn("path", F.regexp_replace("path", "^file:", ""))
    assert rows(mine, "modified") == rows(theirs)
    assert [r.readable for r in mine.filter("path LIKE '%broken%'").collect()] == [False]
    assert spark.read.format("session_logs").load(str(logs / "none")).count() == 0


def test_filters_on_the_path_leave_files_out():
    from pyspark.sql.datasource import EqualTo, StringContains

    files = [log_source.LogFile(f"/r/{n}/session.jsonl.zstd", 5, 1) for n in "abc"]
    reader = log_source.LogReader("/r", "logs", "*", 5)
    list_files, log_source.list_files = log_source.list_files, lambda *a: files
    try:
        assert list(reader.pushFilters([StringContains(("path",), "/b/"), EqualTo(("value",), "x")]))
        assert [f.path for p in reader.partitions() for f in p.files] == ["/r/b/session.jsonl.zstd"]
        assert len(log_source.LogReader("/r", "logs", "*", 10).partitions()) == 2
    finally:
        log_source.list_files = list_files


def test_snapshots_are_read_event_by_event(spark, tmp_path, monkeypatch):
    header = {k: v for k, v in NINE[0].items() if k != "type"}
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, [
        {"schema": "bridge-1", "operation": "report", "options": {"x": [1, {"events": []}]}}, {"kind": "session", "snapshot": {"session": header, "events": NINE[1:]}},
        {"session": {}, "events": "no"}, {"events": NINE[1:3], "more": {"y": 1}, "session": header | {"id": "late"}}, [1, 2], {"session": {}, "events": []},
    ])))
    (tmp_path / "b.jsonl").write_text(json.dumps({"session": header | {"id": "ok"}, "events": [rec("user/message", message="x" * 5000)]}) + '\n{"session": {"id": "cut"}, "events": [{"a": 1}, {"b"')
    for size in (log_source.READ_CHARS, 7):
        monkeypatch.setattr(log_source, "READ_CHARS", size)
        got = {}
        for name in "ab":
            for path, seq, value, ok in log_source.snapshot_rows(str(tmp_path), log_source.LogFile(f"{tmp_path}/{name}.jsonl", 1, 1)):
                got.setdefault(path.rsplit("/", 1)[1], []).append((seq, json.loads(value) if ok else None))
        assert {k: len(v) for k, v in got.items()} == {"a.jsonl#s1": 9, "a.jsonl#2": 1, "a.jsonl#late": 3, "a.jsonl#4": 1, "a.jsonl#stream-000005": 1, "b.jsonl#ok": 2, "b.jsonl#1": 1}
        assert [v for _, v in got["a.jsonl#s1"]][1:] == NINE[1:] and got["a.jsonl#s1"][0][1] == NINE[0] and got["a.jsonl#2"] == got["b.jsonl#1"] == [(0, None)]
    log_source.register(spark)
    records, bad = session_logs.normalise_records(spark.read.format("session_logs").option("kind", "snapshots").load(str(tmp_path)))
    assert fold.fold_sessions(records).filter("session_id = 's1' AND total_tokens = 460").count() == 1 and bad.filter("reason = 'unreadable'").count() == 3


def test_a_long_log_is_read_in_batches(spark, tmp_path):
    put(tmp_path, "long", [head("long"), *(says("word " * 50, i) for i in range(20_000))])
    file = log_source.list_files(str(tmp_path), "*")[0]
    got = list(log_source.batches(str(tmp_path), "logs", [file]))
    assert max(b.num_rows for b in got) <= log_source.BATCH_LINES and sum(b.num_rows for b in got) == 20_001
    assert [b["seq"][0].as_py() for b in got][:2] == [0, log_source.BATCH_LINES]


def test_landing_in_batches_equals_one_fold(spark, tmp_path):
    """Files arrive in three batches, one grows and comes twice, and the last batch is repeated."""
    source, root = tmp_path / "logs", f"{tmp_path}/stored"
    day = 86_400_000
    logs = {f"s{i}": [head(f"s{i}", createdAt=T - i * day), rec("turn/start", turn=1), says("hello there"), call("bash", command="ls")] for i in range(6)}
    logs["s2"].insert(3, {"type": "brand/new", "data": {}})
    logs["s3"].insert(3, {"type": "user/message", "data": 5})
    source.mkdir()
    for step, names in enumerate((["s0", "s1"], ["s2", "s3"], ["s4", "s5", "s0"])):
        for name in names:
            grown = [*logs[name], rec("turn/end", 900, turn=1, reason={"kind": "completed"})] if step == 2 else logs[name]
            if (source / "sessions" / "--k--" / name).exists():
                (source / "sessions" / "--k--" / name / "session.jsonl.zstd").unlink()
                (source / "sessions" / "--k--" / name).rmdir()
            put(source, name, grown, key="--k--")
            os.utime(source / "sessions" / "--k--" / name / "session.jsonl.zstd", (1_700_000_000 + step, 1_700_000_000 + step))
        landing.land(spark, str(source), root, f"{tmp_path}/checkpoint").awaitTermination()
    log_source.register(spark)
    records, bad = session_logs.normalise_records(spark.read.format("session_logs").load(str(source)))
    want = fold.fold_sessions(records)
    assert landing.coverage(spark, root).count() == 3
    assert rows(landing.sessions(spark, root).select(want.columns)) == rows(want) and landing.sessions(spark, root).count() == 6
    assert rows(landing.rejected(spark, root)) == rows(bad)

    last = spark.read.format("session_logs").load(str(source)).filter(F.col("path").rlike("/(s4|s5|s0)/"))
    seen = landing.land_batch(last, root, 2)
    assert rows(landing.sessions(spark, root).select(want.columns)) == rows(want)
    assert (seen["files"], seen["records"], seen["unknown_types"]) == (3, 15, {})
    one = {r.batch: r for r in landing.coverage(spark, root).collect()}[1]
    assert (one.files, one.records, one.malformed_lines, one.unknown_records, one.unknown_types, one.unreadable_files, one.without_header) == (2, 8, 1, 1, {"brand/new": 1}, 0, 0)

    at = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
    some = landing.records(spark, root, at(T - 3 * day), at(T - 2 * day))
    assert rows(some) == rows(records.filter(F.col("path").rlike("/(s2|s3)/")))
    plan = some._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "PartitionFilters" in x]
    assert any("dynamicpruning" in x for x in scans) and "created_date" in next(x for x in scans if "dynamicpruning" in x)


def test_lines_without_header_and_damage_in_coverage(spark, tmp_path):
    raw = spark.createDataFrame([
        ("/l/--k--/a/f", 0, '{"type": "step/start"}', True), ("/l/--k--/a/f", 1, "nope", True), ("/l/--k--/b/f", 0, None, False),
        *[("/l/--k--/c/f", i, json.dumps(r), True) for i, r in enumerate([head("c"), {"type": "odd"}, {"type": "odd"}, {}, head("again")])],
    ], session_logs.RAW)
    seen = landing.land_batch(raw, f"{tmp_path}/r", 0)
    assert {k: v for k, v in seen.items()} == {
        "files": 3, "records": 1, "unreadable_files": 1, "malformed_lines": 1, "unknown_records": 3, "early_records": 0, "later_headers": 1, "without_header": 1, "unknown_types": {"odd": 2, "<missing>": 1},
    }
    assert landing.sessions(spark, f"{tmp_path}/r").count() == 1
