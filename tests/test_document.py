"""From log lines to the published report: the document, evidence packs, labels and what becomes of them."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from test_sessions import NINE, T, answer, bronze, call, head, put, rec, result, says

from sessionloom.sessions import document, evidence, fold, packs, report
from sessionloom.sources import session_logs

NOW = datetime.fromtimestamp(T / 1000 + 86_400, timezone.utc)
SECRET = "api_key=sk-test-abcdefghijklmnopqrstuv in /sensitive-home/person/project"
LOGS = {
    "a1": [head("a1"), rec("turn/start", turn=1), says(f"Implement it, {SECRET}"), answer({"inputTokens": 10, "outputTokens": 5}), call("bash", command="python -m unittest"), result("Ran 3 tests\nExit code: 0"), says("no, wrong file"), rec("turn/end", 2_400_000, turn=1, reason={"kind": "completed"})],
    "a2": [head("a2", origin="subagent", parentSession="a1"), says("help"), call("bash", command="x"), result("Exit code: 2"), answer({"inputTokens": 7})],
    "b1": [head("b1", cwd="/workspace/project-b", createdAt=T - 20 * 86_400_000), says("Question one?"), answer({"outputTokens": 3}), says("Question two?")],
    "c1": [head("c1", createdAt=T - 90 * 86_400_000), says("too old")],
}


def settings(**more):
    since, until = report.time_range(NOW, days=30)
    return document.Settings(since, until, **more)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("stored"))
    bronze(spark, LOGS).write.parquet(f"{out}/records")
    records = spark.read.parquet(f"{out}/records")
    for name, df in {"sessions": fold.fold_sessions(records), "said": fold.messages(records), "steps": fold.tool_steps(records)}.items():
        df.write.parquet(f"{out}/{name}")
    return {name: spark.read.parquet(f"{out}/{name}") for name in ("sessions", "said", "steps")}


BAD = [("/x/sessions/--k--/d1/f", 0, "odd/type", "unknown"), ("/x/sessions/--k--/d2/f", 0, None, "unreadable"), ("/x/sessions/--k--/a1/f", 9, "x", "malformed")]


def bad_rows(spark, rows=BAD):
    return spark.createDataFrame(rows, "path string, seq long, type string, reason string")


def built(spark, stored, **more):
    t = document.tables(stored["sessions"], bad_rows(spark), stored["said"], settings(**more))
    return t, document.sections(t, settings(**more))


@pytest.fixture(scope="module")
def base(spark, stored, tmp_path_factory):
    t, parts = built(spark, stored)
    out = f"{tmp_path_factory.mktemp('parts')}/p"
    parts.write.parquet(out)
    return t, spark.read.parquet(out)


def test_document(spark, base):
    t, parts = base
    row = document.document(parts).first()
    assert row.errors == []
    doc = json.loads(row.report)
    assert row.report == json.dumps(doc, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert (doc["totals"]["sessions"], doc["totals"]["tool_calls"], doc["totals"]["tool_failures"], doc["totals"]["tokens"]["total_tokens"]) == (3, 2, 1, 25)
    c = doc["coverage"]
    assert (c["files_scanned"], c["sessions_analyzed"], c["skipped_outside_window"], c["unreadable_files"], c["malformed_lines"], c["unknown_record_types"]) == (5, 3, 1, 1, 1, {"odd/type": 1})
    assert [p["project"] for p in doc["projects"]] == ["project-a", "project-b"] and doc["role_metrics"][0]["role"] == "root_task"
    fam = {f["date"]: f for f in doc["task_families"]}
    big = next(f for f in doc["task_families"] if f["rollout_count"] == 2)
    assert big["role_counts"] == {"root_task": 1, "task_subagent": 1} and big["role_token_totals"]["task_subagent"]["input_tokens"] == 7
    assert len(big["rollout_ids"]) == 2 and big["rollout_ids"][0] == big["root_rollout_id"] and big["root_rollout_id"].startswith("rollout-") and len(fam) == 2
    assert [s["rollout_id"] for s in doc["session_summaries"]] and {"log_completed", "verified_completed", "accepted"} == set(doc["session_summaries"][0]["completion"])
    assert doc["warnings"] == ["few_sessions", "damaged_records"] and [h["sessions"] for h in doc["period_comparison"]] == [1, 2] and doc["period_comparison"][1]["change"]["sessions"] == 1
    assert {"kind", "project", "date", "status", "work_area", "role", "platform", "task_family_id", "text"} == set(doc["excerpts"][0])
    assert len(doc["usage_profile"]["hours_local"]) == 24 and doc["providers"][0]["models"] == [{"model": "m", "sessions": 3}]
    assert "sk-test" not in row.report and "/sensitive-home" not in row.report and '"a1"' not in row.report


def test_privacy_of_a_document(spark, stored):
    local = document.document(built(spark, stored, privacy="local")[1]).first()
    assert local.errors == [] and '"a1"' in local.report and "sk-test" not in local.report
    bare = document.document(built(spark, stored, privacy="metrics")[1]).first()
    doc = json.loads(bare.report)
    assert bare.errors == [] and doc["excerpts"] == [] and {s["title"] for s in doc["session_summaries"]} == {"Content omitted"} and doc["scope"]["privacy_mode"] == "metrics_only"


def test_files_and_snapshots_give_equal_documents(spark, tmp_path):
    put(tmp_path, "s1", NINE)
    (tmp_path / "snapshots.jsonl").write_text(json.dumps({"kind": "session", "snapshot": {"session": {k: v for k, v in NINE[0].items() if k != "type"}, "events": NINE[1:]}}))
    raw = session_logs.read_session_logs(spark, str(tmp_path)).withColumn("path", F.lit("/x/sessions/--k--/file/f"))
    records, bad = session_logs.normalise_records(raw.unionByName(session_logs.read_snapshots(spark, str(tmp_path / "snapshots.jsonl")).withColumn("path", F.lit("/x/sessions/--k--/snapshot/f"))))
    fold.fold_sessions(records).write.parquet(f"{tmp_path}/fold")
    fold.messages(records).write.parquet(f"{tmp_path}/said")
    docs = []
    for source in ("file", "snapshot"):
        sessions, said = (spark.read.parquet(f"{tmp_path}/{name}").filter(F.col("path").contains(source)).withColumn("path", F.lit("p")) for name in ("fold", "said"))
        docs.append(document.document(document.sections(document.tables(sessions, bad_rows(spark, []), said, settings()), settings())).first())
    assert bad.count() == 0
    assert docs[0].errors == [] and docs[0].report == docs[1].report and '"sessions":1' in docs[0].report


def test_empty_report(spark, stored):
    none = {k: d.limit(0) for k, d in stored.items()}
    t = document.tables(none["sessions"], bad_rows(spark, []), none["said"], settings())
    row = document.document(document.sections(t, settings())).first()
    assert row.errors == [] and json.loads(row.report)["warnings"] == ["no_input"] and json.loads(row.report)["session_summaries"] == []


def test_publishing_is_all_or_nothing(spark, base, tmp_path):
    t, parts = base
    root = f"{tmp_path}/reports"
    with pytest.raises(ValueError):
        document.publish(parts, f"{tmp_path}/logs/out", f"{tmp_path}/logs")
    first = document.publish(parts, root, f"{tmp_path}/logs", {"families": t["families"]})
    told = document.published(spark, root).first().report
    with pytest.raises(ValueError):
        document.publish(parts.filter("name <> 'totals'"), root, f"{tmp_path}/logs")
    assert document.published(spark, root).first().report == told and document.published(spark, root, "families").count() == 2
    second = document.publish(document.overlay(parts, spark.createDataFrame([("warnings", '["new"]')], "name string, json string")), root, f"{tmp_path}/logs")
    assert first < second and json.loads(document.published(spark, root).first().report)["warnings"] == ["new"]


def label(candidate):
    ids = [e["id"] for e in candidate["evidence"]]
    return json.dumps({
        "task_family_id": candidate["family_id"], "goal": "g", "task_type": "review", "interaction_style": "i", "instruction_handling": "followed", "tool_execution": "strong", "verification_quality": "partial",
        "handoff_quality": "clear", "frictions": [], "strengths": ["s"], "outcome_inference": "unclear", "evidence_refs": ids[:1],
    })


def aggregate_of(candidates):
    item = {
        "title": "t", "text": "x", "supporting_task_family_ids": [c["family_id"] for c in candidates], "evidence_refs": [c["evidence"][0]["id"] for c in candidates], "confidence": "high", "measurement": "inferred",
    }
    out = {s: [item] for s in evidence.SECTIONS}
    out["recommendations"] = [item | {"recommendation_key": "k", "action": "a", "copy_prompt": "c", "singleton_observation": True}]
    return out


@pytest.fixture(scope="module")
def prepared(spark, base, stored, tmp_path_factory):
    out = f"{tmp_path_factory.mktemp('packs')}/p"
    packs.prepare(base[0], stored["said"], stored["steps"], settings()).write.parquet(out)
    return spark.read.parquet(out)


def test_packs(spark, base, stored, prepared):
    rows = {r.family_id: r for r in prepared.collect()}
    assert set(rows) == {"a1", "b1"} and {r.batch_id for r in rows.values()} == {"batch-001"}
    said = rows["a1"].evidence
    assert [e.role for e in said] == ["user", "assistant", "tool", "user", "user", "tool", "assistant"]
    assert "sk-test" not in str(rows) and "/sensitive-home" not in str(rows)
    assert "verification" in said[2].text and "exit code 2" in said[5].text and all(e.id.startswith("evidence-") for e in said)
    m = packs.manifest(prepared, base[0], settings()).first()
    assert (m.selected, m.eligible, m.hits, m.misses, m.batch_ids, m.skipped) == (2, 2, 0, 2, ["batch-001"], False)
    task = json.loads(packs.batch_tasks(prepared).orderBy("position").first().task)
    assert task["evidence"] and task["metrics"]["user_messages"] >= 2 and task["task_family_id"] in rows
    talk = packs.prepare(base[0], stored["said"], stored["steps"], settings(depth="conversation")).collect()
    assert all(e.role != "tool" for r in talk for e in r.evidence)
    assert packs.prepare(base[0], stored["said"], stored["steps"], settings(privacy="local", analysis_privacy="metrics")).count() == 0
    assert "/sensitive-home/person/project" in str(packs.prepare(base[0], stored["said"], stored["steps"], settings(analysis_privacy="local")).collect())


def test_fingerprints_follow_measures_and_evidence_alone(spark, base, stored, prepared):
    prints = lambda t, said=stored["said"]: {r.family_id: r.fingerprint for r in packs.prepare(t, said, stored["steps"], settings()).collect()}
    before = {r.family_id: r.fingerprint for r in prepared.collect()}
    richer = base[0] | {"sessions": base[0]["sessions"].withColumns({"total_tokens": F.col("total_tokens") + 5, "active_ms": F.col("active_ms") + 1000})}
    assert prints(richer) == before
    busier = base[0] | {"sessions": base[0]["sessions"].withColumn("tool_calls", F.when(F.col("session_id") == "b1", 9).otherwise(F.col("tool_calls")))}
    other = stored["said"].withColumn("body", F.when(F.col("body") == "help", "helped").otherwise(F.col("body")))
    after = prints(busier, other)
    assert all(after[k] != before[k] for k in ("a1", "b1"))


def test_labels_from_the_cache(spark, base, stored, prepared):
    rows = {r.family_id: r.asDict(recursive=True) for r in prepared.collect()}
    cache = spark.createDataFrame([(rows["a1"]["fingerprint"], label(rows["a1"])), (rows["b1"]["fingerprint"], json.dumps({"task_family_id": "b1"}))], "fingerprint string, facet string")
    got = {r.family_id: r for r in packs.prepare(base[0], stored["said"], stored["steps"], settings(), cache).collect()}
    assert got["a1"].facet and got["a1"].batch_id is None and got["b1"].facet is None and got["b1"].batch_id == "batch-001"


def test_finalising(spark, base, prepared):
    parts, about = base[1], packs.manifest(prepared, base[0], settings())
    whole = {r.name: r.json for r in parts.collect()}
    fallback = {r.name: r.json for r in packs.finalise(parts, about, settings(), prepared).collect()}
    assert json.loads(fallback.pop("semantic_analysis"))["status"] == "fallback" and fallback == whole
    bare = {r.name: r.json for r in packs.finalise(parts, about, settings(privacy="metrics"), prepared).collect()}
    assert json.loads(bare["semantic_analysis"])["fallback_reason"] == "metrics_mode"

    rows = [r.asDict(recursive=True) for r in prepared.orderBy("position").collect()]
    facets = spark.createDataFrame([(r["family_id"], label(r)) for r in rows], "family_id string, facet string")
    aggregate = spark.createDataFrame([(json.dumps(aggregate_of(rows)),)], "json string")
    assert packs.label_errors(prepared, facets, aggregate, settings()).collect() == []
    done = packs.finalise(parts, about, settings(), prepared, facets, aggregate)
    row = document.document(done).first()
    doc = json.loads(row.report)
    assert row.errors == [] and doc["semantic_analysis"]["status"] == "complete" and doc["semantic_analysis"]["selection"]["selected"] == 2
    assert [f["task_family_id"] for f in doc["semantic_facets"]] == [r["family_id"] for r in rows] and doc["narrative"]["glance"][0]["evidence"] == 2
    r = doc["recommendations"][0]
    assert (r["priority"], r["support"], r["id"][:9], len(r["id"])) == ("medium", 2, "semantic-", 21) and len(r["supporting_task_family_ids"]) == 2
    assert doc["totals"] == json.loads(whole["totals"]) and doc["semantic_workflows"][0]["title"] == "t" and doc["semantic_evidence"][0]["untrusted_historical_text"] is True

    wrong = facets.withColumn("facet", F.regexp_replace("facet", '"goal": "g"', '"goal": "g", "accepted": true'))
    assert {e.error for e in packs.label_errors(prepared, wrong, aggregate, settings()).collect()} == {"forbidden:accepted"}
    with pytest.raises(ValueError):
        packs.finalise(parts, about, settings(), prepared, wrong, aggregate)
    lost = packs.label_errors(prepared, facets.limit(1).union(facets.limit(1)), spark.createDataFrame([('{"glance": []}',)], "json string"), settings())
    assert {e.error for e in lost.collect()} >= {"no_facet", "two_facets", "workflows", "recommendations"}


HOSTILE = [
    '{"output": "bad \\ud800 x"}', '{"\\udc00key": "v", "text": "\\ud83d\\ude00 fine"}', "[" * 5000 + "]" * 5000, '{"exit_code": 99999999999999999999}', '{"exit_code": "-99999999999999999999"}', '{"exit_code": NaN}',
    '{"exit_code": Infinity}', '{"exit_code": 0, "exit_code": 1}', '{"exit_code": 1e400}', '{"output": "Exit code: 99999999999999999999"}', '{"output": "Exit code: -99999999999999999999\\nExit code: 0"}', '{"output": "Exit code: 0"}',
    '{"wall_time_seconds": "1e999"}', '{"text": null}', '{"success": false}', '{"status": "FAILED"}', "", "null", '"plain"', '{"a": {"b": [[[{"ok": true}]]]}}', '{"exit_code": true}',
]


def test_hostile_results_do_not_stop_a_fold(spark):
    """Each line as a result's text of JSON and as its message; against a plain restatement of the outcome's rule."""
    from sessionloom.functions import tools

    df = spark.createDataFrame([(i, h) for i, h in enumerate(HOSTILE)], "i int, j string").select("i", tools.walk_json("j").alias("w"))
    got = {r.i: r for r in df.select("i", "w.text", tools.line_outcome(tools.lines_of(F.col("w.text")), tools.structured_outcome(F.col("w.scalars"))).alias("o")).collect()}
    assert [got[i].o.outcome for i in range(len(HOSTILE))] == [
        "unknown", "unknown", "unknown", "failure", "failure", "unknown", "unknown", "failure", "unknown", "failure", "failure", "success", "unknown", "unknown", "failure", "failure", "unknown",
        "unknown", "unknown", "success", "failure",
    ]
    assert "�" in got[0].text and got[1].text == "\U0001f600 fine" and got[3].o.exit_code == tools.LAST
    lines = {f"h{i}": [call("bash"), rec("tool/result", callId="c1", message={"content": [{"type": "tool-result", "toolCallId": "c1", "content": [{"type": "text", "text": h}]}]})] for i, h in enumerate(HOSTILE)}
    raw = [("/x/sessions/--k--/raw/f", 0, json.dumps(head("raw")), True), *[("/x/sessions/--k--/raw/f", i + 1, '{"type": "tool/result", "time": 5, "data": {"message": %s}}' % (h or "0"), True) for i, h in enumerate(HOSTILE) if len(h) < 1000]]
    raw += [(f"/x/sessions/--k--/raw/f", 100 + i, json.dumps(call("bash") | {"data": {"callId": "c", "name": "bash", "arguments": h}}), True) for i, h in enumerate(HOSTILE)]
    records = bronze(spark, lines).unionByName(session_logs.normalise_records(spark.createDataFrame(raw, session_logs.RAW))[0])
    assert fold.fold_sessions(records).count() == len(HOSTILE) + 1 and fold.tool_steps(records).filter("kind = 'result'").count() >= len(HOSTILE)
