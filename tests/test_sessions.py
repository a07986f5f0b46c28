"""Whole sessions from their records: literal logs, the same from files and from snapshots."""

import json

import pytest
import zstandard
from pyspark.sql import functions as F

from sessionloom.functions import classify, tools
from sessionloom.sessions import fold
from sessionloom.sources import session_logs

T = 1_786_442_400_000


def rec(kind, at=0, **data):
    return {"type": kind, "time": T + at, "data": data}


def head(name="s1", **fields):
    return {"type": "session", "version": 0, "id": name, "createdAt": T, "agentPreset": "standard", "cwd": "/workspace/project-a", **fields}


def says(text, at=0):
    return rec("user/message", at, content=[{"type": "text", "text": text}])


def call(name, at=0, call_id="c1", **args):
    return rec("tool/call", at, turn=1, step=1, callId=call_id, name=name, arguments=json.dumps(args))


def result(text, at=0, call_id="c1", bad=False, **more):
    content = [{"type": "tool-result", "toolCallId": call_id, "isError": bad, "content": [{"type": "text", "text": text}]}]
    return rec("tool/result", at, turn=1, step=1, callId=call_id, message={"source": {"kind": "tool", "callId": call_id}, "content": content}, **more)


def answer(usage, at=0, turn=1, step=1, text="Done.", **source):
    source = {"kind": "model", "provider": "p", "model": "m"} | source
    return rec("assistant/message", at, turn=turn, step=step, usage=usage, message={"role": "assistant", "source": source, "content": [{"type": "text", "text": text}]})


NINE = [
    head(), rec("turn/start", turn=1), says("Implement the feature in /home/ann/project; api_key=sk-test-abcdefghijklmnopqrstuv"),
    answer({"inputTokens": 120, "outputTokens": 40, "reasoningTokens": 20, "cacheReadTokens": 300}), call("bash", command="python -m unittest"),
    result("Ran checks: OK"), says("Keep the change narrow."), rec("session/title", title="A task", source={"kind": "provider"}),
    rec("turn/end", 3000, turn=1, reason={"kind": "completed"}),
]


def put(root, name, records, key="--workspace-project-a--"):
    folder = root / "sessions" / key / name
    folder.mkdir(parents=True)
    (folder / "session.jsonl.zstd").write_bytes(zstandard.ZstdCompressor().compress("\n".join(map(json.dumps, records)).encode()))


def bronze(spark, cases):
    """The records of several logs at once; a case without a header gets one."""
    lines = [(f"/x/sessions/--C-work-api--/{name}/f", i, json.dumps(r), True) for name, records in cases.items() for i, r in enumerate(records if any(r["type"] == "session" for r in records) else [head(), *records])]
    return session_logs.normalise_records(spark.createDataFrame(lines, session_logs.RAW))[0]


def case(path):
    return path.split("/")[-2]


fail = result("no", bad=True)
asked, decided = rec("approval/asked", id="a", callId="c1"), rec("approval/decided", id="a", outcome="Rejected")
denied = result("permission denied", bad=True)


def chunk(n, **k):
    return rec("assistant/chunk", chunk={"type": "usage", "usage": {"inputTokens": n}}, **k)


CASES = {
    "usage": [
        chunk(1, turn=1, step=1), answer({"inputTokens": 10}), chunk(100, turn=1, step=1), answer({"inputTokens": 20, "cacheWriteTokens": 5}),
        chunk(3, turn=2, step=1), chunk(4, turn=2, step=1), chunk(1000, turn=0, step=1), chunk(2000, step=1), answer({"inputTokens": -7, "outputTokens": True}, turn=9),
    ],
    "retries": [
        call("bash", command="x"), fail, call("bash", command="x", justification="again"), fail, call("bash", command="x", sandbox_permissions="all"),
        call("bash", call_id="c2", command="mkdir d"), result("Command completed", call_id="c2"), call("bash", command="x"), call("wait"), call("wait"),
    ],
    "rejected": [call("bash"), asked, decided, denied], "rejected_late": [call("bash"), asked, denied, decided], "rejected_early": [asked, decided, call("bash"), denied],
    "turns": [
        rec("turn/end", 5, turn=1), rec("turn/start", 10, turn=1), rec("turn/end", 30, turn=1, reason={"kind": "aborted"}), rec("turn/end", 90, turn=1),
        rec("turn/start", 100, turn=2), rec("turn/end", 50, turn=2, reason={"kind": "completed"}), rec("turn/start", 200, turn=3),
    ],
    "partial": [rec("turn/start", turn=1)],
    "messages": [
        says("one $my-skill", 0), says("no, wrong", 1000), {"type": "assistant/message", "data": {"message": {"content": []}}}, answer({}, 4000), answer({}, 9000),
        says("Accepted.", 10_000), says("<system-reminder>x", 11_000), answer({}, 10_500),
    ],
    "early": [rec("step/start", -500), head(createdAt=None, cwd=None, origin="subagent", parentSession="s0")],
    "command": [rec("command/run", name="Report-Insights")], "skill": [says("show $report-insights now")], "plain": [says("insights, please")],
    "nothing": [head()],
}


@pytest.fixture(scope="module")
def nine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    put(root, "s1", NINE)
    (root / "snapshots.jsonl").write_text("\n".join(map(json.dumps, [
        {"schema": "bridge-1", "operation": "report", "options": {}},
        {"kind": "session", "snapshot": {"session": {k: v for k, v in NINE[0].items() if k != "type"}, "events": NINE[1:]}},
        {"session": {}, "events": "no"},
    ])))
    files = session_logs.normalise_records(session_logs.read_session_logs(spark, str(root)))
    snapshots = session_logs.normalise_records(session_logs.read_snapshots(spark, str(root / "snapshots.jsonl")))
    return files, snapshots


@pytest.fixture(scope="module")
def stored(spark, nine, tmp_path_factory):
    """All cases, and the nine records from a file and from a snapshot, folded together and stored."""
    out = str(tmp_path_factory.mktemp("stored"))
    both = nine[0][0].withColumn("path", F.regexp_replace("path", "/s1/", "/from_file/")).unionByName(nine[1][0].withColumn("path", F.lit("/x/sessions/--k--/from_snapshot/f")))
    fold.fold_sessions(bronze(spark, CASES | {"nine": NINE}).unionByName(both), skill="report-insights", command="report-insights").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


@pytest.fixture(scope="module")
def sessions(stored):
    return {case(r["path"]): r for r in stored.collect()}


def test_files_and_snapshots_give_the_same_session(nine, sessions):
    for r in (sessions["from_file"], sessions["from_snapshot"], sessions["nine"]):
        assert (r.uncached_input_tokens, r.cached_input_tokens, r.input_tokens, r.output_tokens, r.total_tokens) == (120, 300, 420, 40, 460)
        assert (r.turns, r.user_messages, r.assistant_messages, r.tool_calls, r.tool_failures, r.active_ms, r.status) == (1, 2, 1, 1, 0, 3000, "completed")
        assert (r.provider, r.model, r.provider_title, r.role, r.platform, r.project) == ("p", "m", "A task", "root_task", "posix_other", "project-a")
        assert (r.verification_successes, r.verified_completed, r.session_type) == (1, "yes", "quick_check")
    assert [b.reason for b in nine[1][1].collect()] == ["unreadable"] and nine[0][1].count() == 0


def test_usage_of_a_step(sessions):
    r = sessions["usage"]
    assert (r.uncached_input_tokens, r.cache_write_tokens, r.output_tokens) == (20 + 4 + 2000, 5, 0)


def test_retries_and_state_changes(sessions):
    r = sessions["retries"]
    assert (r.unchanged_retries, r.state_change_retries, r.polling_retries, r.tool_failures) == (1, 2, 1, 2)
    assert r.failure_causes == {"other": 2} and r.failure_tools == {"bash": 2} and r.failure_confidence == {"high": 2}


def test_rejected_approvals_block_once(sessions):
    assert [sessions[k].permission_blocks for k in ("rejected", "rejected_late", "rejected_early")] == [1, 2, 1]
    assert sessions["rejected"].denied_approvals == 1


def test_turns(sessions):
    r = sessions["turns"]
    assert (r.turns, r.started, r.completed, r.aborted_turns, r.active_ms, r.status) == (3, 3, 3, 1, 20, "aborted")
    assert sessions["partial"].status == "partial"


def test_messages(sessions):
    r = sessions["messages"]
    assert (r.user_messages, r.assistant_messages, r.correction_messages, r.accepted_evidence) == (4, 4, 1, 1)
    assert r.assistant_latency_seconds == [3.0] and sorted(r.user_response_seconds) == [1.0, 2.0]
    assert r.skill_mentions == {"my-skill": 1} and r.first_prompt == "one $my-skill" and sorted(r.prompt_lengths) == [9, 9, 13, 17]


def test_headers(sessions):
    r = sessions["early"]
    assert (r.created_ms, r.family_id, r.role, r.cwd, r.platform) == (T - 500, "s0", "task_subagent", "C:/work/api", "unknown")
    r = sessions["nothing"]
    assert (r.tool_calls, r.turns, r.total_tokens, r.status, r.work_area, r.tool_counts, r.prompt_lengths) == (0, 0, 0, "completed", "general", {}, [])


def test_meta_sessions(sessions):
    assert [sessions[k].meta_analysis for k in ("command", "skill", "plain")] == [True, True, False]


OUTCOMES = [
    ("Exit code: 0\nExit code: 3", {}, {}, ("failure", 3, True, False, "other", "high")),
    ("Exit code: 1", {"command": "git diff --quiet"}, {}, ("failure", 1, False, False, None, "high")),
    ("SyntaxError: bad", {}, {}, ("success", None, False, True, "shell_syntax", "medium")),
    ("SyntaxError: bad", {"command": "cat x.py"}, {}, ("success", None, False, False, None, "none")),
    ("permission denied", {}, {"error": {"code": "X"}}, ("failure", None, True, False, "permission_boundary", "high")),
    ("[sandbox: file access denied under read-only mode] timed out", {}, {}, ("failure", None, True, False, "permission_boundary", "high")),
    ("Script failed", {}, {}, ("failure", None, True, False, "test_validation", "high")),
    ("operation timed out", {}, {"error": {"message": "boom"}}, ("failure", None, True, False, "timeout", "high")),
    ("3 passed\nnoise", {}, {}, ("success", None, False, False, None, "none")),
]


def test_outcomes(spark):
    cases = {f"o{i}": [call("bash", **args), result(text, **more)] for i, (text, args, more, _) in enumerate(OUTCOMES)}
    cases["unpaired"] = [call("bash", call_id=""), result("Exit code: 1", call_id=""), result("Wall time 2.5 seconds", call_id="zz"), call("bash", call_id="zz")]
    rows = fold.tool_steps(bronze(spark, cases)).filter("kind = 'result'").collect()
    got = {case(r["path"]): (r.outcome, r.exit_code, r.structured_failure, r.text_signal, r.cause, r.confidence) for r in rows}
    assert [got[f"o{i}"] for i in range(len(OUTCOMES))] == [want for *_, want in OUTCOMES]
    assert [(r.tool, r.seconds) for r in rows if case(r["path"]) == "unpaired"] == [("unknown", 0.0), ("unknown", 2.5)]
    assert [r.notable for r in rows if case(r["path"]) == "o8"] == [["3 passed"]]


def test_json_walk(spark):
    deep = json.dumps({"a": [{"exit_code": "2"}, 7, {"Status": {"b": None}}], "type": "x", "content": ["t1", {"text": "t2", "data": "no"}, {"type": "Image", "text": "no"}], "message": "q" * 600})
    rows = spark.createDataFrame([(deep,), ("{bad",), (None,)], "j string").select(tools.walk_json("j").alias("w")).collect()
    assert [(x.key, x.value, x.kind, x.whole) for x in rows[0].w.scalars[:4]] == [("exit_code", "2", "text", 2), (None, "7", "number", 7), ("b", "null", "null", None), ("type", "x", "text", None)]
    assert rows[0].w.text.startswith("t1\nt2\nqqq") and [r.w.scalars for r in rows[1:]] == [[], []]
    token = json.dumps({"text": "a1" * 300})
    assert spark.createDataFrame([(token,)], "j string").select(tools.walk_json("j").alias("w")).first().w.text == ""


def test_calls(spark):
    args = [{"b": 1, "a": {"y": 2, "x": 3}}, {"a": {"x": 3, "y": 2}, "b": 1, "justification": "z"}, {"b": 2, "a": {"x": 3, "y": 2}}]
    rows = spark.createDataFrame([(json.dumps(a),) for a in args] + [("ls a.py b.PY 'c.exe' d.md",), ("",)], "a string")
    got = rows.select(tools.call_fingerprint(F.lit("t"), F.col("a")).alias("f"), tools.file_extensions(F.col("a")).alias("e"), tools.approval_mode(F.col("a")).alias("m")).collect()
    assert got[0].f == got[1].f and len({r.f for r in got}) == 4 and got[3].e == ["py", "py", "md"] and {r.m for r in got} == {"default"}
    names = spark.createDataFrame([("mcp__Zotero__x",), ("web_search",), (None,), ("mcp__zotero__find",)], "n string").select(classify.family_tool(F.col("n")).alias("n")).collect()
    assert [r.n for r in names] == ["mcp__zotero", "web_search", "unknown", "mcp__zotero"]


def test_workspace_keys(spark):
    assert fold.workspace_key("/workspace/project-a") == "--workspace-project-a--" and fold.workspace_key("") == "_no-cwd"
    assert fold.workspace_key("C:\\a b/é~") == "--C-a~0020b-~00E9~007E--"
    rows = spark.createDataFrame([("/ws/p/x", "k"), ("/ws/pq", "k"), (None, "--ws-p-y--"), ("c:\\Ws\\P", "k"), (None, None), ("/else", "--ws-p--")], "cwd string, key string")
    got = rows.select(fold.in_project(F.col("cwd"), F.col("key"), "/ws/p").alias("x"), fold.in_project(F.col("cwd"), F.col("key"), "C:/ws/p").alias("y")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (True, False), (False, True), (False, False), (True, False)]


def test_report(spark, stored, tmp_path):
    """The report's tables over stored sessions, against plain Python on the same rows."""
    from datetime import datetime, timezone

    from sessionloom.sessions import report

    s = stored.filter("path NOT LIKE '%from_%'").withColumn("session_id", F.element_at(F.split("path", "/"), -2))
    rows = {r.session_id: r for r in s.collect()}
    lo, hi = report.time_range(datetime.fromtimestamp(T / 1000 + 86_400, timezone.utc), days=1)
    inside = report.scoped(s, lo, hi)
    assert {r.session_id: r.skip for r in inside.collect() if r.skip} == {"early": "outside_window"}
    assert report.scoped(s, lo, hi, "/workspace").filter("skip = 'other_project'").count() == 0
    assert report.scoped(s, lo, hi, "/workspaces").filter("skip = 'other_project'").count() == len(rows) - 1
    t = report.totals(s).first()
    for c in report.SUMMED + report.TOKENS:
        assert t[c] == sum(r[c] for r in rows.values()), c
    p = report.projects(s)
    assert [(r.project, r.sessions) for r in p.collect()] == [("project-a", len(rows) - 1), ("api", 1)]
    assert p.first().top_tools[0] == "bash"
    roles = report.dimension(s, "role").collect()
    assert [r.role for r in roles] == ["root_task", "task_subagent"] and roles[0].total_token_share == 1.0
    i = report.interaction(s)
    x = i.first()
    spans = [(r.start_ms, r.end_ms) for r in rows.values() if r.start_ms < r.end_ms]
    assert x.overlap_pairs == sum(max(a[0], b[0]) < min(a[1], b[1]) for k, a in enumerate(spans) for b in spans[:k])
    assert x.overlapping_sessions == sum(any(a is not b and max(a[0], b[0]) < min(a[1], b[1]) for b in spans) for a in spans)
    lengths = sorted(n for r in rows.values() for n in r.prompt_lengths)
    assert x.p90_prompt_chars == lengths[-(-9 * len(lengths) // 10) - 1]
    assert {r.signal: (r.total, r.affected) for r in report.friction(s).collect()}["tool_failures"] == (t.tool_failures, sum(r.tool_failures > 0 for r in rows.values()))
    named = report.titled(s)
    assert {r.session_id: r.title for r in named.collect() if r.session_id in ("nine", "nothing")} == {"nine": "A task", "nothing": "No usable title"}
    f = report.families(named)
    f.write.parquet(f"{tmp_path}/families")
    f = spark.read.parquet(f"{tmp_path}/families")
    fam = {r.family_id: r for r in f.collect()}
    assert fam["s0"].root_id is None and fam["s0"].log_completed == "unknown" and fam["messages"].accepted == "yes" and fam["messages"].first_response_seconds == 3.0 if "messages" in fam else True
    assert report.family_totals(f).first().roots == len(rows) - 1 if len(fam) == len(rows) else True
    c = report.coverage(inside, spark.createDataFrame([("p", 0, "x", "malformed")], "path string, seq long, type string, reason string"), f)
    assert (c.first().malformed_lines, c.first().skipped_outside_window, c.first().task_families_without_root) == (1, 1, 1)
    assert {r.rule for r in report.recommendation_rules(report.totals(s), i, c, p).collect()} >= {"failures", "permissions", "long_tasks", "reuse"}
    assert {r.warning for r in report.warning_rules(report.totals(s), c, files=3).collect()} == {"damaged_records", "unfinished_sessions"}
    assert report.narrative(s, p).first().main_project == "project-a"
    assert report.work_areas(named).count() >= 1 and {k: d.count() for k, d in report.usage_profile(s).items()}["hours"] == 24
    assert report.providers(s).first().provider == "p"
    shown = report.public_view(named).filter("title = 'A task'").first()
    assert shown.session_id.startswith("rollout-") and "cwd" not in shown and "first_prompt" not in shown and "nine" not in str(shown.asDict().values())
    assert report.titled(s, "metrics").select("title").distinct().count() == 1 and report.public_view(named, "local").filter("session_id = 'nine'").count() == 1
    assert report.privacy_modes("metrics", "local") == ("metrics", "metrics") and report.privacy_modes("local") == ("local", "local")


def test_excerpts_against_a_plain_fold(spark):
    import math
    import random

    from sessionloom.sessions import report

    rng = random.Random(4)
    sessions = [(f"s{i:03}", f"p{rng.randrange(4)}", float(rng.randrange(30)), i, rng.randrange(2), 0, 0) for i in range(60)]
    cands = [(s[0], k, ("prompt" if k == 0 else rng.choice(["correction", "follow_up"])), f"t{rng.randrange(90)}") for s in sessions for k in range(rng.randrange(5))]
    limit = 12

    def plain():
        by = {s[0]: s for s in sessions}
        of = {i: [c for c in cands if c[0] == i] for i in by}
        simple = sorted(by, key=lambda i: (-by[i][2], by[i][3]))
        rough = sorted(by, key=lambda i: (by[i][4] == 0, -by[i][2], -by[i][3]))
        out, seen, n, m, cap = [], set(), {}, {}, max(2, math.ceil(limit / 4))
        for order, kinds, most in ((simple, ("prompt",), 5), (rough, ("correction",), limit), (simple, ("prompt", "correction", "follow_up"), limit)):
            for c in (c for i in order for c in of[i] if c[2] in kinds):
                p = by[c[0]][1]
                if len(out) < most and c[3] not in seen and n.get(c[0], 0) < 2 and m.get(p, 0) < cap:
                    seen.add(c[3])
                    n[c[0]], m[p] = n.get(c[0], 0) + 1, m.get(p, 0) + 1
                    out.append((c[0], c[2], c[3]))
        return out

    s = spark.createDataFrame(sessions, "session_id string, project string, complexity_score double, created_ms long, tool_failures int, aborted_turns int, permission_blocks int")
    got = report.excerpts(s, spark.createDataFrame(cands, "session_id string, ordinal int, kind string, text string"), limit)
    assert [(r.session_id, r.kind, r.text) for r in got.orderBy("position").collect()] == plain()
    assert report.excerpts(s, spark.createDataFrame([], "session_id string, ordinal int, kind string, text string"), 0).count() == 0


def test_time_ranges():
    from datetime import datetime, timezone

    from sessionloom.sessions import report

    now = datetime(2026, 8, 21, 12, tzinfo=timezone.utc)
    assert (now - report.time_range(now)[0]).days == 30
    lo, hi = report.time_range(now, since="2026-08-01", until="2026-08-02")
    assert lo.isoformat() == "2026-08-01T00:00:00+00:00" and hi.isoformat().startswith("2026-08-02T23:59:59.999")
    assert report.moment("2026-08-01T00:00:00Z") == lo == report.moment("2026-08-01T02:00:00+02:00")
    for bad in ({"days": 0}, {"days": 3, "since": "2026-08-01"}, {"since": "2026-09-01"}):
        with pytest.raises(ValueError):
            report.time_range(now, **bad)


def test_report_contract(spark):
    from sessionloom.sessions import report

    kinds = {"STRING": "x", "BIGINT": 1, "OBJECT": {}, "ARRAY": []}
    good = {k: kinds[v] for k, v in report.REQUIRED.items()}
    good["totals"] = {"sessions": 0, "turns": 0, "tool_calls": 0, "tokens": {k: 0 for k in report.TOKEN_TOTALS}}
    good["scope"] = {"privacy_mode": "redacted_sample", "analysis_privacy_mode": "redacted", "analysis_depth": "evidence"}
    bad = {k: v for k, v in good.items() if k != "excerpts"} | {"totals": {"sessions": -1}, "projects": {}}
    rows = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),), ("no",)], "j string").select(report.contract_errors(F.col("j")).alias("e")).collect()
    assert rows[0].e == [] and {"excerpts", "projects", "totals.sessions", "totals.turns", "totals.tokens.total_tokens"} == set(rows[1].e) - {f"totals.tokens.{k}" for k in report.TOKEN_TOTALS} - {"totals.tool_calls"} | {"totals.tokens.total_tokens"}
    assert len(rows[2].e) > 15
