"""From session records to one row per session: tool steps, messages, turns, tokens, models, titles.

Every order-sensitive rule is a window inside a session. Steps are dealt by session once; the windows by call, by
session and by fingerprint only sort anew.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import classify, text, tools
from sessionloom.operators import ordered, rollups
from sessionloom.sources.session_logs import call_id, json_number

TOKENS = {"inputTokens": "uncached_input_tokens", "outputTokens": "output_tokens", "reasoningTokens": "reasoning_output_tokens", "cacheReadTokens": "cached_input_tokens", "cacheWriteTokens": "cache_write_tokens"}
TOPIC_EACH, TOPIC_ALL = 5_000, 50_000
#: Fixed value: characters of a folder's key between its dashes.
KEY_CHARS = 251


def _field(path: str, column: str = "data") -> Column:
    return F.get_json_object(column, f"$.{path}")


def _said(path: str, column: str = "data") -> Column:
    """A text that is not empty, else null."""
    return F.nullif(_field(path, column), F.lit(""))


def _object(path: str) -> Column:
    x = _field(path)
    return F.when(x.startswith("{"), x)


def joined_texts(content: Column) -> Column:
    """The texts of a message's content items, one a line; items without one are passed over."""
    items = F.from_json(content, "array<struct<text: string>>")
    return F.array_join(F.filter(F.transform(items, lambda x: x["text"]), lambda x: x.isNotNull()), "\n")


def headers(records: DataFrame) -> DataFrame:
    """One row per session: ids, family, role, folder, platform, project, time of creation and the span of its records.

    Without a time of creation the first time before the header counts; where that is missing too, `created` is null.
    """
    at = F.max(F.when(F.col("type") == "session", F.col("seq"))).over(Window.partitionBy("path"))
    rows = records.withColumn("__h", at)
    early = F.when((F.col("seq") < F.col("__h")) & F.col("time").isNotNull(), F.struct("seq", "time"))
    per = rows.groupBy("path").agg(
        F.max(F.when(F.col("type") == "session", F.col("data"))).alias("data"), F.min(early)["time"].alias("early"),
        F.min(F.when(F.col("type") != "session", F.col("time"))).alias("lo"), F.max(F.when(F.col("type") != "session", F.col("time"))).alias("hi"),
    )
    v = F.try_parse_json("data")
    created = F.coalesce(json_number(v, "$.createdAt"), F.col("early"))
    folder = F.element_at(F.split("path", "/"), -2)
    key = F.try_element_at(F.split("path", "/"), F.lit(-3))
    own = F.coalesce(_said("id"), folder)
    parent = F.coalesce(_field("parentSession"), F.lit(""))
    agent = F.coalesce(_field("origin"), F.lit("")) == "subagent"
    cwd = F.coalesce(_said("cwd"), workspace_path(key), F.lit("unknown"))
    out = per.select(
        "path", own.alias("session_id"), F.when(agent & (parent != ""), parent).otherwise(own).alias("family_id"), parent.alias("parent_id"),
        key.alias("workspace_key"), _said("cwd").alias("given_cwd"), cwd.alias("cwd"), classify.role(_field("origin")).alias("r"),
        classify.platform(cwd).alias("platform"), text.project_label(cwd).alias("project"), created.alias("created_ms"),
        F.least(F.coalesce("lo", created), created).alias("start_ms"), F.greatest(F.coalesce("hi", created), created).alias("end_ms"),
    )
    stamp = lambda c: F.timestamp_millis(F.col(c).cast("long")).alias(c.replace("_ms", ""))
    return out.select("*", "r.role", "r.basis", stamp("created_ms")).drop("r")


def workspace_key(cwd: str) -> str:
    """The folder name that stands for a working folder: a dash for each run of separators, a code for what a plain file name lacks."""
    if not cwd:
        return "_no-cwd"
    coded = re.sub(r"[^A-Za-z0-9._-]", lambda m: f"~{ord(m[0]):04X}", re.sub(r"[/\\:]+", "-", cwd))
    return f"--{(coded.lstrip('-') or 'root')[:KEY_CHARS]}--"


def workspace_path(key: Column) -> Column:
    """The likely working folder of a key; dashes inside its names cannot be told from separators."""
    body = F.regexp_replace(F.regexp_replace(F.trim(key), "^--", ""), "--$", "")
    parts = F.filter(F.split(body, "-"), lambda x: x != "")
    first, rest = F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 2, 10_000), "/")
    whole = F.when(F.length(first) == 1, F.concat(first, F.lit(":/"), rest)).otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))
    return F.when((body != "") & (body != "_no-cwd") & (F.size(parts) > 0), whole)


def in_project(cwd: Column, key: Column, wanted: str) -> Column:
    """Whether a session lies in a folder or below it; drive paths ignore case; without a folder its key speaks for it."""
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+$", "")
    fold = lambda c: F.when(c.rlike("^[A-Za-z]:/"), F.lower(c)).otherwise(c)
    goal = wanted.replace("\\", "/").rstrip("/")
    goal = goal.lower() if goal[1:3] == ":/" and goal[:1].isalpha() else goal
    path = fold(plain(F.coalesce(cwd, workspace_path(key))))
    return F.coalesce((path == goal) | path.startswith(goal + "/"), F.lit(False)) | F.coalesce(F.lower(key) == workspace_key(wanted).lower(), F.lit(False))


def tool_steps(records: DataFrame) -> DataFrame:
    """Calls and results with all that is told about them, paired and classified, in order.

    kind: call or result. Of a call: tool, raw name, classes, fingerprint, mode, extensions, retry (none, polling,
    unchanged, after_state_change). Of a result: the call that it answers (tool `unknown` without one), outcome,
    exit_code, structured failure, text signal, diagnostic, cause, confidence, seconds, notable lines, permission block.
    """
    raw = F.coalesce(_said("name"), F.lit("unknown"))
    args = text.sound_json(F.coalesce(_field("arguments"), _field("input"), F.lit("")))
    name = classify.family_tool(raw)
    said = tools.arguments_text(args)
    low = F.lower(name)
    flags = {k: classify.command_flag(said, k) for k in ("content_dump", "diagnostic", "verification")}
    flags["state_change"] = low.isin("apply_patch", "request_user_input") | classify.command_flag(said, "state_change")
    calls = records.filter("type = 'tool/call'").select(
        "path", "seq", F.lit("call").alias("kind"), F.coalesce(_field("callId"), F.lit("")).alias("call_id"), name.alias("tool"),
        tools.call_fingerprint(name, args).alias("fingerprint"), tools.approval_mode(args).alias("mode"), tools.is_commit(args).alias("commit"),
        *[v.alias(k) for k, v in flags.items()], *[v.alias(k) for k, v in classify.tool_classes(name, raw).items()], tools.file_extensions(args).alias("extensions"),
    )
    steps = calls.unionByName(result_facts(records), allowMissingColumns=True).unionByName(rejections(records), allowMissingColumns=True)
    steps = steps.repartition("path")

    about = F.struct("tool", "fingerprint", "mode", "commit", "content_dump", "diagnostic", "verification", "state_change", "polls")
    before = Window.partitionBy("path", "call_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    named = F.col("call_id") != ""
    steps = steps.withColumns({
        "call": F.when(named, F.last(F.when(F.col("kind") == "call", about), ignorenulls=True).over(before)),
        "rejected": F.when(named, F.coalesce(F.max(F.col("kind") == "rejection").over(before), F.lit(False))).otherwise(F.lit(False)),
    }).filter("kind <> 'rejection'")
    is_call, answer = F.col("kind") == "call", F.col("kind") == "result"
    of = lambda c: F.coalesce(F.col(f"call.{c}"), F.lit(False))
    failed = answer & (F.col("outcome") == "failure")
    steps = steps.withColumns({"diagnostic_nonzero": failed & of("diagnostic"), "structured_failure": failed & ~of("diagnostic")})
    steps = steps.withColumn("text_signal", answer & (F.col("outcome") != "failure") & ~of("content_dump") & F.col("line_cause").isNotNull())
    guess = F.when(F.col("structured_failure") | F.col("text_signal"), F.coalesce("rule_cause", F.when(F.col("text_signal"), F.col("line_cause")), F.lit("other")))
    steps = steps.withColumn("cause", F.when(F.col("structured_failure") & F.col("denied"), "permission_boundary").otherwise(guess))
    good = answer & (F.col("outcome") == "success")
    steps = steps.withColumns({
        "confidence": F.when(F.col("structured_failure") | F.col("diagnostic_nonzero"), "high").when(F.col("text_signal"), "medium").when(answer, "none"),
        "permission_block": F.col("structured_failure") & (F.col("cause") == "permission_boundary") & ~(F.col("rejected") & F.col("call").isNotNull()),
        "verified": good & of("verification") & ~F.col("text_signal"), "refuted": answer & of("verification") & (F.col("structured_failure") | F.col("text_signal")),
        "committed": good & of("commit"), "waited": F.when(of("polls"), F.col("seconds")).otherwise(0.0),
        "tool": F.coalesce("tool", F.col("call.tool"), F.lit("unknown")), "print": F.coalesce("fingerprint", F.col("call.fingerprint")),
        "mode": F.coalesce("mode", F.col("call.mode"), F.lit("default")),
    })
    steps = ordered.classify_retries(
        steps, ["path"], "print", ["seq"], is_call, F.coalesce(F.col("polls"), F.lit(False)), F.col("structured_failure") & F.col("print").isNotNull(),
        good & of("state_change"), mode="mode", keep_all=True,
    )
    return steps.drop("print")


def result_facts(records: DataFrame) -> DataFrame:
    """What a result tells by itself: outcome, exit code, causes, seconds, notable lines."""
    whole = F.coalesce(_object("message"), F.col("data"))
    error = F.nullif(_object("error"), F.lit("{}"))
    rows = records.filter("type = 'tool/result'").select("path", "seq", call_id(F.col("data")).alias("call_id"), _field("error.code").alias("code"), whole.alias("whole"), error.alias("error"))
    rows = rows.withColumns({"own": tools.walk_json("whole"), "err": tools.walk_json("error")})
    is_error = F.exists("own.scalars", lambda x: F.lower(x["key"]).isin("is_error", "iserror") & (x["kind"] == "bool") & (x["value"] == "true"))
    speaks = F.exists("own.scalars", lambda x: F.lower(x["key"]).isin("is_error", "iserror"))
    denied = F.col("own.text").rlike(tools.DENIED) | F.col("own.text").rlike(tools.REJECTED)
    rows = rows.withColumns({"bad": F.coalesce(is_error, F.lit(False)), "speaks": F.coalesce(speaks, F.lit(False)), "denied_text": denied, "has_error": F.col("error").isNotNull()})
    sign = lambda key, c: F.when(c, F.from_json(F.lit(f'[{{"key": "{key}", "value": "true", "kind": "bool"}}]'), tools.SCALARS)).otherwise(F.array().cast(tools.SCALARS))
    fine = F.col("speaks") & ~F.col("bad") & ~F.col("has_error") & ~F.col("denied_text")
    rows = rows.withColumns({
        "scalars": F.concat("own.scalars", "err.scalars", sign("success", fine), sign("isError", F.col("bad") | F.col("has_error") | F.col("denied_text"))),
        "text": F.concat_ws("\n", F.nullif("own.text", F.lit("")), F.nullif("err.text", F.lit(""))),
    })
    rows = rows.withColumn("lines", tools.lines_of(F.col("text")))
    rows = rows.withColumn("told", tools.line_outcome(F.col("lines"), tools.structured_outcome(F.col("scalars"))))
    rule = F.nullif(tools.failure_cause(F.col("text"), F.lit(None).cast("string")), F.lit("other"))
    rows = rows.withColumns({"line_cause": tools.error_line_cause(F.col("lines")), "rule_cause": rule})
    return rows.select(
        "path", "seq", F.lit("result").alias("kind"), "call_id", "told.outcome", "told.exit_code", "line_cause", "rule_cause",
        (F.col("denied_text") | F.coalesce(F.col("code") == "FS_SANDBOX_DENIED", F.lit(False))).alias("denied"),
        tools.wall_seconds(F.col("lines"), F.col("scalars")).alias("seconds"), tools.notable_lines(F.col("lines"), F.coalesce("rule_cause", "line_cause")).alias("notable"),
    )


def decisions(records: DataFrame) -> DataFrame:
    """Approval decisions with the call that was asked for: the last request of that id before the decision."""
    rows = records.filter("type IN ('approval/asked', 'approval/decided')").select(
        "path", "seq", "type", F.coalesce(_field("id"), F.lit("")).alias("id"), F.lower(F.coalesce(_field("outcome"), F.lit(""))).alias("decision"), F.coalesce(_field("callId"), F.lit("")).alias("asked"),
    )
    rows = ordered.pair_latest(rows, ["path", "id"], ["seq"], (F.col("type") == "approval/asked") & (F.col("id") != ""), F.col("asked"), "call_id")
    return rows.filter("type = 'approval/decided'").select("path", "seq", F.coalesce("call_id", F.lit("")).alias("call_id"), F.col("decision").isin("rejected", "denied").alias("denied"))


def rejections(records: DataFrame) -> DataFrame:
    return decisions(records).filter("denied AND call_id <> ''").select("path", "seq", "call_id", F.lit("rejection").alias("kind"))


def messages(records: DataFrame) -> DataFrame:
    """User and assistant messages in order: body, ordinal of a user message, kind, latency and response in seconds."""
    own = F.when(_field("content").startswith("["), joined_texts(_field("content"))).otherwise(F.coalesce(_field("message"), F.lit("")))
    reply = joined_texts(F.coalesce(_field("message.content"), F.lit("[]")))
    is_user = F.col("type") == "user/message"
    rows = records.filter("type IN ('user/message', 'assistant/message')").select(
        "path", "seq", F.when(is_user, "user").otherwise("assistant").alias("role"), "time", text.message_body(F.when(is_user, own).otherwise(F.coalesce(reply, F.lit("")))).alias("body"),
    )
    rows = rows.repartition("path")
    user = F.col("role") == "user"
    so_far = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ordinal", F.when(user, F.count(F.when(user, 1)).over(so_far)))
    fix = (F.col("ordinal") > 1) & classify.is_correction(F.col("body"))
    kind = F.when(user, F.when(fix, "correction").when(F.col("ordinal") == 1, "prompt").when(F.col("ordinal") <= 4, "follow_up").otherwise("message"))
    rows = rows.withColumns({"kind": kind, "accepts": user & (F.col("ordinal") > 1) & classify.is_acceptance(F.regexp_replace("body", r"(?U)^\s+|\s+$", ""))})

    # untimed messages take no part in latencies: an answer follows the last timed question, and once
    timed, before = F.col("time").isNotNull(), so_far.rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(user & timed, F.col("time")), ignorenulls=True).over(before)
    rows = rows.withColumn("__run", F.count(F.when(user & timed, 1)).over(so_far))
    rows = rows.withColumn("__wait", F.when(~user & timed & (F.col("__run") > 0) & (F.col("time") >= asked), (F.col("time") - asked) / 1000))
    first = F.count(F.when(F.col("__wait").isNotNull(), 1)).over(Window.partitionBy("path", "__run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    replied = F.last(F.when(~user & timed, F.col("time")), ignorenulls=True).over(before)
    rows = rows.withColumns({"latency": F.when(first == 1, F.col("__wait")), "response": F.when(user & timed & (F.col("time") >= replied), (F.col("time") - replied) / 1000)})
    return rows.drop("__run", "__wait")


def turns(records: DataFrame) -> DataFrame:
    """Per session: turns, started, completed, aborted, active_ms. A start serves one end; an end without one takes no time."""
    rows = records.filter("type IN ('turn/start', 'turn/end')").select("path", "seq", "type", "time", _field("turn").alias("turn"), F.coalesce(_field("reason.kind"), F.lit("")).alias("why")).filter("turn IS NOT NULL")
    start, end = F.col("type") == "turn/start", F.col("type") == "turn/end"
    rows = rows.withColumn("__g", F.count(F.when(end, 1)).over(Window.partitionBy("path", "turn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    began = F.last(F.when(start, F.col("time")), ignorenulls=True).over(Window.partitionBy("path", "turn", "__g").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("ms", F.when(end, F.greatest(F.floor(F.col("time") - began), F.lit(0))))
    aborted = end & F.col("why").isin("aborted", "interrupted", "error")
    return rows.groupBy("path").agg(
        F.countDistinct(F.when(start, F.col("turn"))).alias("turns"), F.count_if(start).alias("started"), F.count_if(end & ~aborted).alias("completed"),
        F.count_if(aborted).alias("aborted_turns"), F.coalesce(F.sum("ms"), F.lit(0)).cast("long").alias("active_ms"),
    )


def usage(records: DataFrame) -> DataFrame:
    """Tokens per session: of each turn and step the last message's report, or the last chunk's where no message has one."""
    whole = F.coalesce(_object("usage"), _object("message.usage"))
    report = F.when(F.col("type") == "assistant/message", whole).when(_field("chunk.type") == "usage", _object("chunk.usage"))
    blank = lambda p: F.when(F.coalesce(_field(p), F.lit("")).isin("", "0", "0.0", "false"), F.lit("")).otherwise(_field(p))
    rows = records.filter("type IN ('assistant/message', 'assistant/chunk')").select(
        "path", "seq", (F.col("type") == "assistant/message").cast("int").alias("message"), blank("turn").alias("turn"), blank("step").alias("step"), report.alias("u"),
    ).filter("u IS NOT NULL")
    last = rows.groupBy("path", "turn", "step").agg(F.max_by("u", F.struct("message", "seq")).alias("u"))
    v = F.try_parse_json("u")
    counts = {put: F.coalesce(F.sum(F.when(json_number(v, f"$.{key}") >= 0, F.floor(json_number(v, f"$.{key}")))), F.lit(0)).cast("long").alias(put) for key, put in TOKENS.items()}
    out = last.groupBy("path").agg(*counts.values())
    return out.withColumns(rollups.token_projection(*[F.col(f"{c}_tokens") for c in ("uncached_input", "cached_input", "cache_write", "output")]))


def model_use(records: DataFrame) -> DataFrame:
    """(path, provider, model, n) of the three record types that name a model."""
    at = {"assistant/message": "message.source", "request/header": "header.config"}
    pick = lambda name: F.coalesce(*[F.when(F.col("type") == k, _said(f"{v}.{name}")) for k, v in at.items()], F.when(F.col("type") == "request/context", _said(name)))
    rows = records.filter("type IN ('assistant/message', 'request/header', 'request/context')").select("path", pick("provider").alias("provider"), pick("model").alias("model"))
    return rows.filter("provider IS NOT NULL AND model IS NOT NULL").groupBy("path", "provider", "model").agg(F.count("*").alias("n"))


#: Counters of a session: name, the value that is counted, and when.
COUNTERS = ("tool_counts", "failure_tools", "failure_causes", "failure_confidence", "verification_kinds", "file_extensions")


def step_counters(steps: DataFrame) -> DataFrame:
    """path, the counts and seconds of a session's steps, and a map of counts for each of COUNTERS: all counted together in one pass."""
    is_call, answer = F.col("kind") == "call", F.col("kind") == "result"
    counts = {
        "tool_calls": is_call, "tool_failures": F.col("structured_failure"), "text_error_signals": F.col("text_signal"), "diagnostic_nonzero": F.col("diagnostic_nonzero"),
        "clarification_requests": is_call & F.col("clarifies"), "subagents": F.col("starts_agent"), "web_searches": F.col("searches_web"), "mcp_calls": F.col("through_connector"),
        "unchanged_retries": F.col("retry") == "unchanged", "state_change_retries": F.col("retry") == "after_state_change", "polling_retries": F.col("retry") == "polling",
        "blocks": F.col("permission_block"), "verification_successes": F.col("verified"), "verification_failures": F.col("refuted"), "git_commits": F.col("committed"),
    }
    seconds = {"tool_run_seconds": "seconds", "wait_seconds": "waited"}
    has = F.col("cause").isNotNull()
    named = (
        ("tool_counts", is_call, "tool"), ("failure_tools", F.col("structured_failure"), "tool"), ("failure_causes", has, "cause"), ("failure_confidence", has, "confidence"),
        ("verification_kinds", F.col("verified"), "tool"),
    )
    one = lambda what, key, value=F.lit(0.0): F.struct(F.lit(what).alias("what"), key.alias("key"), value.alias("value"))
    each = [F.when(c, one("count", F.lit(n))) for n, c in counts.items()] + [F.when(answer, one("seconds", F.lit(n), F.col(c))) for n, c in seconds.items()]
    each += [F.when(c, one(what, F.col(key))) for what, c, key in named]
    files = F.transform(F.coalesce("extensions", F.array().cast("array<string>")), lambda e: one("file_extensions", e))
    n = steps.select("path", F.explode(F.concat(F.array_compact(F.array(*each)), files)).alias("x")).groupBy("path", "x.what", "x.key").agg(F.count("*").alias("n"), F.sum("x.value").alias("v"))
    pick = lambda what, key, c: F.max(F.when((F.col("what") == what) & (F.col("key") == key), F.col(c)))
    return n.groupBy("path").agg(
        *[F.coalesce(pick("count", c, "n"), F.lit(0)).alias(c) for c in counts], *[F.coalesce(pick("seconds", c, "v"), F.lit(0.0)).alias(c) for c in seconds],
        *[F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("what") == w, F.struct("key", "n"))))).alias(w) for w in COUNTERS],
    )


def _tally(values: Column) -> Column:
    """A map of how often each value of a short array stands in it."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda k: F.struct(k.alias("key"), F.size(F.filter(values, lambda x: x == k)).cast("long").alias("n"))))


def fold_sessions(records: DataFrame, skill: str = "", command: str = "", marks: tuple[str, ...] = (), said: DataFrame | None = None) -> DataFrame:
    """One row per session, of records(path, seq, type, time, data).

    said: `messages` of the records, where they are stored already. skill, command and marks: names by which a session is known to be about a report of this kind itself (without any, none is). Records without a time
    count, but move no span. Sessions without records of a kind have zeros and empty maps.
    """
    said = with_topics(messages(records) if said is None else said)
    user = F.col("role") == "user"
    length = F.length(F.regexp_replace("body", r"(?U)^\s+|\s+$", ""))
    talk = said.groupBy("path").agg(
        F.count_if(user).alias("user_messages"), F.count_if(~user).alias("assistant_messages"), F.count_if(F.col("kind") == "correction").alias("correction_messages"),
        F.count_if("accepts").alias("accepted_evidence"), F.min_by("body", F.when(user & (F.col("body") != ""), F.col("seq"))).alias("first_prompt"),
        F.collect_list(F.when(user, length)).alias("prompt_lengths"), F.sort_array(F.collect_list(F.when(F.col("latency").isNotNull(), F.struct("seq", "latency")))).alias("l"),
        F.collect_list("response").alias("user_response_seconds"), F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("seq", "topic")))).alias("t"),
        F.flatten(F.collect_list(F.when(user, classify.mentions(F.col("topic"))))).alias("named"),
    )
    talk = talk.withColumns({
        "assistant_latency_seconds": F.transform("l", lambda x: x["latency"]), "topics": F.array_join(F.transform("t", lambda x: x["topic"]), " "), "skill_mentions": _tally(F.col("named")),
    }).drop("l", "t", "named")
    denied = decisions(records).groupBy("path").agg(F.count_if("denied").alias("denied_approvals"))
    other = records.filter("type IN ('llm/retry', 'command/run', 'session/title')").withColumns({"t": _said("title"), "provided": F.coalesce(_field("source.kind") == "provider", F.lit(False))})
    title = F.col("t").isNotNull() & (F.col("type") == "session/title")
    other = other.groupBy("path").agg(
        F.count_if(F.col("type") == "llm/retry").alias("llm_retries"), F.bool_or((F.col("type") == "command/run") & (F.lower(_field("name")) == (command or None))).alias("command_seen"),
        F.max_by("t", F.when(title & F.col("provided"), F.col("seq"))).alias("provider_title"), F.min_by("t", F.when(title & ~F.col("provided"), F.col("seq"))).alias("fallback_title"),
    )
    models = model_use(records).groupBy("path").agg(
        F.max_by(F.struct("provider", "model"), F.struct("n", F.col("provider"), F.col("model"))).alias("m"), F.collect_set(F.struct("provider", "model")).alias("provider_models")
    ).select("path", "m.provider", "m.model", "provider_models")
    out = headers(records)
    for part in (turns(records), usage(records), talk, denied, other, models, step_counters(tool_steps(records))):
        out = out.join(part, "path", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast(t)) for c, t in out.dtypes if t in ("bigint", "double") and not c.endswith("_ms") or c == "active_ms"}
    empty = {c: F.coalesce(c, F.create_map().cast(t)) for c, t in out.dtypes if t.startswith("map")}
    lists = {c: F.coalesce(c, F.array().cast(t)) for c, t in out.dtypes if t.startswith("array")}
    out = out.withColumns({**zero, **empty, **lists})
    retries = F.map_filter(F.create_map(F.lit("llm_retry"), F.col("llm_retries")), lambda k, v: v > 0)
    minutes = F.col("active_ms") / 60_000
    out = out.withColumns({
        "permission_blocks": F.col("blocks") + F.col("denied_approvals"), "failure_causes": F.map_concat("failure_causes", retries),
        "repeated_retries": F.col("unchanged_retries") + F.col("state_change_retries") + F.col("polling_retries"),
        "work_area": classify.work_area(F.coalesce("topics", F.lit(""))), "patches": F.lit(0).cast("long"), "failed_patches": F.lit(0).cast("long"),
    })
    status = F.when(F.col("started") > F.col("completed") + F.col("aborted_turns"), "partial").when(F.col("aborted_turns") > 0, "aborted").otherwise("completed")
    return out.withColumns({
        "status": status,
        "complexity_score": F.round(classify.complexity(F.col("turns"), F.col("tool_calls"), F.col("patches"), F.col("subagents"), minutes), 1),
        "session_type": classify.session_type(F.col("turns"), F.col("tool_calls"), F.col("patches"), F.col("web_searches") + F.col("mcp_calls"), F.col("subagents"), minutes),
        "meta_analysis": classify.is_meta(F.col("command_seen"), F.map_keys("skill_mentions"), F.col("first_prompt"), skill, marks),
        "log_completed": F.when(status == "completed", "yes").otherwise("no"),
        "verified_completed": F.when(F.col("verification_successes") > 0, "yes").when(F.col("verification_failures") > 0, "no").otherwise("unknown"),
        "accepted": F.when(F.col("accepted_evidence") > 0, "yes").otherwise("unknown"),
    }).drop("blocks", "topics", "command_seen")


def with_topics(said: DataFrame) -> DataFrame:
    """Adds topic (a user's text, safe and capped) and fits (whether what stands before it is shorter than the cap of the whole)."""
    said = said.withColumn("topic", F.when(F.col("role") == "user", text.local_text(F.col("body"), TOPIC_EACH)))
    w = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("topic")).over(w) + F.count("topic").over(w) - 1, F.lit(0))
    return said.withColumn("fits", F.col("topic").isNotNull() & (used < TOPIC_ALL))
