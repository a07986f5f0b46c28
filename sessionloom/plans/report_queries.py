"""Queries that run the report's own functions: over sessions made of the driver's events, and over records and labels made of its tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from sessionloom.operators import ordered
from sessionloom.plans.log_queries import _conversation_lines, _json, _records
from sessionloom.plans.registry import EVENTS, events, query, table
from sessionloom.sessions import document, evidence, fold, report
from sessionloom.sources import session_logs
from sessionloom.sources.stored import stored

#: A session per user in DuckDB; the same columns as `_sessions` has.
S = f"""(SELECT *, CASE WHEN signups % 3 = 0 THEN 'partial' ELSE 'completed' END AS status, CASE WHEN views % 2 = 0 THEN 'quick_check' ELSE 'conversation' END AS kind,
    'p' || user_id % 7 AS project, (user_id % 10)::VARCHAR AS fam, user_id < 10 AS root, CASE user_id % 3 WHEN 0 THEN 'macos' WHEN 1 THEN 'windows' ELSE 'posix_other' END AS platform
    FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases,
        count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS signups, min(us) // 1000 AS s, max(us) // 1000 AS e, sum(cents)::BIGINT AS cents FROM {EVENTS} GROUP BY 1))"""


def _sessions(spark, d):
    """Rows as the fold gives them: a session per user, whose numbers are those of its events."""
    e = events(spark, d)
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    per = e.groupBy("user_id").agg(
        n("view").alias("views"), n("click").alias("clicks"), n("purchase").alias("purchases"), n("error").alias("errors"), n("signup").alias("signups"), F.expr("min(us) div 1000").alias("s"),
        F.expr("max(us) div 1000").alias("e"), F.sum("cents").alias("cents"), F.collect_list(F.when(F.col("event_type") == "view", F.col("k"))).alias("prompts"),
        F.collect_list(F.when(F.col("event_type") == "purchase", F.col("cents").cast("double"))).alias("waits"),
    )
    user, zero = F.col("user_id"), F.lit(0).cast("long")
    kinds = ("view", "click")
    counts = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array("views", "clicks")), lambda k, v: v > 0)
    causes = F.map_filter(F.create_map(F.lit("other"), F.col("errors")), lambda k, v: v > 0)
    given = {
        "turns": F.col("signups"), "user_messages": F.col("views"), "correction_messages": F.col("clicks"), "tool_calls": F.col("views") + F.col("clicks"), "tool_failures": F.col("errors"),
        "unchanged_retries": F.col("purchases"), "aborted_turns": F.col("signups") % 2, "permission_blocks": F.col("errors") % 3, "subagents": F.col("errors") % 2, "total_tokens": F.col("cents"), "input_tokens": F.col("cents"),
    }
    numbers = {c: given.get(c, zero) for c in (*report.SUMMED, *report.TOKENS, "correction_messages")}
    done = F.when(F.col("signups") % 3 == 0, "partial").otherwise("completed")
    return per.select(
        user.cast("string").alias("session_id"), F.concat(F.lit("f"), user.cast("string")).alias("path"), (user % 10).cast("string").alias("family_id"), F.lit("structured").alias("basis"),
        F.when(user < 10, "root_task").otherwise("task_subagent").alias("role"), F.concat(F.lit("p"), (user % 7).cast("string")).alias("project"), done.alias("status"),
        F.when(user % 3 == 0, "macos").when(user % 3 == 1, "windows").otherwise("posix_other").alias("platform"), F.when(F.col("views") % 2 == 0, "quick_check").otherwise("conversation").alias("session_type"),
        F.col("s").cast("double").alias("created_ms"), F.col("s").cast("double").alias("start_ms"), F.col("e").cast("double").alias("end_ms"), F.timestamp_millis("s").alias("created"),
        (F.col("cents") * 10).alias("active_ms"), F.concat(F.lit("T"), user.cast("string")).alias("title"), F.lit("general").alias("work_area"), F.lit(False).alias("meta_analysis"),
        (F.col("views") + F.col("clicks")).cast("double").alias("complexity_score"), (F.col("purchases") % 2).alias("verification_successes"), (F.col("errors") % 2).alias("verification_failures"),
        F.when(done == "completed", "yes").otherwise("no").alias("log_completed"), F.when(F.col("clicks") % 2 == 0, "yes").otherwise("unknown").alias("accepted"), F.col("views").cast("double").alias("tool_run_seconds"),
        F.lit(0.0).alias("wait_seconds"), zero.alias("clarification_requests"), F.array_compact("prompts").alias("prompt_lengths"), F.array_compact("waits").alias("assistant_latency_seconds"),
        F.array().cast("array<double>").alias("user_response_seconds"), counts.alias("tool_counts"), causes.alias("failure_causes"), counts.alias("failure_tools"),
        F.array(F.struct(F.lit("v").alias("provider"), F.concat(F.lit("m"), (user % 5).cast("string")).alias("model"))).alias("provider_models"), *[v.alias(k) for k, v in numbers.items()],
    )


@query(f"""SELECT signal, sum(n)::BIGINT AS total, count(*) FILTER (n > 0) AS affected FROM (
    SELECT 'tool_failures' AS signal, errors AS n FROM {S} UNION ALL SELECT 'aborted_turns', signups % 2 FROM {S} UNION ALL SELECT 'repeated_retries_after_failure', purchases FROM {S}
    UNION ALL SELECT 'permission_blocks', errors % 3 FROM {S}) GROUP BY 1 HAVING sum(n) > 0""")
def friction_signals(spark, d):
    return report.friction(_sessions(spark, d)).select("signal", "total", "affected")


@query(f"""WITH t AS (SELECT sum(errors) AS errors, sum(purchases) AS retries, sum(errors % 3) AS blocks, sum(clicks) AS fixes, sum(views) AS said, sum(signups % 2) AS aborted,
        count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (cents * 10 >= 1800000) AS long FROM {S}), p AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM {S} GROUP BY project))
    SELECT 'failures' AS rule, 'high' AS priority FROM t WHERE errors > 0 OR retries > 0 UNION ALL SELECT 'permissions', 'high' FROM t WHERE blocks > 0
    UNION ALL SELECT 'corrections', 'high' FROM t WHERE round(fixes / greatest(said, 1), 2) >= 0.12 UNION ALL SELECT 'long_tasks', 'medium' FROM t WHERE partial + aborted > 0 OR long > 0
    UNION ALL SELECT 'reuse', 'medium' FROM p WHERE n >= 5""")
def recommendations(spark, d):
    s = _sessions(spark, d)
    c = s.agg(F.count_if(F.col("status") == "partial").alias("partial_sessions"))
    return report.recommendation_rules(report.totals(s), report.interaction(s), c, report.projects(s)).select("rule", "priority")


BAD = f"(SELECT event_id, user_id, CASE k % 4 WHEN 0 THEN 'malformed' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unreadable' ELSE 'no_header' END AS reason FROM {EVENTS} WHERE event_type = 'signup')"
RANGE = (datetime(2024, 1, 2, tzinfo=timezone.utc), datetime(2024, 1, 3, tzinfo=timezone.utc))


def _covered(spark, d):
    """Coverage of the sessions of one day; signups stand for rejected lines."""
    k = F.col("k") % 4
    why = F.when(k == 0, "malformed").when(k == 1, "unknown").when(k == 2, "unreadable").otherwise("no_header")
    bad = events(spark, d).filter("event_type = 'signup'").select(F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("path"), F.col("event_id").alias("seq"), F.lit("x").alias("type"), why.alias("reason"))
    scope = report.scoped(_sessions(spark, d), *RANGE)
    return scope, report.coverage(scope, bad, report.families(scope.filter("skip IS NULL")))


COVERED = f"""SELECT *, (SELECT count(*) FROM {BAD} WHERE reason = 'malformed') AS malformed_lines, (SELECT count(*) FROM {BAD} WHERE reason = 'unknown') AS unknown_records,
        (SELECT count(*) FROM {BAD} WHERE reason = 'unreadable') AS unreadable_files, (SELECT count(*) FROM {BAD} WHERE reason = 'no_header') AS missing_metadata
    FROM (SELECT count(*) FILTER (inside) AS sessions_analyzed, count(*) FILTER (NOT inside) AS skipped_outside_window, count(*) FILTER (inside AND status = 'partial') AS partial_sessions,
        count(DISTINCT fam) FILTER (inside) - count(DISTINCT fam) FILTER (inside AND root) AS task_families_without_root FROM (SELECT *, s BETWEEN 1704153600000 AND 1704240000000 AS inside FROM {S}))"""


@query(COVERED)
def coverage(spark, d):
    return _covered(spark, d)[1].drop("skipped_project", "heuristic_role_rollouts", "unknown_system_rollouts")


@query(f"""WITH c AS ({COVERED}) SELECT 'few_sessions' AS warning FROM c WHERE sessions_analyzed BETWEEN 1 AND 4 UNION ALL SELECT 'damaged_records' FROM c WHERE malformed_lines + unknown_records + unreadable_files > 0
    UNION ALL SELECT 'unfinished_sessions' FROM c WHERE partial_sessions > 0""")
def warnings(spark, d):
    scope, c = _covered(spark, d)
    return report.warning_rules(report.totals(scope.filter("skip IS NULL")), c, files=1)


@query(f"""WITH p AS (SELECT project, count(*) AS n, sum(views + clicks) AS calls FROM {S} GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1)
    SELECT t.*, p.project AS main_project, p.n AS main_sessions FROM p, (SELECT count(*) AS sessions, count(*) FILTER (status = 'completed') AS completed,
        count(*) FILTER (status = 'completed' AND views + clicks >= 40) AS completed_complex, count(*) FILTER (cents * 10 >= 1800000) AS long_running_sessions FROM {S}) t""")
def narrative_facts(spark, d):
    s = _sessions(spark, d)
    return report.narrative(s, report.projects(s)).select("sessions", "completed", "completed_complex", "long_running_sessions", "main_project", "main_sessions")


@query(f"""SELECT fam AS family_id, count(*) AS rollouts, sum(views + clicks)::BIGINT AS tool_calls, sum(errors)::BIGINT AS structured_failures, sum(purchases)::BIGINT AS unchanged_retries, sum(cents)::BIGINT AS total_tokens,
    max(CASE WHEN root THEN user_id::VARCHAR END) AS root_id, count(*) FILTER (NOT root) AS agents, sum(CASE WHEN NOT root THEN cents ELSE 0 END)::BIGINT AS agent_tokens, list(user_id::VARCHAR ORDER BY s, user_id::VARCHAR)[1] AS first_id FROM {S} GROUP BY 1""")
def task_family_rollup(spark, d):
    f = report.families(_sessions(spark, d))
    agents = F.coalesce(F.try_element_at("role_counts", F.lit("task_subagent")), F.lit(0))
    spent = F.coalesce(F.try_element_at("role_token_totals", F.lit("task_subagent"))["total_tokens"], F.lit(0))
    return f.select("family_id", "rollouts", "tool_calls", "structured_failures", "unchanged_retries", "total_tokens", "root_id", agents.alias("agents"), spent.alias("agent_tokens"), F.get("rollout_ids", F.lit(0)).alias("first_id"))


@query(f"""SELECT fam AS family_id, CASE WHEN NOT bool_or(root) THEN 'unknown' WHEN max(CASE WHEN root THEN status END) = 'completed' THEN 'yes' ELSE 'no' END AS log_completed,
    CASE WHEN sum(purchases % 2) > 0 THEN 'yes' WHEN sum(errors % 2) > 0 THEN 'no' ELSE 'unknown' END AS verified_completed,
    CASE WHEN max(CASE WHEN root AND clicks % 2 = 0 THEN 1 ELSE 0 END) = 1 THEN 'yes' ELSE 'unknown' END AS accepted FROM {S} GROUP BY 1""")
def family_completion(spark, d):
    return report.families(_sessions(spark, d)).select("family_id", "log_completed", "verified_completed", "accepted")


@query(f"""WITH f AS (SELECT fam, count(*) AS n, bool_or(root) AS has_root, sum(purchases % 2) > 0 AS verified, bool_or(root AND clicks % 2 = 0) AS accepted FROM {S} GROUP BY 1)
    SELECT count(*) AS families, sum(n)::BIGINT AS rollouts, count(*) FILTER (has_root) AS roots, count(*) FILTER (verified) AS verified, count(*) FILTER (accepted) AS accepted FROM f""")
def family_totals(spark, d):
    return report.family_totals(report.families(_sessions(spark, d)))


@query(f"SELECT 'v' AS provider, NULL AS model, count(*) AS sessions FROM {S} UNION ALL SELECT 'v', 'm' || user_id % 5, count(*) FROM {S} GROUP BY 2")
def provider_model_sets(spark, d):
    return report.providers(_sessions(spark, d))


@query(f"SELECT project, count(*) AS sessions, sum(signups)::BIGINT AS turns, sum(views + clicks)::BIGINT AS tool_calls, sum(errors)::BIGINT AS tool_failures, sum(cents)::BIGINT AS total_tokens FROM {S} GROUP BY 1")
def project_rollup(spark, d):
    return report.projects(_sessions(spark, d)).select("project", "sessions", "turns", "tool_calls", "tool_failures", "total_tokens")


@query(f"SELECT platform, count(*) AS rollouts, count(DISTINCT fam) AS task_families, sum(cents)::BIGINT AS total_tokens, sum(views + clicks)::BIGINT AS tool_calls, sum(errors)::BIGINT AS structured_failures FROM {S} GROUP BY 1")
def dimension_rollup(spark, d):
    return report.dimension(_sessions(spark, d), "platform").select("platform", "rollouts", "task_families", "total_tokens", "tool_calls", "structured_failures")


@query(f"SELECT CASE WHEN root THEN 'root_task' ELSE 'task_subagent' END AS role, count(*) AS rollouts, round(sum(cents) / (SELECT sum(cents) FROM {S}), 4) AS total_token_share FROM {S} GROUP BY 1")
def role_share(spark, d):
    return report.dimension(_sessions(spark, d), "role").select("role", "rollouts", "total_token_share")


@query(f"""SELECT project, list(kind ORDER BY n DESC, kind)[1] AS first, list(kind ORDER BY n DESC, kind)[2] AS second FROM (
    SELECT project, unnest(['view', 'click']) AS kind, unnest([sum(views), sum(clicks)]) AS n FROM {S} GROUP BY 1) WHERE n > 0 GROUP BY 1""")
def topk_per_group(spark, d):
    found = report.top_keys(_sessions(spark, d), ["project"], "tool_counts", 2)
    return found.select("project", F.get("top", F.lit(0)).alias("first"), F.get("top", F.lit(1)).alias("second"))


@query(f"""WITH p AS (SELECT k AS n FROM {EVENTS} WHERE event_type = 'view')
    SELECT round(avg(signups), 2) AS average_turns_per_session, median(signups)::DOUBLE AS median_turns_per_session, (SELECT floor(median(n)) FROM p)::BIGINT AS median_prompt_chars,
        (SELECT quantile_disc(n, 0.9) FROM p)::BIGINT AS p90_prompt_chars, sum(clicks)::BIGINT AS correction_like_messages, round(sum(clicks) / greatest(sum(views), 1), 2) AS correction_rate_per_user_message,
        count(*) FILTER (errors % 2 > 0) AS multi_agent_sessions, count(*) FILTER (cents * 10 >= 1800000) AS long_running_sessions, count(*) FILTER (views % 2 = 0) AS quick_check_sessions FROM {S}""")
def interaction_metrics(spark, d):
    return report.interaction(_sessions(spark, d)).select(
        "average_turns_per_session", "median_turns_per_session", "median_prompt_chars", "p90_prompt_chars", "correction_like_messages", "correction_rate_per_user_message", "multi_agent_sessions", "long_running_sessions", "quick_check_sessions",
    )


@query(f"""WITH m AS (SELECT (1704067200000 + 1704326400000) // 2 AS mid), h AS (SELECT CASE WHEN s < mid THEN 1 ELSE 2 END AS half, * FROM {S}, m)
    SELECT r.half::INTEGER AS half, count(user_id) AS sessions, coalesce(sum(views + clicks), 0)::BIGINT AS tool_calls, coalesce(sum(errors), 0)::BIGINT AS tool_failures,
        CASE WHEN r.half = 2 THEN (SELECT coalesce(sum(CASE WHEN x.half = 2 THEN x.errors ELSE -x.errors END), 0) FROM h x)::BIGINT END AS change_of_failures
    FROM (VALUES (1), (2)) r(half) LEFT JOIN h ON h.half = r.half GROUP BY r.half""")
def half_range_compare(spark, d):
    at = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
    halves = report.halves(_sessions(spark, d), at(1704067200000), at(1704326400000))
    return halves.select("half", "sessions", "tool_calls", "tool_failures", F.col("change.tool_failures").alias("change_of_failures"))


def _event_records(spark, d, value, keep="true"):
    """Records of a log per user: a header, and value (JSON) for each event that is kept."""
    e = events(spark, d).withColumn("n", F.row_number().over(fold.Window.partitionBy("user_id").orderBy("us", "event_id"))).filter(keep)
    path = F.concat(F.lit("/logs/sessions/--k--/"), F.col("user_id").cast("string"), F.lit("/session"))
    heads = e.select("user_id").distinct().select(path.alias("path"), F.lit(0).cast("long").alias("seq"), _json(type=F.lit("session"), createdAt=F.lit(1)).alias("value"))
    return _records(heads.unionByName(e.select(path.alias("path"), F.col("n").cast("long").alias("seq"), value.alias("value"))))


@query(f"SELECT user_id, k, event_id, cents FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY (event_type = 'purchase')::INT DESC, us DESC, event_id DESC) AS n FROM {EVENTS}) WHERE n = 1")
def usage_dedup(spark, d):
    """The report that counts for each step: the last purchase, or the last event where none is one."""
    e = events(spark, d).withColumn("message", (F.col("event_type") == "purchase").cast("int"))
    return ordered.keep_first(e, ["user_id", "k"], [F.desc("message"), F.desc("us"), F.desc("event_id")]).select("user_id", "k", "event_id", "cents")


@query(f"SELECT user_id, sum(cents)::BIGINT AS input_tokens FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY (event_type = 'purchase')::INT DESC, us DESC, event_id DESC) AS n FROM {EVENTS}) WHERE n = 1 GROUP BY 1")
def usage_totals(spark, d):
    """Purchases report the usage of a message, other events that of a chunk; k is the step."""
    spent = F.struct(F.col("cents").alias("inputTokens"))
    message = _json(type=F.lit("assistant/message"), data=F.struct(F.lit("1").alias("turn"), F.col("k").alias("step"), spent.alias("usage")))
    chunk = _json(type=F.lit("assistant/chunk"), data=F.struct(F.lit("1").alias("turn"), F.col("k").alias("step"), F.struct(F.lit("usage").alias("type"), spent.alias("usage")).alias("chunk")))
    records = _event_records(spark, d, F.when(F.col("event_type") == "purchase", message).otherwise(chunk))
    return fold.usage(records).select(F.element_at(F.split("path", "/"), -2).cast("long").alias("user_id"), "input_tokens")


@query(f"""WITH a AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN 1 END IGNORE NULLS) OVER w AS asked, count(*) FILTER (event_type = 'view') OVER w AS calls FROM {EVENTS}
        WINDOW w AS (PARTITION BY user_id, k ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, count(*) FILTER (event_type = 'click' AND asked = 1) OVER (PARTITION BY user_id, k ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rejections FROM a)
    SELECT count(*) FILTER (event_type = 'error' AND NOT (rejections > 0 AND calls > 0)) AS blocks, count(*) FILTER (event_type = 'click') AS denied FROM b""")
def permission_blocks(spark, d):
    """Views are calls, signups ask for an approval of the call, clicks deny it, errors are results that tell of a lack of permission."""
    call, kind = F.concat(F.lit("c"), F.col("k").cast("string")), F.col("event_type")
    item = F.struct(call.alias("toolCallId"), F.lit(True).alias("isError"), F.array(F.struct(F.lit("text").alias("type"), F.lit("permission denied").alias("text"))).alias("content"))
    value = (
        F.when(kind == "view", _json(type=F.lit("tool/call"), data=F.struct(call.alias("callId"), F.lit("bash").alias("name"))))
        .when(kind == "signup", _json(type=F.lit("approval/asked"), data=F.struct(call.alias("id"), call.alias("callId"))))
        .when(kind == "click", _json(type=F.lit("approval/decided"), data=F.struct(call.alias("id"), F.lit("rejected").alias("outcome"))))
        .otherwise(_json(type=F.lit("tool/result"), data=F.struct(F.struct(F.array(item).alias("content")).alias("message"))))
    )
    records = _event_records(spark, d, value, "event_type <> 'purchase'")
    blocks = fold.tool_steps(records).agg(F.count_if("permission_block").alias("blocks")).withColumn("one", F.lit(1))
    denied = fold.decisions(records).agg(F.count_if("denied").alias("denied")).withColumn("one", F.lit(1))
    return blocks.join(denied, "one").drop("one")


@query(r"SELECT conv_id, turn, sha256(text) AS body FROM conversations WHERE role IN ('user', 'assistant')")
def message_text(spark, d):
    said = fold.messages(_records(_conversation_lines(spark, d)))
    return said.select(F.element_at(F.split("path", "/"), -2).cast("long").alias("conv_id"), F.col("seq").alias("turn"), F.sha2("body", 256).alias("body"))


@query("""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Given ' || max(turn) WHEN conv_id % 3 = 1 THEN 'Other ' || min(turn) ELSE 'Prompt ' || min(turn) END AS title,
    CASE conv_id % 3 WHEN 0 THEN 'provider' WHEN 1 THEN 'fallback' ELSE 'prompt' END AS title_source FROM conversations GROUP BY conv_id""")
def title_precedence(spark, d):
    """Every turn sets a title: some conversations have a provider's, some only others, some none but their prompts."""
    c = table(spark, d, "conversations")
    first = c.groupBy("conv_id").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"))
    name = lambda kind, turn: F.concat(F.lit(kind + " "), F.col(turn).cast("string"))
    rows = first.select(
        "conv_id", F.when(F.col("conv_id") % 3 == 0, name("Given", "hi")).alias("provider_title"), F.when(F.col("conv_id") % 3 < 2, name("Other", "lo")).alias("fallback_title"), name("Prompt", "lo").alias("first_prompt"),
    )
    return report.titled(rows).select("conv_id", "title", "title_source")


@query("SELECT doc_id, format('batch-{:03d}', ceil(row_number() OVER (PARTITION BY source ORDER BY doc_id) / 6.0)::INT) AS batch FROM documents")
def batching(spark, d):
    """Batches of the documents of each source."""
    place = F.row_number().over(fold.Window.partitionBy("source").orderBy("doc_id"))
    ranked = table(spark, d, "documents").select("doc_id", place.alias("position"))
    return evidence.batches(ranked).select("doc_id", F.col("batch_id").alias("batch"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'wrong_family' WHEN doc_id % 6 = 2 THEN 'bad_enum:task_type' WHEN doc_id % 6 = 3 THEN 'empty:goal,forbidden:accepted'
    WHEN doc_id % 6 = 4 THEN 'unknown_evidence' ELSE 'missing:strengths,not_texts:strengths' END AS errors FROM labels""")
def facet_validation(spark, d):
    """Labels as facets of their documents, five in six of them with something wrong."""
    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    none = F.lit(None).cast("string")
    facet = F.to_json(F.struct(
        F.when(m == 1, "other").otherwise(i).alias("task_family_id"), F.when(m == 3, " ").otherwise("g").alias("goal"), F.when(m == 2, "magic").otherwise("review").alias("task_type"), F.lit("i").alias("interaction_style"),
        F.lit("followed").alias("instruction_handling"), F.lit("strong").alias("tool_execution"), F.lit("partial").alias("verification_quality"), F.lit("clear").alias("handoff_quality"), F.lit("unclear").alias("outcome_inference"),
        F.array().cast("array<string>").alias("frictions"), F.when(m != 5, F.array(F.lit("s"))).alias("strengths"), F.array(F.when(m == 4, "zz").otherwise("e1")).alias("evidence_refs"), F.when(m == 3, "yes").otherwise(none).alias("accepted"),
    ))
    return table(spark, d, "labels").select("doc_id", F.array_join(evidence.facet_errors(facet, i, F.array(F.lit("e1"))), ",").alias("errors"))


@query("""SELECT left('semantic-' || left(sha256('agent' || chr(0) || source), 12), 21) AS id, count(*) AS n, CASE WHEN source < 'src5' THEN 'medium' ELSE 'high' END AS priority FROM documents GROUP BY source""")
def supported_recs(spark, d):
    """A recommendation per source, supported by its documents; some are single observations."""
    items = table(spark, d, "documents").groupBy("source").agg(F.collect_set(F.col("doc_id").cast("string")).alias("families")).select(
        F.lit("recommendations").alias("section"), F.lit(0).alias("position"), F.col("source").alias("key"), F.lit("t").alias("title"), F.lit("x").alias("text"), F.lit("a").alias("action"), F.lit("c").alias("copy_prompt"),
        F.lit("high").alias("confidence"), F.lit("inferred").alias("measurement"), "families", F.array().cast("array<string>").alias("refs"), (F.col("source") < "src5").alias("singleton"),
    )
    return evidence.semantic_recommendations(items, "agent").select("id", F.col("support").cast("long").alias("n"), "priority")


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1)
    SELECT count(*)::BIGINT AS sessions, sum(u)::BIGINT AS user_messages, sum(a)::BIGINT AS assistant_messages, (SELECT count(*) FROM (SELECT DISTINCT conv_id % 5 FROM conversations))::BIGINT AS projects,
        list_sort(list(DISTINCT CASE conv_id % 3 WHEN 0 THEN 'macos' WHEN 1 THEN 'windows' ELSE 'posix_other' END))[1] AS first_platform, 0::BIGINT AS tool_calls, 0::BIGINT AS errors FROM c""")
def report_document(spark, d):
    """From log lines to the assembled, checked document, and its numbers read back from it."""
    lines = _conversation_lines(spark, d).withColumn("readable", F.lit(True))
    records, bad = (stored(x, name) for x, name in zip(session_logs.normalise_records(lines), ("records", "bad")))
    settings = document.Settings(datetime(1970, 1, 1, tzinfo=timezone.utc), datetime(2030, 1, 1, tzinfo=timezone.utc))
    said = stored(fold.messages(records), "messages")
    sessions = stored(fold.fold_sessions(records, said=said), "sessions")
    tables = document.tables(sessions, bad, said, settings)
    told = document.document(document.sections(tables, settings))
    at = lambda p: F.get_json_object("report", p)
    return told.select(
        *[at(f"$.totals.{c}").cast("long").alias(c) for c in ("sessions", "user_messages", "assistant_messages", "tool_calls")], F.size(F.from_json(at("$.projects"), "array<string>")).cast("long").alias("projects"),
        at("$.platform_metrics[0].platform").alias("first_platform"), F.size("errors").cast("long").alias("errors"),
    )
