"""From session rows to the report's tables. All are small DataFrames; only bounded selections are folded in one task."""

from __future__ import annotations

import math
from datetime import date, datetime, time, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.operators import intervals, rollups
from sessionloom.sessions.fold import in_project

ROLES = ("root_task", "task_subagent", "action_reviewer", "unknown_system_rollout")
SUMMED = (
    "turns", "user_messages", "assistant_messages", "tool_calls", "tool_failures", "text_error_signals", "diagnostic_nonzero", "patches", "failed_patches",
    "subagents", "web_searches", "mcp_calls", "aborted_turns", "permission_blocks", "repeated_retries", "unchanged_retries", "state_change_retries",
    "polling_retries", "git_commits", "llm_retries", "denied_approvals",
)
TOKENS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens", "cache_write_tokens")
#: Name of a friction signal and the counter that it shows.
SIGNALS = (
    ("tool_failures", "tool_failures"), ("aborted_turns", "aborted_turns"), ("repeated_retries_after_failure", "unchanged_retries"),
    ("retries_after_state_change", "state_change_retries"), ("polling_retries", "polling_retries"), ("permission_blocks", "permission_blocks"),
    ("failed_patches", "failed_patches"), ("llm_retries", "llm_retries"), ("denied_approvals", "denied_approvals"),
)
LONG_MS, HOUR_MS = 30 * 60_000, 3_600_000
#: Ids that a family lists; the sessions themselves have their family's id.
MEMBERS = 10_000


def moment(value: str, end_of_day: bool = False) -> datetime:
    """A date or time parameter in UTC; a date alone is its first (or last) moment."""
    try:
        got = datetime.combine(date.fromisoformat(value.strip()), time.max if end_of_day else time.min)
    except ValueError:
        got = datetime.fromisoformat(value.strip())
    return (got if got.tzinfo else got.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)


def time_range(now: datetime, days: int | None = None, since: str | None = None, until: str | None = None) -> tuple[datetime, datetime]:
    """The range of a report: the last days (30 without any parameter), or from since to until, both included."""
    if days is not None and (since or days <= 0):
        raise ValueError("days is positive, and not given together with since")
    last = moment(until, end_of_day=True) if until else now
    first = moment(since) if since else last - timedelta(days=30 if days is None else days)
    if first > last:
        raise ValueError("since comes after until")
    return first, last


def scoped(sessions: DataFrame, since: datetime, until: datetime, project: str | None = None) -> DataFrame:
    """Sessions with `skip`: missing_metadata, outside_window, other_project, or null for those in scope.

    Scope is no part of the fold, so stored sessions serve every scope.
    """
    lo, hi = (m.timestamp() * 1000 for m in (since, until))
    here = in_project(F.col("given_cwd"), F.col("workspace_key"), project) if project else F.lit(True)
    reason = F.when(F.col("created_ms").isNull(), "missing_metadata").when((F.col("created_ms") < lo) | (F.col("created_ms") > hi), "outside_window").when(~here, "other_project")
    return sessions.withColumn("skip", reason)


def tokens() -> dict[str, Column]:
    """Token sums; what is not cached is taken from the sums."""
    sums = {t: F.coalesce(F.sum(t), F.lit(0)) for t in TOKENS}
    return sums | {"uncached_input_tokens": F.greatest(sums["input_tokens"] - sums["cached_input_tokens"], F.lit(0))}


def _hours(c: str) -> Column:
    return F.round(F.coalesce(F.sum(c), F.lit(0)) / HOUR_MS, 2)


def totals(sessions: DataFrame) -> DataFrame:
    """One row: sessions, active hours, every counter's sum, structured failures and tokens."""
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in SUMMED}
    every = {"sessions": F.count("*"), "active_hours": _hours("active_ms"), **sums, "structured_failures": sums["tool_failures"], **tokens()}
    return sessions.agg(*[v.alias(k) for k, v in every.items()])


def top_keys(sessions: DataFrame, by: list[str], counts: str, k: int) -> DataFrame:
    """by and `top`: the k keys with the largest counts of a map column, summed; ties by name."""
    n = sessions.select(*by, F.explode(counts).alias("key", "n")).groupBy(*by, "key").agg(F.sum("n").alias("n"))
    ranked = n.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "key"))).filter(F.col("__r") <= k)
    return ranked.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", "key"))), lambda x: x["key"]).alias("top"))


def projects(sessions: DataFrame) -> DataFrame:
    """Measures of each project and its five most used tools, most sessions first."""
    per = sessions.groupBy("project").agg(
        F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in ("turns", "tool_calls", "tool_failures", "total_tokens")], _hours("active_ms").alias("active_hours")
    )
    out = per.join(top_keys(sessions, ["project"], "tool_counts", 5).withColumnRenamed("top", "top_tools"), "project", "left")
    return out.orderBy(F.desc("sessions"), F.desc("tool_calls"), "project")


def dimension(sessions: DataFrame, dim: str) -> DataFrame:
    """Rollouts, families, tokens, share of all tokens, calls and failures of each value of a dimension (role, platform)."""
    per = sessions.groupBy(dim).agg(
        F.count("*").alias("rollouts"), F.countDistinct("family_id").alias("task_families"), *[v.alias(k) for k, v in tokens().items()],
        F.sum("tool_calls").alias("tool_calls"), F.sum("tool_failures").alias("structured_failures"),
    )
    whole = F.greatest(F.sum("total_tokens").over(Window.partitionBy(F.lit(1))), F.lit(1))  # one row per value
    out = per.withColumn("total_token_share", F.round(F.col("total_tokens") / whole, 4))
    order = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col(dim)) if dim == "role" else F.col(dim)
    return out.orderBy(order)


def titled(sessions: DataFrame, privacy: str = "redacted", omitted: str = "Content omitted", none: str = "No usable title") -> DataFrame:
    """Sessions with title and title_source: the provider's last, else the first other, else the first prompt; cut and cleaned."""
    if privacy == "metrics":
        return sessions.withColumns({"title": F.lit(omitted), "title_source": F.lit("omitted")})
    clean = text.redact_text if privacy == "redacted" else text.local_text
    source = F.when(F.col("provider_title").isNotNull(), "provider").when(F.col("fallback_title").isNotNull(), "fallback").otherwise("prompt")
    raw = F.nullif(F.coalesce("provider_title", "fallback_title", "first_prompt"), F.lit(""))
    return sessions.withColumns({"title": F.coalesce(clean(raw, 140), F.lit(none)), "title_source": source})


def privacy_modes(report: str = "redacted", analysis: str | None = None) -> tuple[str, str]:
    """(report, analysis) mode: local, redacted or metrics; without texts in the report there are none in the analysis either."""
    modes = ("local", "redacted", "metrics")
    if report not in modes or (analysis or report) not in modes:
        raise ValueError(f"a privacy mode is one of {modes}")
    return report, "metrics" if report == "metrics" else analysis or report


def public_view(rows: DataFrame, privacy: str = "redacted") -> DataFrame:
    """Titled sessions as a report shows them: ids by hash unless local, no folders, prompts or other titles; in metrics mode no text."""
    out = rows.drop("first_prompt", "provider_title", "fallback_title", "given_cwd", "workspace_key")
    if privacy == "local":
        return out
    ids = {"session_id": "rollout", "family_id": "task", "parent_id": "rollout", "path": "file"}
    hidden = {c: F.when(F.col(c) != "", text.stable_id(F.col(c), prefix)).otherwise("") for c, prefix in ids.items() if c in out.columns}
    return out.drop("cwd").withColumns(hidden)


def work_areas(rows: DataFrame, placeholders: tuple[str, ...] = ("Content omitted", "No usable title")) -> DataFrame:
    """Measures of each work area, and up to three different titles, of the most complex sessions first."""
    named = rows.filter(~F.col("title").isin(*placeholders)).groupBy("work_area", "title").agg(F.max("complexity_score").alias("c"))
    top = named.withColumn("r", F.row_number().over(Window.partitionBy("work_area").orderBy(F.desc("c"), "title"))).filter("r <= 3")
    top = top.groupBy("work_area").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]).alias("examples"))
    per = rows.groupBy("work_area").agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"), _hours("active_ms").alias("active_hours"), F.sum("tool_calls").alias("tool_calls"))
    return per.join(top, "work_area", "left").orderBy(F.desc("sessions"), F.desc("tool_calls"), "work_area")


def usage_profile(sessions: DataFrame) -> dict[str, DataFrame]:
    """Session types (all); the twelve commonest tools, file types and skills; sessions by hour and weekday (Monday is 0)."""

    def common(counts: str) -> DataFrame:
        n = sessions.select(F.explode(counts).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("count"))
        return n.orderBy(F.desc("count"), "name").limit(12)

    types = sessions.groupBy(F.col("session_type").alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name")
    return {
        "session_types": types, "top_tools": common("tool_counts"), "file_types": common("file_extensions"), "skill_mentions": common("skill_mentions"),
        "hours": rollups.histogram(sessions, F.hour("created"), 24, "hour"), "weekdays": rollups.histogram(sessions, F.weekday("created"), 7, "weekday"),
    }


def interaction(sessions: DataFrame, exact: bool = True) -> DataFrame:
    """One row of interaction metrics. exact=False takes sketches for medians and the 90th percentile of prompts."""
    middle = F.median if exact else lambda c: F.approx_percentile(c, 0.5)
    listed = lambda c: sessions.select(F.explode(c).alias("x"))
    rate = lambda a, b: F.round(F.coalesce(F.sum(a), F.lit(0)) / F.greatest(F.coalesce(F.sum(b), F.lit(0)), F.lit(1)), 2)
    s = sessions.agg(
        F.coalesce(F.round(F.avg("turns"), 2), F.lit(0.0)).alias("average_turns_per_session"), F.coalesce(middle("turns").cast("double"), F.lit(0.0)).alias("median_turns_per_session"),
        F.coalesce(F.sum("correction_messages"), F.lit(0)).alias("correction_like_messages"), rate("correction_messages", "user_messages").alias("correction_rate_per_user_message"),
        F.coalesce(F.sum("clarification_requests"), F.lit(0)).alias("clarification_requests"), rate("aborted_turns", "turns").alias("aborted_turn_rate"),
        rate("tool_calls", "turns").alias("tool_calls_per_turn"), F.count_if(F.col("subagents") > 0).alias("multi_agent_sessions"),
        F.count_if(F.col("active_ms") >= LONG_MS).alias("long_running_sessions"), F.count_if(F.col("session_type") == "quick_check").alias("quick_check_sessions"),
    )
    p90 = rollups.nearest_rank("x", 0.9) if exact else F.approx_percentile("x", 0.9)
    prompts = listed("prompt_lengths").agg(F.coalesce(F.floor(middle("x")), F.lit(0)).alias("median_prompt_chars"), F.coalesce(p90.cast("long"), F.lit(0)).alias("p90_prompt_chars"))
    waits = [listed(c).agg(F.coalesce(F.round(middle("x"), 2), F.lit(0.0)).alias(f"median_{c}")) for c in ("assistant_latency_seconds", "user_response_seconds")]
    spans = sessions.select("session_id", (F.col("start_ms") * 1000).cast("long").alias("s"), (F.col("end_ms") * 1000).cast("long").alias("e"))
    busy = intervals.concurrency(spans, "session_id", "s", "e").withColumnRenamed("max_concurrency", "max_concurrent")
    met = intervals.overlapping(spans, "session_id", "s", "e").agg(F.count("*").alias("overlapping_sessions"))
    out = s.withColumn("one", F.lit(1))
    for part in (prompts, *waits, busy, met):
        out = out.join(part.withColumn("one", F.lit(1)), "one")  # each is one row
    return out.drop("one")


def friction(sessions: DataFrame) -> DataFrame:
    """signal, total, affected, top_tools (of failures) of the nine signals; those that never occur are left out."""
    named = sessions.select(*[F.col(c).alias(n) for n, c in SIGNALS])
    tools = top_keys(sessions.withColumn("signal", F.lit("tool_failures")), ["signal"], "failure_tools", 5)
    return rollups.long_signals(named, [n for n, _ in SIGNALS]).join(tools.withColumnRenamed("top", "top_tools"), "signal", "left")


def families(rows: DataFrame) -> DataFrame:
    """One row per task family, of titled sessions: members, root, sums, causes, retries, completion, timing; latest first.

    rollouts counts all members; rollout_ids has the first MEMBERS of them, by creation.
    """
    order = F.struct("created_ms", "session_id")
    root = F.col("role") == "root_task"
    sums = ("user_messages", "correction_messages", "tool_calls", "text_error_signals", "diagnostic_nonzero", "unchanged_retries", "state_change_retries", "polling_retries")
    lead = F.coalesce(F.min_by(F.struct("session_id", "created", "project", "platform", "title", "work_area", "log_completed", "accepted"), F.when(root, order)),
                      F.min_by(F.struct("session_id", "created", "project", "platform", "title", "work_area", "log_completed", "accepted"), order))
    late = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("created_ms", "session_id", "assistant_latency_seconds"))), lambda x: x["assistant_latency_seconds"]))
    has_root = F.bool_or(root)
    per = rows.groupBy("family_id").agg(
        lead.alias("r"), has_root.alias("has_root"), F.count("*").alias("rollouts"), F.bool_or("meta_analysis").alias("meta_analysis"), *[F.sum(c).alias(c) for c in sums],
        F.sum("tool_failures").alias("structured_failures"), F.round(F.sum("complexity_score"), 2).alias("complexity_score"), *[v.alias(k) for k, v in tokens().items()],
        F.when(F.sum("verification_successes") > 0, "yes").when(F.sum("verification_failures") > 0, "no").otherwise("unknown").alias("verified_completed"),
        late.alias("l"), F.round((F.max("end_ms") - F.min("start_ms")) / 1000, 2).alias("observed_wall_seconds"), F.round(F.sum("active_ms") / 1000, 2).alias("active_seconds"),
        F.round(F.sum("tool_run_seconds"), 2).alias("tool_run_seconds"), F.round(F.sum("wait_seconds"), 2).alias("wait_seconds"),
        F.round(F.sum(F.when(F.col("role") == "action_reviewer", F.col("active_ms")).otherwise(0)) / 1000, 2).alias("action_reviewer_active_seconds_proxy"),
        F.when(F.bool_and(F.col("basis") == "structured"), "structured").otherwise("heuristic").alias("classification_basis"),
    )
    sorted_ = F.array_sort("l")
    at = lambda i: F.get(sorted_, i.cast("int"))
    n = F.size("l")
    half = F.when(n % 2 == 1, at(F.floor(n / 2))).otherwise((at(n / 2 - 1) + at(n / 2)) / 2)
    timing = {
        "first_response_seconds": F.coalesce(F.round(F.get("l", F.lit(0)), 2), F.lit(0.0)), "median_response_seconds": F.coalesce(F.round(half, 2), F.lit(0.0)),
        "p90_response_seconds": F.coalesce(F.round(at(F.greatest(F.ceil(0.9 * n) - 1, F.lit(0))), 2), F.lit(0.0)),
    }
    owned = F.col("has_root")
    per = per.withColumns(timing).select(
        "*", "r.project", "r.platform", "r.title", "r.work_area", F.to_date("r.created").alias("date"), F.when(owned, F.col("r.session_id")).alias("root_id"),
        F.when(owned, F.col("r.log_completed")).otherwise("unknown").alias("log_completed"), F.when(owned & (F.col("r.accepted") == "yes"), "yes").otherwise("unknown").alias("accepted"),
    ).drop("r", "l", "has_root")
    causes = rows.select("family_id", F.explode("failure_causes").alias("k", "v")).groupBy("family_id", "k").agg(F.sum("v").alias("v"))
    causes = causes.groupBy("family_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("failure_causes"))
    spent = F.create_map(*[x for k, v in sorted(tokens().items()) for x in (F.lit(k), v)])
    by_role = rows.groupBy("family_id", "role").agg(F.count("*").alias("n"), spent.alias("t"))
    listed = F.sort_array(F.collect_list(F.struct("role", "n")))
    spending = F.array_sort(F.collect_list(F.struct("role", F.map_entries("t").alias("t"))))
    by_role = by_role.groupBy("family_id").agg(
        F.map_from_entries(listed).alias("role_counts"), F.map_from_entries(F.transform(spending, lambda x: F.struct(x["role"], F.map_from_entries(x["t"])))).alias("role_token_totals")
    )
    members = rows.withColumn("__n", F.row_number().over(Window.partitionBy("family_id").orderBy("created_ms", "session_id"))).filter(F.col("__n") <= MEMBERS)
    members = members.groupBy("family_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "session_id"))), lambda x: x["session_id"]).alias("rollout_ids"))
    out = per.join(causes, "family_id", "left").join(by_role, "family_id").join(members, "family_id")
    return out.withColumn("failure_causes", F.coalesce("failure_causes", F.create_map().cast("map<string,bigint>"))).orderBy(F.desc("date"), F.desc("family_id"))


def eligible(families_: DataFrame) -> DataFrame:
    """Families that may be labelled: with a root, not about reports themselves, with two user messages or a tool call."""
    return families_.filter("NOT meta_analysis AND root_id IS NOT NULL AND (user_messages >= 2 OR tool_calls > 0)")


def family_totals(families_: DataFrame) -> DataFrame:
    yes = lambda c: F.count_if(F.col(c) == "yes")
    return families_.agg(
        F.count("*").alias("families"), F.coalesce(F.sum("rollouts"), F.lit(0)).alias("rollouts"), F.count("root_id").alias("roots"),
        yes("verified_completed").alias("verified"), yes("accepted").alias("accepted"),
    )


def providers(sessions: DataFrame) -> DataFrame:
    """provider, model (null: all of the provider) and the sessions that used it."""
    used = sessions.select("session_id", F.explode("provider_models").alias("m")).select("session_id", "m.provider", "m.model")
    return used.groupingSets([["provider"], ["provider", "model"]], "provider", "model").agg(F.countDistinct("session_id").alias("sessions")).orderBy("provider", F.col("model").asc_nulls_first())


def halves(sessions: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """Two rows: measures of the sessions of the first and of the second half of a range (half 1 and 2), a session in the middle counting to the second.

    A half without sessions has zeros. change: the second half's number less the first's, on the second row.
    """
    middle = (since.timestamp() + until.timestamp()) * 500
    sums = ("turns", "user_messages", "correction_messages", "tool_calls", "tool_failures", "unchanged_retries", "aborted_turns", "total_tokens", "active_ms")
    per = sessions.groupBy(F.when(F.col("created_ms") < middle, 1).otherwise(2).alias("half")).agg(F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in sums])
    both = sessions.sparkSession.range(1, 3).select(F.col("id").cast("int").alias("half")).join(per, "half", "left").fillna(0)
    names = ("sessions", *sums)
    changes = both.agg(*[F.sum(F.when(F.col("half") == 2, F.col(c)).otherwise(-F.col(c))).alias(c) for c in names]).select(F.lit(2).alias("half"), F.struct(*sorted(names)).alias("change"))
    return both.join(changes, "half", "left").orderBy("half")


def coverage(scoped_: DataFrame, bad: DataFrame, families_: DataFrame) -> DataFrame:
    """One row: what was read, left out and damaged, and how sure the roles are."""
    s = scoped_.agg(
        F.count_if(F.col("skip").isNull()).alias("sessions_analyzed"), F.count_if(F.col("skip") == "outside_window").alias("skipped_outside_window"),
        F.count_if(F.col("skip") == "other_project").alias("skipped_project"), F.count_if(F.col("skip") == "missing_metadata").alias("missing_metadata"),
        F.count_if(F.col("skip").isNull() & (F.col("status") == "partial")).alias("partial_sessions"),
        F.count_if(F.col("skip").isNull() & (F.col("basis") == "heuristic")).alias("heuristic_role_rollouts"),
        F.count_if(F.col("skip").isNull() & (F.col("role") == "unknown_system_rollout")).alias("unknown_system_rollouts"),
    )
    has = lambda r: F.col("reason") == r
    b = bad.agg(
        F.count_if(has("unreadable")).alias("unreadable_files"), F.count_if(has("malformed")).alias("malformed_lines"), F.count_if(has("unknown")).alias("unknown_records"),
        F.countDistinct(F.when(has("no_header"), F.col("path"))).alias("without_header"),
    )
    f = families_.agg(F.count_if(F.col("root_id").isNull()).alias("task_families_without_root"))
    one = lambda d: d.withColumn("one", F.lit(1))
    return one(s).join(one(b), "one").join(one(f), "one").drop("one").withColumn("missing_metadata", F.col("missing_metadata") + F.col("without_header")).drop("without_header")


def excerpts(sessions: DataFrame, candidates: DataFrame, limit: int = 80) -> DataFrame:
    """position, session_id, kind and text of the excerpts of candidates(session_id, ordinal, kind, text).

    First the prompts of the most complex sessions until five are taken, then corrections of sessions with friction
    first, then all by complexity. A session gives two at most, a project a quarter (two at least), a text comes once.
    Only candidates that those limits can reach are gathered: a bounded number for a project, and in all.
    """
    schema = f"position int, session_id {dict(sessions.dtypes)['session_id']}, kind string, text string"
    if limit <= 0:
        return sessions.sparkSession.createDataFrame([], schema)
    cap = max(2, math.ceil(limit / 4))
    reach = cap + limit + cap // 2 * (2 + limit)
    about = sessions.select("session_id", "project", "complexity_score", "created_ms", (F.col("tool_failures") + F.col("aborted_turns") + F.col("permission_blocks") > 0).alias("f"))
    rows = candidates.join(about, "session_id").withColumn("h", F.sha2("text", 256))
    complex_ = [F.desc("complexity_score"), F.asc("created_ms"), F.asc("session_id"), F.asc("ordinal")]
    rough = [F.desc("f"), F.desc("complexity_score"), F.desc("created_ms"), F.asc("session_id"), F.asc("ordinal")]
    out = None
    for turn, (kinds, order) in enumerate(((["prompt"], complex_), (["correction"], rough), (None, complex_))):
        near = rows.filter(F.col("kind").isin(*kinds)) if kinds else rows
        for by, most in ((["h", "project"], 1), (["session_id"], 2 + limit), (["h"], limit + 1), (["project"], reach)):
            near = near.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__k") <= most).drop("__k")
        near = near.orderBy(*order).limit(limit * reach)
        near = near.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))  # a bounded number of rows
        near = near.select("session_id", "project", "kind", "text", "h", "place", F.lit(turn).alias("turn"))
        out = near if out is None else out.unionByName(near)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, seen, by_session, by_project = [], set(), {}, {}
        for turn, part in pdf.sort_values(["turn", "place"]).groupby("turn"):
            most = min(5, limit) if turn == 0 else limit
            for x in part.itertuples():
                if len(taken) >= most:
                    break
                if x.h in seen or by_session.get(x.session_id, 0) >= 2 or by_project.get(x.project, 0) >= cap:
                    continue
                seen.add(x.h)
                by_session[x.session_id] = by_session.get(x.session_id, 0) + 1
                by_project[x.project] = by_project.get(x.project, 0) + 1
                taken.append((len(taken) + 1, x.session_id, x.kind, x.text))
        return pd.DataFrame(taken, columns=["position", "session_id", "kind", "text"])

    return out.groupBy().applyInPandas(fold, schema)


def excerpt_candidates(said: DataFrame, ids: DataFrame, privacy: str = "redacted", most: int = 800) -> DataFrame:
    """candidates(session_id, ordinal, kind, text) of user messages: prompts, corrections and follow-ups with words of their own."""
    clean = text.redact_text if privacy == "redacted" else text.local_text
    rows = said.filter("kind IN ('prompt', 'correction', 'follow_up')").select("path", "ordinal", "kind", clean(F.col("body"), most).alias("text"))
    rows = rows.filter(~F.col("text").isin("", "[context omitted]", "[code omitted]"))
    return rows.join(ids.select("path", "session_id"), "path").drop("path")


def recommendation_rules(t: DataFrame, i: DataFrame, c: DataFrame, p: DataFrame) -> DataFrame:
    """rule, priority and evidence (numbers) of the rules that fire, of the rows of totals, interaction, coverage and of projects.

    failures: tool failures or unchanged retries; permissions: blocks; corrections: 12 % of user messages or more; long_tasks:
    unfinished or long sessions; validation: 20 patches or more with few agents; reuse: a project of five sessions or more.
    """
    one = lambda d: d.withColumn("one", F.lit(1))
    best = p.orderBy(F.desc("sessions"), F.desc("tool_calls"), "project").limit(1).select(F.col("project").alias("p"), F.col("sessions").alias("p_sessions"), F.col("tool_calls").alias("p_calls"))
    row = one(t).join(one(i), "one").join(one(c.select("partial_sessions")), "one").join(one(best), "one", "left")
    unfinished = F.col("partial_sessions") + F.col("aborted_turns")
    few = F.col("multi_agent_sessions") <= F.greatest(F.lit(2), F.floor(F.col("sessions") / 20))
    rules = (
        (1, "failures", "high", (F.col("tool_failures") > 0) | (F.col("unchanged_retries") > 0), ("tool_failures", "unchanged_retries")),
        (2, "permissions", "high", F.col("permission_blocks") > 0, ("permission_blocks",)),
        (3, "corrections", "high", F.col("correction_rate_per_user_message") >= 0.12, ("correction_like_messages", "correction_rate_per_user_message")),
        (4, "long_tasks", "medium", (unfinished > 0) | (F.col("long_running_sessions") > 0), ("long_running_sessions", "partial_sessions", "aborted_turns")),
        (5, "validation", "medium", (F.col("patches") >= 20) & few, ("patches", "multi_agent_sessions")),
        (6, "reuse", "medium", F.coalesce(F.col("p_sessions") >= 5, F.lit(False)), ("p_sessions", "p_calls")),
    )
    told = [
        F.struct(F.lit(n).alias("position"), F.lit(rule).alias("rule"), F.lit(prio).alias("priority"), fires.alias("fires"),
                 F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(x).cast("double") for x in names])).alias("evidence"))
        for n, rule, prio, fires, names in rules
    ]
    out = row.select(F.explode(F.array(*told)).alias("r"), "p").filter("r.fires").select("r.position", "r.rule", "r.priority", "r.evidence", F.when(F.col("r.rule") == "reuse", F.col("p")).alias("project"))
    return out.withColumn("id", text.stable_id(F.col("rule"), "rec"))


def warning_rules(t: DataFrame, c: DataFrame, files: int, cache_errors: int = 0) -> DataFrame:
    """The warnings that hold: no input, few sessions, damaged records, unfinished sessions, unsure roles, a cache that cannot be written."""
    one = lambda d: d.withColumn("one", F.lit(1))
    row = one(t.select("sessions")).join(one(c), "one")
    damaged = F.col("malformed_lines") + F.col("unknown_records") + F.col("unreadable_files")
    rules = (
        ("no_input", F.lit(files == 0)), ("few_sessions", (F.col("sessions") > 0) & (F.col("sessions") < 5)), ("damaged_records", damaged > 0),
        ("unfinished_sessions", F.col("partial_sessions") > 0), ("unsure_roles", F.col("heuristic_role_rollouts") + F.col("unknown_system_rollouts") > 0),
        ("cache_not_written", F.lit(cache_errors > 0)),
    )
    return row.select(F.explode(F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules]))).alias("warning"))


def narrative(sessions: DataFrame, p: DataFrame) -> DataFrame:
    """One row of the facts that the narrative tells: the main project and its share, completed and complex completed sessions."""
    done = F.col("status") == "completed"
    s = sessions.agg(
        F.count("*").alias("sessions"), F.count_if(done).alias("completed"), F.count_if(done & (F.col("complexity_score") >= 40)).alias("completed_complex"),
        F.count_if(F.col("active_ms") >= LONG_MS).alias("long_running_sessions"), F.coalesce(F.sum("patches"), F.lit(0)).alias("patches"), F.coalesce(F.sum("git_commits"), F.lit(0)).alias("git_commits"),
    ).withColumn("completion_rate", F.round(F.col("completed") / F.greatest(F.col("sessions"), F.lit(1)), 4))
    best = p.orderBy(F.desc("sessions"), F.desc("tool_calls"), "project").limit(1).select(F.col("project").alias("main_project"), F.col("sessions").alias("main_sessions"), F.lit(1).alias("one"))
    out = s.withColumn("one", F.lit(1)).join(best, "one", "left").drop("one")
    return out.withColumn("main_share", F.round(F.col("main_sessions") / F.greatest(F.col("sessions"), F.lit(1)), 4))


#: What a report has to have, and of what kind it is.
REQUIRED = {
    "schema": "STRING", "schema_version": "BIGINT", "analyzer_version": "STRING", "product": "STRING", "runtime": "STRING", "generated_at": "STRING", "scope": "OBJECT",
    "coverage": "OBJECT", "totals": "OBJECT", "measurement_contract": "OBJECT", "projects": "ARRAY", "task_families": "ARRAY", "session_summaries": "ARRAY", "excerpts": "ARRAY", "warnings": "ARRAY",
}
TOTALS = ("sessions", "turns", "tool_calls")
TOKEN_TOTALS = ("uncached_input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")


def contract_errors(report: Column) -> Column:
    """What a report (JSON) lacks or has of the wrong kind; an empty array for a sound one."""
    v = F.try_parse_json(report)
    kind = lambda path: F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), r"^\w+", 0)
    tests = [(name, F.coalesce(kind(f"$.{name}") == want, F.lit(False))) for name, want in REQUIRED.items()]
    tests += [(f"totals.{n}", F.coalesce(F.try_variant_get(v, f"$.totals.{n}", "bigint") >= 0, F.lit(False))) for n in TOTALS]
    tests += [(f"totals.tokens.{n}", F.coalesce(F.try_variant_get(v, f"$.totals.tokens.{n}", "bigint") >= 0, F.lit(False))) for n in TOKEN_TOTALS]
    scope = {"privacy_mode": ("metrics_only", "redacted_sample", "local_content"), "analysis_privacy_mode": ("metrics", "redacted", "local"), "analysis_depth": ("conversation", "evidence")}
    tests += [(f"scope.{n}", F.coalesce(F.try_variant_get(v, f"$.scope.{n}", "string").isin(*some), F.lit(False))) for n, some in scope.items()]
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in tests]))
