"""A report as one document: named sections, each a JSON text, put together, checked and published in versions.

Sections are rows (name, json), so that a later step can replace some of them. Keys are sorted at every level. What a report
lists without a bound of its own (sessions, families, projects) is listed up to `most` rows; the tables that `tables` gives
are whole, and `publish` writes them beside the document.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.sessions import report
from sessionloom.sources.stored import stored

PRIVACY = {"metrics": "metrics_only", "redacted": "redacted_sample", "local": "local_content"}
RULES_VERSION = 1
#: What kinds of number the timing fields hold.
MEASURED = ("observed_wall_seconds", "first_response_seconds", "median_response_seconds", "p90_response_seconds")
CONTRACT = {
    "tokens": "one usage report per turn and step; input is uncached plus cached input, output includes reasoning, total adds cache writes; no billing",
    "timing": "wall time where records have times; active, tool, wait and reviewer times are proxies", "causality": "savings and recommendations are labelled measured, proxy or inferred",
    "patches": "not_applicable",
}


@dataclass(frozen=True)
class Settings:
    """What a report is about: its range, project, privacy of the report and of what is labelled, and the names that it carries."""

    since: datetime
    until: datetime
    generated_at: datetime | None = None
    project: str | None = None
    privacy: str = "redacted"
    analysis_privacy: str | None = None
    depth: str = "evidence"
    locale: str = "en"
    max_excerpts: int = 80
    most: int = 10_000
    product: str = "sessionloom"
    runtime: str = "agent"
    schema: str = "session-report/1"
    version: str = "1"

    def modes(self) -> tuple[str, str]:
        return report.privacy_modes(self.privacy, self.analysis_privacy)


def stamp(at: datetime) -> str:
    return at.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")


def obj(fields: dict) -> Column:
    """A struct of columns (dicts are structs in turn) with sorted names."""
    return F.struct(*[(obj(v) if isinstance(v, dict) else v).alias(k) for k, v in sorted(fields.items())])


def as_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def fixed(spark: SparkSession, fields: dict[str, Column]) -> DataFrame:
    """Sections that are known without data; every value is JSON."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("json")) for k, v in fields.items()])
    return spark.range(1).select(F.inline(rows))


def single(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The section of a one-row table."""
    return rows.select(F.lit(name).alias("name"), as_json(value).alias("json"))


def listed(rows: DataFrame, name: str, value: Column, order: list[Column], most: int) -> DataFrame:
    """The section of the first rows of a table, as an array in that order; an empty table gives an empty array."""
    first = rows.orderBy(*order).limit(most)
    numbered = first.withColumn("__n", F.row_number().over(Window.orderBy(*order)))  # a bounded number of rows
    items = numbered.select("__n", as_json(value).alias("j")).agg(F.sort_array(F.collect_list(F.struct("__n", "j"))).alias("x"))
    return items.select(F.lit(name).alias("name"), F.concat(F.lit("["), F.array_join(F.transform("x", lambda i: i["j"]), ","), F.lit("]")).alias("json"))


def top(counts: Column, k: int = 5) -> Column:
    """The k names with the largest counts of a map; ties by name."""
    pairs = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    return F.slice(F.transform(pairs, lambda x: x["k"]), 1, k)


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    mid = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.coalesce(mid, F.lit(0.0))


def _date(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _token_fields() -> dict[str, Column]:
    return {t: F.col(t) for t in (*report.TOKENS, "uncached_input_tokens")}


def _kinds(names) -> dict[str, Column]:
    return {n: F.lit("measured" if n in MEASURED else "proxy") for n in names}


def session_view() -> dict:
    """The fields of a session as a report shows it, of rows of `report.titled` under `report.public_view`."""
    wall = F.greatest((F.col("end_ms") - F.col("start_ms")) / 1000, F.lit(0.0))
    timing = {
        "observed_wall_seconds": F.round(wall, 3), "active_seconds": F.col("active_ms") / 1000, "tool_run_seconds": F.round("tool_run_seconds", 2), "wait_seconds": F.round("wait_seconds", 2),
    }
    same = (
        "role", "platform", "project", "status", "title", "title_source", "work_area", "session_type", "meta_analysis", "complexity_score", "provider", "model", "turns", "user_messages",
        "assistant_messages", "correction_messages", "clarification_requests", "tool_calls", "tool_failures", "text_error_signals", "diagnostic_nonzero", "patches", "failed_patches",
        "subagents", "web_searches", "mcp_calls", "aborted_turns", "permission_blocks", "repeated_retries", "unchanged_retries", "state_change_retries", "polling_retries", "git_commits",
        "llm_retries", "denied_approvals",
    )
    return {c: F.col(c) for c in same} | {
        "rollout_id": F.col("session_id"), "task_family_id": F.col("family_id"), "rollout_file": F.col("path"), "classification_basis": F.col("basis"), "session_header_records": F.lit(1),
        "date": _date("created"), "start_hour_local": F.hour("created"), "weekday": F.weekday("created"), "observed_minutes": F.round(wall / 60, 1), "active_minutes": F.round(F.col("active_ms") / 60_000, 1),
        "median_prompt_chars": F.floor(_median(F.col("prompt_lengths"))), "failure_causes": sorted_map(F.col("failure_causes")), "failure_rule_version": F.lit(RULES_VERSION),
        "completion": {c: F.col(c) for c in ("log_completed", "verified_completed", "accepted")},
        "verification": {"successes": F.col("verification_successes"), "failures": F.col("verification_failures"), "kinds": sorted_map(F.col("verification_kinds"))},
        "timing": timing | {"measurement": _kinds(timing)}, "median_assistant_latency_seconds": F.round(_median(F.col("assistant_latency_seconds")), 2),
        "median_user_response_seconds": F.round(_median(F.col("user_response_seconds")), 2), "tokens": {t: F.col(t) for t in report.TOKENS},
        "top_tools": top(F.col("tool_counts")), "file_extensions": top(F.col("file_extensions")), "skill_mentions": top(F.col("skill_mentions")),
    }


def family_view() -> dict:
    """The fields of a task family, of rows of `report.families` with public ids."""
    same = (
        "project", "platform", "title", "work_area", "meta_analysis", "user_messages", "correction_messages", "complexity_score", "tool_calls", "structured_failures",
        "text_error_signals", "diagnostic_nonzero", "classification_basis", "rollout_ids", "role_counts",
    )
    timing = {c: F.col(c) for c in (
        "first_response_seconds", "median_response_seconds", "p90_response_seconds", "observed_wall_seconds", "active_seconds", "tool_run_seconds", "wait_seconds", "action_reviewer_active_seconds_proxy",
    )}
    return {c: F.col(c) for c in same} | {
        "task_family_id": F.col("family_id"), "root_rollout_id": F.col("root_id"), "date": _date("date"), "rollout_count": F.col("rollouts"), "tokens": _token_fields(),
        "role_token_totals": F.col("role_token_totals"), "failure_causes": F.col("failure_causes"),
        "retry_classification": {"unchanged": F.col("unchanged_retries"), "after_state_change": F.col("state_change_retries"), "polling": F.col("polling_retries")},
        "completion": {c: F.col(c) for c in ("log_completed", "verified_completed", "accepted")}, "timing": timing | {"measurement": _kinds(timing)},
    }


def tables(sessions: DataFrame, bad: DataFrame, said: DataFrame, settings: Settings, store: Callable[[DataFrame, str], DataFrame] = stored) -> dict[str, DataFrame]:
    """The tables of a report over stored sessions (of the fold), rejected rows (of the source) and messages.

    What several tables start from is written once (store). Whole tables: scoped, sessions (titled, in scope), public (as shown), families; one row each: totals, interaction, coverage, narrative,
    family_totals; the others are grouped or limited.
    """
    scope = report.scoped(sessions, settings.since, settings.until, settings.project)
    inside = store(report.titled(scope.filter("skip IS NULL"), settings.modes()[0]), "report-sessions")
    public = report.public_view(inside, settings.modes()[0])
    families = store(report.families(inside), "report-families")
    shown = families if settings.modes()[0] == "local" else families.withColumns({
        "family_id": text.stable_id(F.col("family_id"), "task"), "root_id": F.when(F.col("root_id").isNotNull(), text.stable_id(F.col("root_id"), "rollout")),
        "rollout_ids": F.transform("rollout_ids", lambda x: text.stable_id(x, "rollout")),
    })
    t, i, p = store(report.totals(inside), "report-totals"), store(report.interaction(inside), "report-interaction"), store(report.projects(inside), "report-projects")
    c = store(report.coverage(scope, bad, families), "report-coverage")
    paths = scope.select("path").unionByName(bad.filter("reason IN ('unreadable', 'no_header')").select("path").distinct())
    files = paths.agg(F.count("*").alias("files_scanned"))
    unknown = bad.filter("reason = 'unknown'").groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(settings.most)
    unknown = unknown.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("unknown_record_types"))
    ids = inside.select("path", "session_id")
    # without texts there are no excerpts
    candidates = report.excerpt_candidates(said, ids, "redacted" if settings.modes()[0] == "metrics" else settings.modes()[0])
    excerpts = report.excerpts(inside, candidates, 0 if settings.modes()[0] == "metrics" else settings.max_excerpts)
    about = inside.select("session_id", "project", _date("created").alias("date"), "status", "work_area", "role", "platform", "family_id")
    excerpts = excerpts.join(about, "session_id")
    if settings.modes()[0] != "local":
        excerpts = excerpts.withColumn("family_id", text.stable_id(F.col("family_id"), "task"))
    return {
        "scoped": scope, "sessions": inside, "public": public, "families": shown, "totals": t, "interaction": i, "projects": p, "excerpts": excerpts.drop("session_id"),
        "coverage": c.withColumn("one", F.lit(1)).join(files.withColumn("one", F.lit(1)), "one").join(unknown.withColumn("one", F.lit(1)), "one").drop("one", "unknown_records"),
        "narrative": report.narrative(inside, p), "family_totals": report.family_totals(families), "friction": report.friction(inside), "areas": report.work_areas(inside),
        "roles": report.dimension(inside, "role"), "platforms": report.dimension(inside, "platform"), "providers": report.providers(inside),
        "recommendations": report.recommendation_rules(t, i, c, p), "halves": report.halves(inside, settings.since, settings.until), **{f"use_{k}": v for k, v in report.usage_profile(inside).items()},
    }


def sections(t: dict[str, DataFrame], settings: Settings, cache: dict[str, int] | None = None) -> DataFrame:
    """(name, json) of every section of a report, of the tables above; cache: the counts of an incremental refresh."""
    spark, most = t["sessions"].sparkSession, settings.most
    privacy, analysis = settings.modes()
    known = {k: F.lit(json.dumps(v)) for k, v in {
        "schema": settings.schema, "schema_version": 1, "analyzer_version": settings.version, "product": settings.product, "runtime": settings.runtime,
        "generated_at": stamp(settings.generated_at or settings.until),
    }.items()}
    scope = {
        "runtime": settings.runtime, "privacy_mode": PRIVACY[privacy], "analysis_privacy_mode": analysis, "analysis_depth": settings.depth, "locale": settings.locale,
        "max_excerpts": 0 if privacy == "metrics" else settings.max_excerpts,
    }
    project = text.project_label(F.lit(settings.project)) if settings.project else F.lit(None).cast("string")
    known["scope"] = as_json(obj({k: F.lit(v) for k, v in scope.items()} | {"project": project}))
    known["measurement_contract"] = as_json(obj({k: F.lit(v) for k, v in CONTRACT.items()} | {"failure_rule_version": F.lit(RULES_VERSION)}))
    hits = {"enabled": cache is not None, "hits": 0, "misses": 0, "invalid": 0, "write_errors": 0} | (cache or {})
    every = lambda df, *drop: {c: F.col(c) for c in df.columns if c not in drop}

    out = [fixed(spark, known)]
    out.append(single(t["coverage"], "coverage", obj(every(t["coverage"]) | {
        "since": F.lit(stamp(settings.since)), "until": F.lit(stamp(settings.until)), "deterministic_cache": {k: F.lit(v) for k, v in hits.items()},
    })))
    token = {c: F.col(c) for c in t["totals"].columns if c.endswith("_tokens")}
    out.append(single(t["totals"], "totals", obj(every(t["totals"], *token) | {"tokens": token})))
    out.append(single(t["interaction"], "interaction_metrics", obj(every(t["interaction"]))))
    out.append(single(t["narrative"], "narrative", obj(every(t["narrative"]))))
    out.append(single(t["family_totals"], "task_family_totals", obj({
        "task_families": F.col("families"), "rollouts": F.col("rollouts"), "root_tasks": F.col("roots"), "verified_completed": F.col("verified"), "accepted": F.col("accepted"),
    })))
    for name, dim in (("roles", "role"), ("platforms", "platform")):
        fields = {c: F.col(c) for c in (dim, "rollouts", "task_families", "total_token_share", "tool_calls", "structured_failures")} | {"tokens": _token_fields()}
        order = F.array_position(F.array(*map(F.lit, report.ROLES)), F.col(dim)) if dim == "role" else F.col(dim)
        out.append(listed(t[name], f"{dim}_metrics", obj(fields), [order], most))
    busiest = [F.desc("sessions"), F.desc("tool_calls")]
    out.append(listed(t["projects"], "projects", obj(every(t["projects"])), [*busiest, F.col("project")], most))
    area = every(t["areas"], "work_area") | {"area": F.col("work_area"), "examples": F.coalesce("examples", F.array().cast("array<string>"))}
    out.append(listed(t["areas"], "work_areas", obj(area), [*busiest, F.col("work_area")], most))
    signals = [n for n, _ in report.SIGNALS]
    out.append(listed(t["friction"], "friction_signals", obj({"signal": F.col("signal"), "count": F.col("total"), "affected_sessions": F.col("affected"), "top_tools": F.col("top_tools")}),
                      [F.array_position(F.array(*map(F.lit, signals)), F.col("signal"))], most))
    profile = []
    for put, name, key in (
        ("session_types", "session_types", "type"), ("top_tools", "top_tools", "tool"), ("file_types", "file_types", "extension"), ("skill_mentions", "skill_mentions", "skill"),
        ("hours_local", "hours", "hour"), ("weekdays", "weekdays", "weekday"),
    ):
        d = t[f"use_{name}"]
        ranked = "name" in d.columns
        n = "count" if "count" in d.columns else next(c for c in d.columns if c != key)
        order = [F.desc(n), F.col("name")] if ranked else [F.col(key)]
        profile.append(listed(d, put, obj({key: F.col("name") if ranked else F.col(key), "count": F.col(n)}), order, most))
    out.append(_joined(reduce(DataFrame.unionByName, profile)).select(F.lit("usage_profile").alias("name"), F.col("report").alias("json")))
    by_model = t["providers"].filter("model IS NOT NULL")
    out.append(listed(by_model, "provider_models", obj(every(by_model)), [F.col("provider"), F.col("model")], most))
    models = by_model.groupBy("provider").agg(F.sort_array(F.collect_list(F.struct("model", "sessions"))).alias("models"))
    whole = t["providers"].filter("model IS NULL").select("provider", "sessions").join(models, "provider")
    out.append(listed(whole, "providers", obj(every(whole)), [F.col("provider")], most))
    latest, complex_ = [F.desc("created_ms"), F.col("session_id")], [F.desc("complexity_score"), F.col("created_ms"), F.col("session_id")]
    out.append(listed(t["public"], "session_summaries", obj(session_view()), latest, most))
    out.append(listed(t["public"], "workflow_candidates", obj(session_view()), complex_, 5))
    out.append(listed(t["families"], "task_families", obj(family_view()), [F.desc("date"), F.desc("family_id")], most))
    out.append(listed(t["excerpts"], "excerpts", obj(every(t["excerpts"], "position", "family_id") | {"task_family_id": F.col("family_id")}), [F.col("position")], max(1, settings.max_excerpts)))
    recs = every(t["recommendations"], "position", "evidence") | {"evidence": sorted_map(F.col("evidence"))}
    out.append(listed(t["recommendations"], "recommendations", obj(recs), [F.col("position")], most))
    out.append(listed(t["halves"], "period_comparison", obj(every(t["halves"])), [F.col("half")], 2))
    one = lambda d: d.withColumn("one", F.lit(1))
    named = one(t["coverage"]).join(one(t["totals"].select("sessions")), "one")
    damaged = (F.col("malformed_lines") > 0) | (F.size("unknown_record_types") > 0) | (F.col("unreadable_files") > 0)
    rules = (
        ("no_input", F.col("files_scanned") == 0), ("few_sessions", (F.col("sessions") > 0) & (F.col("sessions") < 5)), ("damaged_records", damaged), ("unfinished_sessions", F.col("partial_sessions") > 0),
        ("unsure_roles", F.col("heuristic_role_rollouts") + F.col("unknown_system_rollouts") > 0), ("cache_not_written", F.lit(hits["write_errors"] > 0)),
    )
    out.append(named.select(F.lit("warnings").alias("name"), F.to_json(F.array_compact(F.array(*[F.when(holds, F.lit(n)) for n, holds in rules]))).alias("json")))
    return reduce(DataFrame.unionByName, out)


def _joined(parts: DataFrame) -> DataFrame:
    """report: one JSON object of (name, json), names sorted."""
    pairs = parts.agg(F.sort_array(F.collect_list(F.struct("name", "json"))).alias("x"))
    said = F.transform("x", lambda p: F.concat(F.lit('"'), p["name"], F.lit('":'), p["json"]))
    return pairs.select(F.concat(F.lit("{"), F.array_join(said, ","), F.lit("}")).alias("report"))


def document(parts: DataFrame) -> DataFrame:
    """One row: report (JSON) and errors, what it lacks."""
    return _joined(parts).withColumn("errors", report.contract_errors(F.col("report")))


def overlay(parts: DataFrame, new: DataFrame) -> DataFrame:
    """parts with the sections of new in place of those of the same name."""
    return parts.join(new.select("name"), "name", "left_anti").unionByName(new)


def publish(parts: DataFrame, root: str, source_root: str, whole: dict[str, DataFrame] | None = None) -> str:
    """Writes a checked report and its whole tables as a new version under root, and only then names it; gives the version.

    The list of versions is a table to which one row is appended, a commit of one file: a reader sees the report before or
    the report after, whole. Raises ValueError, and names nothing, if the report is unsound or root lies under the source.
    """
    if f"{root.rstrip('/')}/".startswith(f"{source_root.rstrip('/')}/"):
        raise ValueError("a report is not written under its source folder")
    spark = parts.sparkSession
    version = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    path = f"{root.rstrip('/')}/{version}"
    document(parts).write.parquet(f"{path}/document")
    errors = spark.read.parquet(f"{path}/document").first()["errors"]
    if errors:
        raise ValueError(f"the report lacks {errors}")
    for name, table in (whole or {}).items():
        table.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/versions")
    return version


def published(spark: SparkSession, root: str, table: str = "document") -> DataFrame:
    """The latest version's document, or one of its tables."""
    version = spark.read.parquet(f"{root.rstrip('/')}/versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root.rstrip('/')}/{version}/{table}")
