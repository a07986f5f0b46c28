"""Evidence packs from folded logs in one call, and what becomes of them: labels into the report, or the report as it was."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.sessions import document, evidence, report
from sessionloom.sessions.document import Settings, as_json, obj

LABEL_ROLES = ("root_task", "task_subagent")
FACTS_SCHEMA = 1
STRATEGY = "recent, then friction, then verified or accepted, then complexity, with a cap per project"
ITEM = "section string, position int, title string, text string, families array<string>, refs array<string>, confidence string, measurement string, key string, action string, copy_prompt string, singleton boolean"
NAMES = {"families": "supporting_task_family_ids", "refs": "evidence_refs", "key": "recommendation_key", "singleton": "singleton_observation"}


@dataclass(frozen=True)
class Limits:
    families: int = evidence.FAMILIES
    batch: int = evidence.BATCH
    chars: int = evidence.FAMILY_CHARS


def family_evidence(chosen: DataFrame, sessions: DataFrame, said: DataFrame, steps: DataFrame, settings: Settings, chars: int = evidence.FAMILY_CHARS) -> DataFrame:
    """(family_id, place, role, text, truncated) of the families to label: what their roots and sub-agents said and did, within `chars`.

    Messages and tool facts of a family's sessions stand in the order of the sessions' creation and id, then of their records. The chosen
    families, a bounded number, are broadcast; with depth `conversation` there are no tool facts.
    """
    members = sessions.filter(F.col("role").isin(*LABEL_ROLES)).join(F.broadcast(chosen.select("family_id")), "family_id").select("path", "family_id", "created_ms", "session_id")
    mode = settings.modes()[1]
    rows = evidence.conversation(said.join(members.select("path"), "path", "left_semi"), mode).withColumn("notable", F.lit(False))
    if settings.depth == "evidence":
        rows = rows.unionByName(evidence.tool_evidence(steps.join(members.select("path"), "path", "left_semi"), mode))
    return evidence.budgeted(rows.join(members, "path"), ["family_id"], ["created_ms", "session_id", "seq", "role"], chars)


def prepare(tables: dict[str, DataFrame], said: DataFrame, steps: DataFrame, settings: Settings, cache: DataFrame | None = None, limits: Limits | None = None) -> DataFrame:
    """The candidates of a report's tables, a row per selected family, in order: position, family_id, fingerprint, evidence, facet, batch_id.

    facet is the sound label that cache(fingerprint, facet) has; the others, in order, are dealt into batches. In metrics mode, of
    the report or of the analysis, nothing is selected.
    """
    limits = limits or Limits()
    wanted = 0 if "metrics" in settings.modes() else min(limits.families, evidence.FAMILIES)
    families = report.families(tables["sessions"])
    chosen = evidence.selected(report.eligible(families), wanted)
    rows = family_evidence(chosen, tables["sessions"], said, steps, settings, limits.chars)
    about = "\0".join((settings.runtime, *settings.modes(), settings.depth, settings.locale, str(FACTS_SCHEMA)))
    found = evidence.candidates(families.join(F.broadcast(chosen), "family_id"), rows, about)
    found = found.withColumn("evidence", F.coalesce("evidence", F.array().cast(dict(found.dtypes)["evidence"]))).withColumn("evidence_truncated", F.coalesce("evidence_truncated", F.lit(False)))
    if cache is None:
        found = found.withColumn("facet", F.lit(None).cast("string"))
    else:
        found = evidence.cached(found, cache, settings.modes()[1])
    misses = found.filter("facet IS NULL").select("family_id", "position")  # a bounded number of rows
    dealt = evidence.batches(misses.withColumn("position", F.row_number().over(Window.orderBy("position"))), limits.batch).select("family_id", "batch_id")
    return found.join(dealt, "family_id", "left").orderBy("position")


def manifest(candidates: DataFrame, tables: dict[str, DataFrame], settings: Settings, limits: Limits | None = None, cached: bool = True) -> DataFrame:
    """One row about candidates: eligible, selected, truncated families, cache hits and misses, ids, batches, characters."""
    limits = limits or Limits()
    n = candidates.agg(
        F.count("*").alias("selected"), F.count("facet").alias("hits"), F.count_if(F.col("facet").isNull()).alias("misses"), F.count_if("evidence_truncated").alias("truncated_families"),
        F.transform(F.sort_array(F.collect_list(F.struct("position", "family_id"))), lambda x: x["family_id"]).alias("family_ids"), F.sort_array(F.collect_set("batch_id")).alias("batch_ids"),
        F.coalesce(F.sum(F.aggregate("evidence", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))), F.lit(0)).alias("evidence_chars"),
    )
    eligible = report.eligible(report.families(tables["sessions"])).agg(F.count("*").alias("eligible"))
    out = n.withColumn("one", F.lit(1)).join(eligible.withColumn("one", F.lit(1)), "one").drop("one")
    privacy, analysis = settings.modes()
    return out.withColumns({
        "privacy": F.lit(privacy), "analysis_privacy": F.lit(analysis), "analysis_depth": F.lit(settings.depth), "locale": F.lit(settings.locale), "limit": F.lit(min(limits.families, evidence.FAMILIES)),
        "batch_size": F.lit(limits.batch), "cache_enabled": F.lit(cached), "skipped": F.lit("metrics" in settings.modes()),
    })


def batch_tasks(candidates: DataFrame) -> DataFrame:
    """(batch_id, position, task) of the families that have to be labelled: the measures and evidence of each as JSON."""
    measures = obj({c: F.col(c) for c in evidence.MEASURES})
    task = as_json(F.struct(F.col("evidence"), F.col("evidence_truncated"), F.col("fingerprint"), measures.alias("metrics"), F.col("family_id").alias("task_family_id")))
    return candidates.filter("batch_id IS NOT NULL").select("batch_id", "position", task.alias("task"))


def aggregate_items(aggregate: DataFrame) -> DataFrame:
    """The items of an aggregate(json): section, position and the fields of each; sections that are absent give none."""
    kinds = [f.strip().split(" ") for f in ITEM.split(", ")[2:]]
    fields = ", ".join(f"{NAMES.get(name, name)}: {kind}" for name, kind in kinds)
    value = text.sound_json(F.col("json"))
    each = F.array(*[F.struct(F.lit(s).alias("section"), F.from_json(F.get_json_object(value, f"$.{s}"), f"array<struct<{fields}>>").alias("items")) for s in evidence.SECTIONS])
    rows = aggregate.select(F.inline(each)).select("section", F.posexplode("items").alias("position", "i")).select("section", "position", "i.*")
    return rows.withColumnsRenamed({v: k for k, v in NAMES.items()})


def label_errors(candidates: DataFrame, facets: DataFrame, aggregate: DataFrame, settings: Settings) -> DataFrame:
    """(place, error): everything that is wrong with facets(family_id, facet) of the candidates and with their aggregate(json)."""
    ids = candidates.select("family_id", F.transform("evidence", lambda x: x["id"]).alias("ids"))
    told = facets.join(ids, "family_id", "left")
    wrong = told.select("family_id", F.explode(evidence.facet_errors(F.col("facet"), F.col("family_id"), F.col("ids"), settings.modes()[1])).alias("error"))
    lost = ids.join(facets.select("family_id"), "family_id", "left_anti").select("family_id", F.lit("no_facet").alias("error"))
    twice = facets.groupBy("family_id").agg(F.count("*").alias("n")).filter("n > 1").select("family_id", F.lit("two_facets").alias("error"))
    owners = candidates.select("family_id", F.explode("evidence").alias("e")).select(F.col("e.id").alias("id"), "family_id")
    items = evidence.aggregate_errors(aggregate_items(aggregate), ids, owners).select(F.concat_ws("-", "section", F.col("position").cast("string")).alias("place"), "error")
    absent = aggregate.select(F.explode(evidence.section_errors(F.col("json"))).alias("error")).select(F.lit("aggregate").alias("place"), "error")
    leaks = aggregate.select(F.lit("aggregate").alias("place"), F.explode(text.leak_errors(F.col("json"), settings.modes()[0])).alias("error"))
    return wrong.unionByName(lost).unionByName(twice).withColumnRenamed("family_id", "place").unionByName(items).unionByName(absent).unionByName(leaks)


def finalise(parts: DataFrame, about: DataFrame, settings: Settings, candidates: DataFrame, facets: DataFrame | None = None, aggregate: DataFrame | None = None) -> DataFrame:
    """The sections of a report with the labels' outcome: complete, fallback (no labels came) or not_applicable (metrics mode).

    complete replaces the narrative and the recommendations, and adds facets, evidence and the aggregate; otherwise all sections of the
    report stay as they were and only semantic_analysis is added. about: the manifest. Labels with errors raise ValueError.
    """
    spark = parts.sparkSession
    came = facets is not None and aggregate is not None and "metrics" not in settings.modes()
    status = evidence.semantic_status(*settings.modes(), label_errors(candidates, facets, aggregate, settings).count() if came else None)
    selection = {
        "eligible": F.col("eligible"), "selected": F.col("selected"), "limit": F.col("limit"), "truncated_families": F.col("truncated_families"), "strategy": F.lit(STRATEGY),
    }
    reason = {"complete": None, "fallback": "labels_did_not_come", "not_applicable": "metrics_mode"}[status]
    told = {
        "status": F.lit(status), "schema_version": F.lit(FACTS_SCHEMA), "privacy_mode": F.col("privacy"), "analysis_privacy_mode": F.col("analysis_privacy"), "analysis_depth": F.col("analysis_depth"),
        "selection": selection, "cache": {"enabled": F.col("cache_enabled"), "hits": F.col("hits"), "misses": F.col("misses")}, "fallback_reason": F.lit(reason).cast("string"),
    }
    new = document.single(about, "semantic_analysis", obj(told))
    if status != "complete":
        return document.overlay(parts, new)
    items = aggregate_items(aggregate)
    shown = text.redact_text if settings.modes()[0] == "redacted" else text.local_text
    seen = candidates.select("position", "family_id", F.posexplode("evidence").alias("n", "e")).select("position", "n", "family_id", "e.id", "e.role", shown(F.col("e.text"), evidence.MESSAGE_CHARS).alias("text"), "e.truncated")
    labels = facets.join(F.broadcast(candidates.select("family_id", "position")), "family_id").orderBy("position")
    # facets and the aggregate are JSON already: a bounded number of families, and one document
    ordered = labels.agg(F.sort_array(F.collect_list(F.struct("position", "facet"))).alias("x")).select(F.lit("semantic_facets").alias("name"), F.concat(F.lit("["), F.array_join(F.transform("x", lambda p: p["facet"]), ","), F.lit("]")).alias("json"))
    new = new.unionByName(ordered).unionByName(aggregate.select(F.lit("semantic").alias("name"), "json"))
    new = new.unionByName(aggregate.select(F.lit("semantic_workflows").alias("name"), F.get_json_object("json", "$.workflows").alias("json")))
    item = {"id": F.col("id"), "task_family_id": F.col("family_id"), "role": F.col("role"), "text": F.col("text"), "message_truncated": F.col("truncated"), "untrusted_historical_text": F.lit(True)}
    new = new.unionByName(document.listed(seen, "semantic_evidence", obj(item), [F.col("position"), F.col("n")], settings.most))
    story = [
        document.listed(items.filter(F.col("section") == s), put, obj({"title": F.col("title"), "text": F.col("text"), "confidence": F.col("confidence"), "measurement": F.col("measurement"), "evidence": F.size("refs")}), [F.col("position")], settings.most)
        for s, put in (("glance", "glance"), ("strengths", "wins"), ("horizon", "horizon"))
    ]
    new = new.unionByName(document._joined(story[0].unionByName(story[1]).unionByName(story[2])).select(F.lit("narrative").alias("name"), F.col("report").alias("json")))
    recs = evidence.semantic_recommendations(items, settings.runtime)
    fields = {c: F.col(c) for c in ("id", "title", "action", "copy_prompt", "priority", "confidence", "measurement", "support")} | {
        "feature": F.col("key"), "why": F.col("text"), "supporting_task_family_ids": F.col("families"), "evidence_refs": F.col("refs"), "singleton_observation": F.col("singleton"),
    }
    new = new.unionByName(document.listed(recs, "recommendations", obj(fields), [F.col("position")], settings.most))
    return document.overlay(parts, new)
