"""Evidence packs for labelling task families, and the checks on what comes back. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import classify, text
from sessionloom.operators import ordered, selection

#: Defaults of the evidence contract.
FAMILIES, BATCH, FAMILY_CHARS, MESSAGE_CHARS, FACT_CHARS, LEAST = 24, 6, 6_000, 12_000, 700, 80
TEXTS = ("goal", "interaction_style")
LISTS = ("frictions", "strengths", "evidence_refs")
ENUMS = {
    "task_type": ("implementation", "review", "debugging", "research", "writing", "configuration", "data_analysis", "planning", "discussion", "other"),
    "instruction_handling": ("followed", "partially_followed", "missed", "not_applicable", "unclear"),
    "tool_execution": ("strong", "adequate", "weak", "not_applicable", "unclear"),
    "verification_quality": ("strong", "partial", "absent", "not_applicable", "unclear"),
    "handoff_quality": ("clear", "partial", "unclear", "not_applicable"),
    "outcome_inference": ("fully_achieved", "mostly_achieved", "partially_achieved", "not_achieved", "unclear"),
}
FIELDS = ("task_family_id", *TEXTS, *ENUMS, *LISTS)
#: What a label depends on beside the evidence: the family's measures, with its three kinds of retry and of completion.
MEASURES = (
    "date", "project", "work_area", "title", "user_messages", "correction_messages", "complexity_score", "tool_calls", "structured_failures", "text_error_signals", "diagnostic_nonzero",
    "unchanged_retries", "state_change_retries", "polling_retries", "log_completed", "verified_completed", "accepted", "role_counts",
)
FORBIDDEN = ("accepted", "verified_completed")
CONFIDENCE, MEASUREMENT = ("high", "medium", "low"), ("measured", "proxy", "inferred")
SECTIONS = ("glance", "workflows", "operating_style", "strengths", "frictions", "recommendations", "horizon")


def conversation(said: DataFrame, privacy: str = "redacted") -> DataFrame:
    """(path, seq, role, text) of messages with words of their own, cleaned; of equal ones of a role in a session, the first."""
    clean = text.redact_text if privacy == "redacted" else text.local_text
    rows = said.select("path", "seq", "role", clean(F.col("body"), MESSAGE_CHARS).alias("text"))
    rows = rows.filter(~F.coalesce("text", F.lit("")).isin("", "[context omitted]", "[code omitted]"))
    return ordered.keep_first(rows.withColumn("__h", F.sha2("text", 256)), ["path", "role", "__h"], ["seq"]).drop("__h")


def tool_evidence(steps: DataFrame, privacy: str = "redacted") -> DataFrame:
    """(path, seq, role tool, text, notable) of results that tell something: checks, state changes, failures, commits.

    text: a line of facts: tool, outcome, exit code, cause, what the call was, and the result's notable lines.
    """
    of = lambda c: F.coalesce(F.col(f"call.{c}"), F.lit(False))
    failed = F.col("outcome") == "failure"
    rows = steps.filter("kind = 'result'").filter(of("verification") | of("state_change") | failed | of("commit"))
    facts = F.array_compact(F.array(
        F.concat(F.lit("tool "), "tool"), F.concat(F.lit("outcome "), "outcome"), F.concat(F.lit("exit code "), F.col("exit_code").cast("string")), F.concat(F.lit("cause "), "cause"),
        F.when(of("verification"), "verification"), F.when(of("state_change"), "state change"), F.when(F.col("committed"), "commit"),
        F.when(~of("content_dump") & (F.size("notable") > 0), F.array_join("notable", "; ")),
    ))
    clean = text.redact_text if privacy == "redacted" else text.local_text
    rows = rows.select("path", "seq", F.lit("tool").alias("role"), clean(F.array_join(facts, "; "), FACT_CHARS).alias("text"), (of("verification") | failed | of("commit")).alias("notable"), "call_id")
    return ordered.keep_first(rows.withColumn("__h", F.sha2("text", 256)), ["path", "call_id", "__h"], ["seq"]).drop("__h", "call_id")


def budgeted(rows: DataFrame, group: list[str], order: list[str], budget: int = FAMILY_CHARS) -> DataFrame:
    """rows(role, text, notable, ...) of each group within a budget of characters, with text cut where it ends, truncated and place.

    First come the first row, up to three corrections, the last user's and the last assistant's, and the last three notable
    tool facts; then the rest in order. A row is taken while more than LEAST characters are left.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    back = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    whole = lambda x: x.rowsBetween(Window.unboundedPreceding, 0)
    user, tool = F.col("role") == "user", (F.col("role") == "tool") & F.coalesce(F.col("notable"), F.lit(False))
    fix = user & classify.is_correction(F.col("text"))
    rows = rows.withColumns({
        "place": F.row_number().over(w), "__fix": F.count(F.when(fix, 1)).over(whole(w)), "__user": F.count(F.when(user, 1)).over(whole(back)),
        "__reply": F.count(F.when(F.col("role") == "assistant", 1)).over(whole(back)), "__tool": F.count(F.when(tool, 1)).over(whole(back)),
    })
    rank = (
        F.when(F.col("place") == 1, 1).when(fix & (F.col("__fix") <= 3), 2).when(user & (F.col("__user") == 1), 3)
        .when((F.col("role") == "assistant") & (F.col("__reply") == 1), 4).when(tool & (F.col("__tool") <= 3), 5).otherwise(6)
    )
    rows = ordered.within_budget(rows.withColumn("__rank", rank), group, ["__rank", "place"], F.length("text"), budget, LEAST)
    cut = F.concat(F.rtrim(F.substring("text", F.lit(1), F.greatest(F.col("room").cast("int") - 1, F.lit(1)))), F.lit("…"))
    return rows.withColumn("text", F.when(F.col("truncated"), cut).otherwise(F.col("text"))).drop("__fix", "__user", "__reply", "__tool", "__rank", "room")


def candidates(families: DataFrame, evidence: DataFrame, settings: str) -> DataFrame:
    """families with their evidence (array of id, role, text, truncated), evidence_truncated and fingerprint.

    evidence: rows of `budgeted` by family_id. The fingerprint covers the settings (privacy, depth, locale), MEASURES of the
    family and the evidence, so that any change of them asks for a new label; tokens and times do not.
    """
    key = F.concat(F.lit("evidence-"), F.substring(F.sha2(F.concat_ws("\0", F.col("family_id").cast("string"), "role", "text"), 256), 1, 18))
    packs = evidence.withColumn("id", key).groupBy("family_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "id", "role", "text", "truncated"))), lambda x: F.struct(x["id"], x["role"], x["text"], x["truncated"])).alias("evidence"),
        (F.bool_or("truncated") | (F.max("place") > F.count("*"))).alias("evidence_truncated"),
    )
    out = families.join(packs, "family_id", "left")
    measures = F.to_json(F.struct(*[F.col(c) for c in sorted(MEASURES) if c in families.columns]))
    told = F.to_json(F.transform(F.coalesce("evidence", F.array().cast(dict(out.dtypes)["evidence"])), lambda x: F.struct(x["role"], x["text"])))
    return out.withColumn("fingerprint", F.sha2(F.concat_ws("\0", F.lit(settings), measures, told), 256))


def selected(eligible: DataFrame, limit: int = FAMILIES) -> DataFrame:
    """position and family_id of the families to label, of the report's eligible families."""
    rows = eligible.select(
        "family_id", "project", "date", (F.col("structured_failures") + F.col("correction_messages") + F.col("unchanged_retries")).alias("friction"),
        (2 * (F.col("accepted") == "yes").cast("int") + (F.col("verified_completed") == "yes").cast("int")).alias("success"), F.col("complexity_score").alias("complexity"),
    )
    return selection.select_families(rows, limit)


def batches(chosen: DataFrame, size: int = BATCH) -> DataFrame:
    """chosen(position, ...) with batch_id, `size` to a batch in order of selection."""
    return chosen.withColumn("batch_id", F.format_string("batch-%03d", F.ceil(F.col("position") / size).cast("int")))


def cached(candidates_: DataFrame, cache: DataFrame, privacy: str = "redacted") -> DataFrame:
    """candidates with `facet` from cache(fingerprint, facet) where it still is a sound one; null: to be labelled."""
    found = candidates_.join(cache.select("fingerprint", "facet"), "fingerprint", "left")
    sound = F.size(facet_errors(F.col("facet"), F.col("family_id").cast("string"), F.transform("evidence", lambda x: x["id"]), privacy)) == 0
    return found.withColumn("facet", F.when(F.col("facet").isNotNull() & sound, F.col("facet")))


def read_facets(spark, path: str) -> DataFrame:
    """(batch_id, position, facet, family_id) of the files {facets: [...]} of labelled batches, named by their batch; bad files have a null facet."""
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json$", 1).alias("batch_id"), "value")
    facets = F.from_json(F.get_json_object("value", "$.facets"), "array<string>")
    rows = files.select("batch_id", F.posexplode_outer(facets).alias("position", "facet"))
    return rows.withColumn("family_id", F.get_json_object("facet", "$.task_family_id"))


def _all_texts(facet: Column, name: str) -> Column:
    v = F.try_variant_get(F.try_parse_json(facet), f"$.{name}", "array<variant>")
    return F.coalesce(F.forall(v, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))), F.lit(False))


def _string(facet: Column, name: str) -> Column:
    v = F.try_variant_get(F.try_parse_json(facet), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.try_parse_json(facet), f"$.{name}", "string"))


def facet_errors(facet: Column, family: Column, evidence: Column, privacy: str = "redacted") -> Column:
    """What is wrong with a facet (JSON) of a family with these evidence ids: an empty array for a sound one.

    Names: not_an_object, unknown_family (no evidence known), missing:<field>, wrong_family, bad_enum:<field>, empty:<field>,
    not_texts:<field>, no_evidence, unknown_evidence, forbidden:<field>, and those of the leak scan.
    """
    facet = text.sound_json(facet)
    v = F.try_parse_json(facet)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    keys = F.json_object_keys(facet)
    has = lambda name: F.coalesce(F.array_contains(keys, name), F.lit(False))
    refs = F.when(_all_texts(facet, "evidence_refs"), F.try_variant_get(v, "$.evidence_refs", "array<string>"))
    tests = [(f"missing:{n}", ~has(n)) for n in FIELDS]
    tests += [("wrong_family", ~F.coalesce(_string(facet, "task_family_id") == family, F.lit(False)))]
    tests += [(f"bad_enum:{n}", ~F.coalesce(_string(facet, n).isin(*some), F.lit(False))) for n, some in ENUMS.items()]
    tests += [(f"empty:{n}", F.coalesce(F.trim(_string(facet, n)), F.lit("")) == "") for n in TEXTS]
    tests += [(f"not_texts:{n}", ~_all_texts(facet, n)) for n in LISTS]
    tests += [("no_evidence", F.coalesce(F.size(refs), F.lit(0)) < 1), ("unknown_evidence", F.coalesce(F.size(F.array_except(refs, evidence)) > 0, F.lit(False)))]
    tests += [(f"forbidden:{n}", has(n)) for n in FORBIDDEN]
    found = F.concat(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests])), text.leak_errors(facet, privacy))
    return F.when(~is_object, F.array(F.lit("not_an_object"))).when(evidence.isNull(), F.array(F.lit("unknown_family"))).otherwise(found)


def batch_errors(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """batch_id and error of batches whose families are not those expected, in that order: out_of_order, missing, unexpected, count.

    expected and actual: (batch_id, position, family_id), positions from any start.
    """
    def listed(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy("batch_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "family_id"))), lambda x: x["family_id"]).alias(name))

    both = listed(expected, "want").join(listed(actual, "got"), "batch_id", "full")
    kind = dict(both.dtypes)["want"]
    both = both.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c in ("want", "got")})
    tests = F.array_compact(F.array(
        F.when(F.size(F.array_except("want", "got")) > 0, "missing"), F.when(F.size(F.array_except("got", "want")) > 0, "unexpected"), F.when(F.size("want") != F.size("got"), "count"),
        F.when((F.size("want") == F.size("got")) & (F.size(F.array_except("want", "got")) == 0) & (F.size(F.array_except("got", "want")) == 0) & (F.col("want") != F.col("got")), "out_of_order"),
    ))
    return both.select("batch_id", F.explode(tests).alias("error"))


def in_selection_order(facets: DataFrame, chosen: DataFrame) -> DataFrame:
    """facets(family_id, ...) with their position in the selection, in that order; raises if any is missing or twice."""
    out = facets.drop("position").join(chosen.select("family_id", "position"), "family_id")
    if out.count() != chosen.count() or out.select("family_id").distinct().count() != chosen.count():
        raise ValueError("the facets are not one for each selected family")
    return out.orderBy("position")


def aggregate_errors(items: DataFrame, families: DataFrame, evidence: DataFrame) -> DataFrame:
    """section, position and error of the items of an aggregate that break its rules.

    items(section, position, title, text, families array, refs array, confidence, measurement, key, action, copy_prompt,
    singleton); families(family_id) are those selected; evidence(id, family_id) tells who owns what. A recommendation with
    one family says so (singleton). A section without any item gives no row; section_errors finds sections that are absent.
    """
    rows = items.withColumn("n", F.monotonically_increasing_id())
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    told = rows.select("n", F.explode("families").alias("family_id")).join(families.select("family_id").distinct(), "family_id", "left_anti").select("n").distinct().withColumn("lost", F.lit(True))
    refs = rows.select("n", "families", F.explode("refs").alias("id")).join(evidence.select("id", F.col("family_id").alias("owner")).distinct(), "id", "left")
    refs = refs.groupBy("n").agg(F.bool_or(F.col("owner").isNull()).alias("unknown"), F.bool_or(F.col("owner").isNotNull() & ~F.coalesce(F.array_contains("families", F.col("owner")), F.lit(False))).alias("foreign"))
    rows = rows.join(told, "n", "left").join(refs, "n", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    is_rec = F.col("section") == "recommendations"
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    tests = (
        ("unknown_section", ~F.col("section").isin(*SECTIONS)), ("title", blank("title")), ("text", blank("text")), ("families", none("families") | flag("lost")),
        ("evidence", none("refs") | flag("unknown")), ("foreign_evidence", flag("foreign")), ("confidence", ~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False))),
        ("measurement", ~F.coalesce(F.col("measurement").isin(*MEASUREMENT), F.lit(False))), ("key", is_rec & blank("key")), ("action", is_rec & (F.col("action").isNull() | F.col("copy_prompt").isNull())),
        ("singleton", is_rec & (F.coalesce(F.size(F.array_distinct("families")), F.lit(0)) < 2) & ~flag("singleton")),
    )
    return rows.select("section", "position", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests]))).alias("error"))


def section_errors(aggregate: Column) -> Column:
    """The sections that an aggregate (JSON) lacks."""
    v = F.try_parse_json(text.sound_json(aggregate))
    there = lambda s: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{s}", "variant")).startswith("ARRAY"), F.lit(False))
    return F.array_compact(F.array(*[F.when(~there(s), F.lit(s)) for s in SECTIONS]))


def semantic_recommendations(items: DataFrame, runtime: str) -> DataFrame:
    """Recommendations of an aggregate with a stable id of their key, support and priority (medium for a single observation)."""
    rows = items.filter("section = 'recommendations'").withColumn("support", F.size(F.array_distinct("families")))
    digest = F.substring(F.sha2(F.concat(F.lit(runtime), F.lit("\0"), "key"), 256), 1, 12)
    single = F.coalesce("singleton", F.lit(False))
    return rows.select(
        F.concat(F.lit("semantic-"), digest).alias("id"), "position", "key", "title", "text", "action", "copy_prompt", "support", "confidence", "measurement", "families", "refs",
        single.alias("singleton"), F.when(single, "medium").otherwise("high").alias("priority"),
    )


def semantic_status(privacy: str, analysis_privacy: str, errors: int | None) -> str:
    """not_applicable without texts, fallback where no labels came (errors is None), complete; raises where there are errors."""
    if "metrics" in (privacy, analysis_privacy):
        return "not_applicable"
    if errors:
        raise ValueError(f"{errors} errors in facets or aggregate")
    return "fallback" if errors is None else "complete"


def shares_any(facet: Column, names: tuple[str, ...] = FORBIDDEN) -> Column:
    """Whether a JSON object has any of these keys."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.array_contains(F.json_object_keys(facet), n), F.lit(False)) for n in names])
