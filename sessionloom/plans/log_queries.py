"""Queries that turn driver tables into session records and fold them, and the rules on results, labels and batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions import classify, tools
from sessionloom.operators import ordered
from sessionloom.plans.registry import EVENTS, events, query, table
from sessionloom.sessions import evidence, fold, report
from sessionloom.sources import session_logs
from sessionloom.sources.stored import stored

W = "PARTITION BY user_id ORDER BY us, event_id"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
#: The correction words between characters that are no letters, digits or underscores of any script.
FIX = r"(?i)(^|[^\p{L}\p{M}\p{N}_])(no|not that|instead|wrong|stop|actually|rather than|misunderstood)([^\p{L}\p{M}\p{N}_]|$)"


def _records(lines):
    """Records of lines(path, seq, value)."""
    return session_logs.normalise_records(lines.withColumn("readable", F.lit(True)))[0]


def _folded(lines):
    """Sessions of lines(path, seq, value); the records, which every part of the fold starts from, are written once."""
    return fold.fold_sessions(stored(_records(lines), "records"))


def _json(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _conversation_lines(spark, d):
    """A log per conversation: a header, and a message per turn of users and assistants."""
    c = table(spark, d, "conversations")
    path = F.concat(F.lit("/logs/sessions/--k--/"), F.col("conv_id").cast("string"), F.lit("/session"))
    cwd = F.concat(F.when(F.col("conv_id") % 3 == 0, "/Users/ann/p").when(F.col("conv_id") % 3 == 1, "C:\\work\\p").otherwise("/srv/p"), (F.col("conv_id") % 5).cast("string"))
    heads = c.select("conv_id").distinct().select(path.alias("path"), F.lit(-1).cast("long").alias("seq"), _json(type=F.lit("session"), id=F.col("conv_id").cast("string"), createdAt=F.col("conv_id") * 1000, cwd=cwd).alias("value"))
    items = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    when, at = F.col("conv_id") * 1000 + F.col("turn") * 10, F.col("role") == "user"
    said = F.when(at, _json(type=F.lit("user/message"), time=when, data=F.struct(items.alias("content")))).otherwise(
        _json(type=F.lit("assistant/message"), time=when, data=F.struct(F.struct(items.alias("content")).alias("message")))
    )
    return heads.unionByName(c.filter("role IN ('user', 'assistant')").select(path.alias("path"), F.col("turn").cast("long").alias("seq"), said.alias("value")))


TALK = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'"


@query(rf"""SELECT c.conv_id, coalesce(u.users, 0)::BIGINT AS user_messages, count(*) FILTER (c.role = 'assistant') AS assistant_messages, coalesce(u.fixes, 0)::BIGINT AS correction_messages,
        CASE c.conv_id % 3 WHEN 0 THEN 'macos' WHEN 1 THEN 'windows' ELSE 'posix_other' END AS platform, 'p' || c.conv_id % 5 AS project
    FROM conversations c LEFT JOIN (SELECT conv_id, count(*) AS users, count(*) FILTER (n > 1 AND regexp_matches(text, '{FIX}')) AS fixes FROM ({TALK}) GROUP BY 1) u ON u.conv_id = c.conv_id
    GROUP BY c.conv_id, u.users, u.fixes""")
def conversation_sessions(spark, d):
    s = _folded(_conversation_lines(spark, d))
    return s.select(F.col("session_id").cast("long").alias("conv_id"), "user_messages", "assistant_messages", "correction_messages", "platform", "project")


def _event_lines(spark, d):
    """A log per user: views and clicks are calls (of a patch tool, a reader or a polling tool), purchases and errors results."""
    e = events(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")))
    path = F.concat(F.lit("/logs/sessions/--k--/"), F.col("user_id").cast("string"), F.lit("/session"))
    heads = e.select("user_id").distinct().select(path.alias("path"), F.lit(0).cast("long").alias("seq"), _json(type=F.lit("session"), id=F.col("user_id").cast("string"), createdAt=F.lit(1)).alias("value"))
    kind, call = F.col("event_type"), F.col("k").cast("string")
    name = F.when(kind == "click", "write_stdin").when(F.col("k") % 5 == 0, "apply_patch").otherwise("read_file")
    asks = _json(type=F.lit("tool/call"), time=F.col("us") / 1000, data=F.struct(call.alias("callId"), name.alias("name"), F.col("props").alias("arguments")))
    item = F.struct(call.alias("toolCallId"), (kind == "error").alias("isError"))
    tells = _json(type=F.lit("tool/result"), time=F.col("us") / 1000, data=F.struct(F.struct(F.array(item).alias("content")).alias("message")))
    rows = e.filter("event_type <> 'signup'").select(path.alias("path"), F.col("n").cast("long").alias("seq"), F.when(kind.isin("view", "click"), asks).otherwise(tells).alias("value"))
    return heads.unionByName(rows)


STEPS = f"""
    WITH a AS (SELECT *, event_type IN ('view', 'click') AS call, last_value(CASE WHEN event_type IN ('view', 'click') THEN event_type END IGNORE NULLS)
                   OVER (PARTITION BY user_id, k ORDER BY us, event_id {BEFORE}) AS paired FROM {EVENTS}),
    b AS (SELECT *, CASE WHEN call THEN event_type ELSE paired END || k AS fp,
               coalesce(sum((event_type = 'purchase' AND paired = 'view' AND k % 5 = 0)::INT) OVER ({W} {BEFORE}), 0) AS epoch FROM a),
    c AS (SELECT *, count(CASE WHEN call THEN 1 END) OVER (PARTITION BY user_id, fp ORDER BY us, event_id {BEFORE}) AS seen,
               last_value(CASE WHEN event_type = 'error' AND paired IS NOT NULL THEN epoch END IGNORE NULLS) OVER (PARTITION BY user_id, fp ORDER BY us, event_id {BEFORE}) AS failed_at FROM b),
    s AS (SELECT *, CASE WHEN NOT call THEN '' WHEN event_type = 'click' AND seen > 0 THEN 'polling' WHEN failed_at IS NULL THEN 'none'
                         WHEN epoch > failed_at THEN 'after_state_change' ELSE 'unchanged' END AS retry FROM c)"""


@query(f"""{STEPS} SELECT user_id, count(*) FILTER (call) AS tool_calls, count(*) FILTER (event_type = 'error') AS tool_failures, count(*) FILTER (retry = 'unchanged') AS unchanged_retries,
    count(*) FILTER (retry = 'after_state_change') AS state_change_retries, count(*) FILTER (retry = 'polling') AS polling_retries FROM s GROUP BY 1""")
def tool_sessions(spark, d):
    s = _folded(_event_lines(spark, d))
    return s.select(F.col("session_id").cast("long").alias("user_id"), "tool_calls", "tool_failures", "unchanged_retries", "state_change_retries", "polling_retries")


@query(f"""{STEPS}, t AS (SELECT count(DISTINCT user_id) AS sessions, count(*) FILTER (call) AS tool_calls, count(*) FILTER (event_type = 'error') AS tool_failures,
        count(*) FILTER (retry = 'unchanged') AS unchanged_retries, count(*) FILTER (retry = 'after_state_change') AS state_change_retries, count(*) FILTER (retry = 'polling') AS polling_retries FROM s)
    SELECT *, tool_failures AS structured_failures, unchanged_retries + state_change_retries + polling_retries AS repeated_retries FROM t""")
def report_totals(spark, d):
    t = report.totals(_folded(_event_lines(spark, d)))
    return t.select("sessions", "tool_calls", "tool_failures", "unchanged_retries", "state_change_retries", "polling_retries", "structured_failures", "repeated_retries")


@query(f"SELECT 'k' AS key, 'number' AS kind, count(*) AS n, sum(k)::BIGINT AS total FROM {EVENTS}")
def json_scalars(spark, d):
    rows = table(spark, d, "events").select(F.explode(tools.walk_json("props")["scalars"]).alias("x"))
    return rows.groupBy("x.key", "x.kind").agg(F.count("*").alias("n"), F.sum("x.whole").alias("total"))


@query(f"""SELECT event_id, CASE WHEN event_type = 'error' OR k % 3 <> 0 THEN 'failure' ELSE 'success' END AS outcome,
    CASE WHEN event_type = 'error' THEN NULL ELSE k % 3 END::BIGINT AS exit_code FROM {EVENTS}""")
def structured_outcome(spark, d):
    e = events(spark, d)
    told = _json(status=F.col("event_type"), exit_code=F.col("k") % 3)
    return e.select("event_id", tools.walk_json(told)["scalars"].alias("s")).select("event_id", tools.structured_outcome(F.col("s")).alias("o")).select("event_id", "o.outcome", "o.exit_code")


NAMES = {"view": "web_search", "click": "write_stdin", "purchase": "mcp__zotero__add", "error": "spawn_agent", "signup": "request_user_input"}


@query("""SELECT count(*) FILTER (event_type = 'signup') AS clarifies, count(*) FILTER (event_type = 'error') AS starts_agent, count(*) FILTER (event_type = 'view') AS searches_web,
    count(*) FILTER (event_type = 'purchase') AS through_connector, count(*) FILTER (event_type = 'click') AS polls FROM events""")
def tool_classes(spark, d):
    raw = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[F.col("event_type")]
    classes = classify.tool_classes(classify.family_tool(raw), raw)
    return table(spark, d, "events").agg(*[F.count_if(v).alias(k) for k, v in classes.items()])


@query("SELECT doc_id, (n_chars % 100)::DOUBLE AS seconds FROM documents")
def wall_seconds(spark, d):
    text = F.concat(F.lit("Wall time "), (F.col("n_chars") % 100).cast("string"), F.lit(" seconds\n"), F.coalesce("text", F.lit("")))
    none = F.array().cast(tools.SCALARS)
    return table(spark, d, "documents").select("doc_id", tools.wall_seconds(tools.lines_of(text), none).alias("seconds"))


FILES = ("py", "MD", "exe", "json", "tar.gz", "yml")


@query(f"""SELECT extension, count(*) AS n FROM (SELECT lower({list(FILES)}[page_id % {len(FILES)} + 1]) AS extension FROM pages UNION ALL SELECT 'csv' FROM pages WHERE page_id % 4 = 0)
    WHERE extension NOT IN ('exe', 'tar.gz') GROUP BY 1""")
def file_extensions(spark, d):
    """Arguments of a call per page: each names a file, some a second one; only common extensions count."""
    kind = F.get(F.array(*map(F.lit, FILES)), (F.col("page_id") % len(FILES)).cast("int"))
    name = F.concat(F.lit("docs/page"), F.col("page_id").cast("string"), F.lit("."), kind)
    args = _json(path=name, to=F.when(F.col("page_id") % 4 == 0, "out/t.csv"), url=F.lit("https://host.example"))
    found = table(spark, d, "pages").select(F.explode(tools.file_extensions(args)).alias("extension"))
    return found.groupBy("extension").agg(F.count("*").alias("n"))


@query(rf"""SELECT doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, '') || chr(10) || 'Ran ' || doc_id % 9 || ' tests' || chr(10) || 'x' || doc_id % 5 || ' files changed', chr(10))) AS line FROM documents)
    WHERE regexp_matches(trim(line), '{tools.NOTABLE_LINE}') GROUP BY 1""")
def notable_lines(spark, d):
    """How many lines of each text, and of two more, tell of tests, checks or changes."""
    more = F.format_string("Ran %d tests\nx%d files changed", F.col("doc_id") % 9, F.col("doc_id") % 5)
    lines = F.filter(tools.lines_of(F.concat_ws("\n", F.coalesce("text", F.lit("")), more)), lambda x: x.rlike(tools.NOTABLE_LINE))
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n")).filter("n > 0")


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def key_intersect(spark, d):
    """Events whose JSON has a key that labels may not have."""
    e = events(spark, d)
    told = F.when(F.col("event_type") == "error", _json(k=F.col("k"), accepted=F.lit(True))).otherwise(F.col("props"))
    return e.filter(evidence.shares_any(told)).select("event_id")


BATCHES = """
    WITH b AS (SELECT doc_id, source || '-' || ceil(row_number() OVER (PARTITION BY source ORDER BY doc_id) / 6.0)::INT AS batch, doc_id AS pos FROM documents),
    a AS (SELECT CASE WHEN doc_id % 89 = 0 THEN -doc_id ELSE doc_id END AS doc_id, batch, CASE WHEN doc_id % 61 = 0 THEN -pos ELSE pos END AS pos FROM b WHERE doc_id % 97 <> 0),
    l AS (SELECT batch, list(doc_id ORDER BY pos) AS want FROM b GROUP BY 1), m AS (SELECT batch, list(doc_id ORDER BY pos) AS got FROM a GROUP BY 1),
    x AS (SELECT batch, want, coalesce(got, []) AS got FROM l LEFT JOIN m USING (batch)),
    y AS (SELECT batch, want, got, len(list_filter(want, lambda w: NOT list_contains(got, w))) > 0 AS missing, len(list_filter(got, lambda g: NOT list_contains(want, g))) > 0 AS unexpected FROM x)"""


@query(f"""{BATCHES} SELECT batch, 'missing' AS error FROM y WHERE missing UNION ALL SELECT batch, 'unexpected' FROM y WHERE unexpected
    UNION ALL SELECT batch, 'count' FROM y WHERE len(want) <> len(got) UNION ALL SELECT batch, 'out_of_order' FROM y WHERE NOT missing AND NOT unexpected AND len(want) = len(got) AND want <> got""")
def batch_integrity(spark, d):
    """Documents in batches by source, against a return that lacks some, has strangers and swaps others."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    want = table(spark, d, "documents").select(F.col("doc_id").alias("family_id"), F.concat_ws("-", "source", F.ceil(n / 6).cast("string")).alias("batch_id"), F.col("doc_id").alias("position"))
    got = want.filter("family_id % 97 <> 0").withColumns({
        "position": F.when(F.col("family_id") % 61 == 0, -F.col("position")).otherwise(F.col("position")), "family_id": F.when(F.col("family_id") % 89 == 0, -F.col("family_id")).otherwise(F.col("family_id")),
    })
    return evidence.batch_errors(want, got).withColumnRenamed("batch_id", "batch")


@query("""WITH i AS (SELECT doc_id, doc_id % 2 <> 0 AS rec, doc_id + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS ref FROM documents),
    x AS (SELECT i.*, l.doc_id IS NULL AS lost, o.doc_id AS owner FROM i LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = i.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM documents) o ON o.doc_id = i.ref),
    e AS (SELECT rec, 'families' AS error FROM x WHERE lost UNION ALL SELECT rec, 'evidence' FROM x WHERE owner IS NULL UNION ALL SELECT rec, 'foreign_evidence' FROM x WHERE owner <> doc_id
          UNION ALL SELECT rec, 'confidence' FROM x WHERE doc_id % 3 = 0 UNION ALL SELECT rec, 'singleton' FROM x WHERE rec AND doc_id % 4 <> 1)
    SELECT CASE WHEN rec THEN 'recommendations' ELSE 'glance' END AS section, error, count(*) AS n FROM e GROUP BY 1, 2""")
def aggregate_validation(spark, d):
    """Documents as items of an aggregate: labelled ones are selected families, each document is its own evidence."""
    docs, i = table(spark, d, "documents").select("doc_id"), F.col("doc_id")
    items = docs.select(
        F.when(i % 2 != 0, "recommendations").otherwise("glance").alias("section"), i.alias("position"), F.lit("t").alias("title"), F.lit("x").alias("text"), F.array(i).alias("families"),
        F.array(i + F.when(i % 10 == 0, 1).otherwise(0)).alias("refs"), F.when(i % 3 == 0, "sure").otherwise("high").alias("confidence"), F.lit("inferred").alias("measurement"),
        F.lit("k").alias("key"), F.lit("a").alias("action"), F.lit("c").alias("copy_prompt"), (i % 4 == 1).alias("singleton"),
    )
    families = table(spark, d, "labels").select(i.alias("family_id"))
    found = evidence.aggregate_errors(items, families, docs.select(i.alias("id"), i.alias("family_id")))
    return found.groupBy("section", "error").agg(F.count("*").alias("n"))


@query()
def excerpt_fold(spark, d):
    """Twelve excerpts of conversations under the three passes and their limits."""
    c = table(spark, d, "conversations").filter("role = 'user'")
    said = ordered.message_kinds(c, ["conv_id"], ["turn"], classify.is_correction(F.col("text")))
    sessions = c.groupBy("conv_id").agg(F.sum(F.length("text")).cast("double").alias("complexity_score")).select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") % 5).cast("string").alias("project"), "complexity_score", F.col("conv_id").alias("created_ms"),
        (F.col("conv_id") % 3 == 0).cast("int").alias("tool_failures"), F.lit(0).alias("aborted_turns"), F.lit(0).alias("permission_blocks"),
    )
    return report.excerpts(sessions, said.select(F.col("conv_id").alias("session_id"), "ordinal", "kind", "text"), 12)
