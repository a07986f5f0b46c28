"""Queries over documents, pages, conversations, labels: redaction, classification, evidence, contracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions import classify, text, tools
from sessionloom.operators import ordered
from sessionloom.plans.registry import query, table
from sessionloom.sessions import evidence
from sessionloom.sources import incremental

EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"


@query("SELECT page_id FROM pages WHERE lower(regexp_replace(url, '[?#].*', '')) LIKE 'http%/en/%' OR lower(regexp_replace(url, '[?#].*', '')) LIKE 'http%/en'")
def path_prefix_filter(spark, d):
    path = F.lower(F.regexp_replace("url", r"[?#].*", ""))
    return table(spark, d, "pages").filter(path.like("http%/en/%") | path.like("http%/en")).select("page_id")


@query("SELECT doc_id, n_chars, length(text)::BIGINT AS size FROM documents")
def privacy_projection(spark, d):
    """Metrics mode: numbers stay, texts go."""
    return table(spark, d, "documents").select("doc_id", "n_chars", F.length("text").cast("long").alias("size"))


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '{EMAIL[4:]}', '[email]', 'gi')) AS masked FROM documents")
def mask_emails(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace("text", text.EMAIL, "[email]"), 256).alias("masked"))


@query()
def mask_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.mask_credentials(F.col("text")), 256).alias("masked"))


@query()
def url_query_mask(spark, d):
    return table(spark, d, "pages").select("page_id", text.mask_url_queries(F.col("url")).alias("url"))


@query("SELECT page_id, (least(length(html), 50) + 19 + 4)::INT AS n FROM pages")
def strip_blocks(spark, d):
    """A page's beginning, the page as an injected block, and a tail."""
    whole = F.concat(F.substring("html", 1, 50), F.lit("<system-reminder>"), F.col("html"), F.lit("</system-reminder>tail"))
    return table(spark, d, "pages").select("page_id", F.length(text.strip_blocks(whole)).alias("n"))


@query("SELECT doc_id, length(regexp_replace(text, '```(.|\\n)*?```', ' [code omitted] ', 'g'))::BIGINT AS n FROM documents")
def strip_fences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(text.strip_fences(F.col("text"))).cast("long").alias("n"))


@query()
def normalise_cap(spark, d):
    return table(spark, d, "documents").select("doc_id", text.squeeze(F.col("text"), 600).alias("text"))


@query()
def redact_full(spark, d):
    return table(spark, d, "documents").select("doc_id", text.redact_text(F.col("text")).alias("text"))


@query()
def redact_local(spark, d):
    return table(spark, d, "documents").select("doc_id", text.local_text(F.col("text")).alias("text"))


@query()
def project_label(spark, d):
    return table(spark, d, "pages").select("page_id", text.project_label(F.regexp_replace("url", r"[?#].*", "")).alias("label"))


@query()
def leak_scan(spark, d):
    errors = text.leak_errors(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(errors, ",").alias("errors")).filter("errors <> ''")


def _area_sql() -> str:
    hits = []
    for name, words in classify.WORK_AREAS:
        hits.append(" + ".join(f"((length(t) - length(replace(t, '{w}', ''))) // {len(w)})" for w in words) + f" AS {name}")
    names = [n for n, _ in classify.WORK_AREAS]
    cases = " ".join(f"WHEN {n} = best THEN '{n}'" for n in names)
    return (
        f"SELECT doc_id, CASE WHEN best = 0 THEN 'general' {cases} END AS area FROM (SELECT *, greatest({', '.join(names)}) AS best "
        f"FROM (SELECT doc_id, {', '.join(hits)} FROM (SELECT doc_id, lower(text) AS t FROM documents)))"
    )


@query(_area_sql())
def work_area(spark, d):
    return table(spark, d, "documents").select("doc_id", classify.work_area(F.col("text")).alias("area"))


@query("""SELECT lang, title FROM (SELECT lang, title, row_number() OVER (PARTITION BY lang ORDER BY n DESC, title) AS k FROM (
    SELECT lang, left(text, 40) AS title, max(n_chars) AS n FROM documents GROUP BY 1, 2)) WHERE k <= 3""")
def area_examples(spark, d):
    best = table(spark, d, "documents").groupBy("lang", F.substring("text", 1, 40).alias("title")).agg(F.max("n_chars").alias("n"))
    return ordered.top_per_group(best, ["lang"], [F.desc("n"), "title"], 3).select("lang", "title")


@query("SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)(?:timed? out|timeout expired)')) AS timeouts FROM documents GROUP BY 1")
def text_signals(spark, d):
    hit = F.col("text").rlike(r"(?i)(?:timed? out|timeout expired)")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(hit).alias("timeouts"))


#: What documents are made to end with, by their id: words of failures and of commands, so that the rules meet some.
ENDS = (" operation timed out", " No module named x", " HTTP 403", " permission denied", "", " python run/smoke_test.py", " git commit -m x", " rg foo", " pip install x", " plain")
DOCS = f"(SELECT doc_id, source, text || {[e for e in ENDS]}[doc_id % {len(ENDS)} + 1] AS text FROM documents)"


def _ended(spark, d):
    ends = F.array(*[F.lit(e) for e in ENDS])
    return table(spark, d, "documents").withColumn("text", F.concat("text", F.get(ends, (F.col("doc_id") % len(ENDS)).cast("int"))))


def _cause_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, p in classify.CAUSES)
    return f"SELECT CASE {cases} ELSE 'other' END AS cause, count(*) AS n FROM {DOCS} GROUP BY 1"


@query(_cause_sql())
def failure_cause(spark, d):
    return _ended(spark, d).groupBy(tools.failure_cause(F.col("text"), F.lit(None).cast("string")).alias("cause")).agg(F.count("*").alias("n"))


def _flag_sql() -> str:
    return f"SELECT source, {', '.join(f'count(*) FILTER (regexp_matches(text, {chr(39)}{p}{chr(39)})) AS {k}' for k, p in classify.COMMANDS.items())} FROM {DOCS} GROUP BY 1"


@query(_flag_sql())
def command_flags(spark, d):
    flags = [F.count_if(classify.command_flag(F.col("text"), k)).alias(k) for k in classify.COMMANDS]
    return _ended(spark, d).groupBy("source").agg(*flags)


@query()
def mention_counts(spark, d):
    said = F.concat(F.col("text"), F.lit(" $"), F.lower("source"), F.lit("-skill, not x$a-b"))
    m = table(spark, d, "documents").select(F.explode(classify.mentions(said)).alias("mention"))
    return m.groupBy("mention").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 4 ELSE doc_id % 3 END::INT AS code FROM documents")
def exit_code_pick(spark, d):
    """Texts between two lines with exit codes."""
    line = lambda n: F.concat(F.lit("Exit code: "), (F.col("doc_id") % n).cast("string"))
    whole = F.concat_ws("\n", line(4), F.coalesce("text", F.lit("")), line(3))
    told = F.struct(F.lit("unknown").alias("outcome"), F.lit(None).cast("long").alias("exit_code"))
    return table(spark, d, "documents").select("doc_id", tools.line_outcome(tools.lines_of(whole), told)["exit_code"].cast("int").alias("code"))


USERS = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations WHERE role = 'user'"
FIX = r"(?i)(^|[^\p{L}\p{M}\p{N}_])(no|not that|instead|wrong|stop|actually|rather than|misunderstood)([^\p{L}\p{M}\p{N}_]|$)"
KIND = f"CASE WHEN ordinal = 1 THEN 'prompt' WHEN regexp_matches(text, '{FIX}') THEN 'correction' WHEN ordinal <= 4 THEN 'follow_up' ELSE 'message' END"


def _kinds(spark, d):
    users = table(spark, d, "conversations").filter("role = 'user'")
    return ordered.message_kinds(users, ["conv_id"], ["turn"], classify.is_correction(F.col("text")))


@query(f"SELECT conv_id, turn, {KIND} AS kind FROM ({USERS})")
def message_kinds(spark, d):
    return _kinds(spark, d).select("conv_id", "turn", "kind")


@query(f"SELECT count(*) AS messages, count(*) FILTER ({KIND} = 'correction') AS corrections FROM ({USERS})")
def correction_rate(spark, d):
    k = _kinds(spark, d)
    return k.agg(F.count("*").alias("messages"), F.count_if(F.col("kind") == "correction").alias("corrections"))


@query("SELECT count(*) AS messages, count(*) FILTER (regexp_matches(text, '(?i)^\\s*(accepted|i accept( this result)?|looks good)\\s*[.!]?\\s*$')) AS accepted FROM conversations WHERE role = 'user'")
def acceptance(spark, d):
    users = table(spark, d, "conversations").filter("role = 'user'")
    return users.agg(F.count("*").alias("messages"), F.count_if(classify.is_acceptance(F.col("text"))).alias("accepted"))


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS replies, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def session_rollup(spark, d):
    c = table(spark, d, "conversations")
    role = lambda r: F.count_if(F.col("role") == r)
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), role("user").alias("user_messages"), role("assistant").alias("replies"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT conv_id, count(*) AS kept, sum(least(n, 5000))::BIGINT AS chars FROM (SELECT conv_id, turn, length(text) AS n,
    coalesce(sum(least(length(text), 5000) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS used FROM conversations) WHERE used < 50000 GROUP BY 1""")
def topic_text(spark, d):
    n = F.least(F.length("text"), F.lit(5000))
    used = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1
    kept = table(spark, d, "conversations").withColumn("n", n).withColumn("used", used).filter("used < 50000")
    return kept.groupBy("conv_id").agg(F.count("*").alias("kept"), F.sum("n").alias("chars"))


BUDGET = f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, regexp_matches(text, '{FIX}') AND role = 'user' AS fix FROM conversations),
    n AS (SELECT *, count(*) FILTER (fix) OVER w AS f, count(*) FILTER (role = 'user') OVER b AS u, count(*) FILTER (role = 'assistant') OVER b AS a FROM m
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn), b AS (PARTITION BY conv_id ORDER BY turn DESC)),
    r AS (SELECT *, CASE WHEN place = 1 THEN 1 WHEN fix AND f <= 3 THEN 2 WHEN role = 'user' AND u = 1 THEN 3 WHEN role = 'assistant' AND a = 1 THEN 4 ELSE 6 END AS rank FROM n),
    s AS (SELECT *, 1500 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY rank, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r)
    SELECT conv_id, turn, least(length(text), room)::BIGINT AS kept, length(text) > room AS truncated FROM s WHERE room > 80"""


@query(BUDGET)
def evidence_budget(spark, d):
    """First message, corrections, last user's and last assistant's message, then the rest, within 1,500 characters."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.length("text").alias("n"), F.lit(False).alias("notable"))
    rows = evidence.budgeted(rows, ["conv_id"], ["turn"], 1500).withColumn("cut", F.col("truncated"))
    room = 1500 - F.sum(F.when(~F.col("cut"), F.col("n")).otherwise(0)).over(Window.partitionBy("conv_id"))
    return rows.select("conv_id", "turn", F.when(F.col("cut"), room).otherwise(F.col("n")).cast("long").alias("kept"), F.col("cut").alias("truncated"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def message_dedup(spark, d):
    c = table(spark, d, "conversations").withColumn("h", F.sha2("text", 256))
    return ordered.keep_first(c, ["conv_id", "role", "h"], ["turn"]).select("conv_id", "turn", "role")


@query("""WITH f AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 24)
    SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations SEMI JOIN f USING (conv_id)""")
def family_messages_join(spark, d):
    c = table(spark, d, "conversations")
    top = c.groupBy("conv_id").agg(F.count("*").alias("m")).orderBy(F.desc("m"), "conv_id").limit(24).select("conv_id")
    return c.join(F.broadcast(top), "conv_id", "left_semi").select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query("SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS fingerprint FROM conversations GROUP BY 1")
def candidate_fingerprint(spark, d):
    parts = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("m"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(parts, lambda s: s["m"]), "\n"), 256).alias("fingerprint"))


@query("SELECT l.doc_id FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE n_chars > 100) d ON l.doc_id = d.doc_id")
def ref_integrity_anti(spark, d):
    known = table(spark, d, "documents").filter("n_chars > 100").select("doc_id")
    return table(spark, d, "labels").select("doc_id").join(known, "doc_id", "left_anti")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_except(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("SELECT d.doc_id FROM documents d WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def fingerprint_antijoin(spark, d):
    docs = table(spark, d, "documents").withColumn("fingerprint", F.sha2("text", 256))
    return incremental.misses(docs, docs.filter("lang = 'en'")).select("doc_id")


@query("""SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS first FROM documents) WHERE first = 1) WHERE k <= 2""")
def excerpt_selection(spark, d):
    """Distinct texts first, then at most two of a source, longest first."""
    docs = table(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    once = ordered.keep_first(docs, ["h"], [F.desc("n_chars"), "doc_id"])
    return ordered.top_per_group(once, ["source"], [F.desc("n_chars"), "doc_id"], 2).select("doc_id")
