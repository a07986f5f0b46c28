"""Queries over events: as-of pairing, retries, latencies, concurrency, signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions import classify, tools
from sessionloom.operators import intervals, ordered, rollups
from sessionloom.plans.registry import EVENTS, ORDER, events, query, table

KINDS = ("view", "click", "purchase", "error", "signup")
W = "PARTITION BY user_id ORDER BY us, event_id"
WK = "PARTITION BY user_id, k ORDER BY us, event_id"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _is(kind: str):
    return F.col("event_type") == kind


@query(f"SELECT event_type, count(k) AS parsed, count(*) - count(k) AS malformed, sum(k)::BIGINT AS sum_k FROM {EVENTS} GROUP BY 1")
def json_parse_props(spark, d):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").withColumn("v", v).groupBy("event_type").agg(
        F.count("v").alias("parsed"), F.count_if(F.col("v").isNull()).alias("malformed"), F.sum("v").alias("sum_k")
    )


@query("SELECT CASE WHEN coalesce(event_type, '') = '' THEN '<missing>' ELSE event_type END AS kind, count(*) AS n FROM events WHERE coalesce(event_type, '') NOT IN ('view', 'click') GROUP BY 1")
def unknown_type_counts(spark, d):
    kind = F.coalesce(F.nullif("event_type", F.lit("")), F.lit("<missing>"))
    return table(spark, d, "events").filter(~kind.isin("view", "click")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-10 23:59:59.999999'")
def window_filter(spark, d):
    lo, hi = "timestamp_ntz'2024-01-02 00:00:00'", "timestamp_ntz'2024-01-10 23:59:59.999999'"
    return table(spark, d, "events").filter(f"ts BETWEEN {lo} AND {hi}").select("event_id", "user_id")


@query("SELECT CASE WHEN ts IS NULL THEN 'missing_metadata' WHEN ts < TIMESTAMP '2024-01-02' THEN 'outside_window' WHEN user_id % 7 = 0 THEN 'other_project' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY 1")
def skip_reason_counts(spark, d):
    reason = (
        F.when(F.col("ts").isNull(), "missing_metadata").when(F.expr("ts < timestamp_ntz'2024-01-02 00:00:00'"), "outside_window")
        .when(F.col("user_id") % 7 == 0, "other_project").otherwise("kept")
    )
    return table(spark, d, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT event_id, call_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER ({WK} {BEFORE}) AS call_id FROM {EVENTS}) WHERE event_type = 'error'")
def asof_call_result(spark, d):
    paired = ordered.pair_latest(events(spark, d), ["user_id", "k"], ORDER, _is("view"), F.col("event_id"), "call_id")
    return paired.filter(_is("error")).select("event_id", "call_id")


@query(f"SELECT event_id, asked_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER ({W} {BEFORE}) AS asked_id FROM {EVENTS}) WHERE event_type = 'purchase'")
def asof_approval(spark, d):
    paired = ordered.pair_latest(events(spark, d), ["user_id"], ORDER, _is("click"), F.col("event_id"), "asked_id")
    return paired.filter(_is("purchase")).select("event_id", "asked_id")


@query(f"SELECT event_id, coalesce(sum((event_type = 'purchase')::INT) OVER ({W} {BEFORE}), 0)::BIGINT AS epoch FROM {EVENTS}")
def state_epoch(spark, d):
    return ordered.state_epoch(events(spark, d), ["user_id"], ORDER, _is("purchase")).select("event_id", "epoch")


RETRY_SQL = f"""
    WITH a AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER ({W} {BEFORE}), 0) AS epoch FROM {EVENTS}),
    b AS (SELECT *, count(CASE WHEN event_type IN ('view', 'click') THEN 1 END) OVER ({WK} {BEFORE}) AS seen,
                 last_value(CASE WHEN event_type = 'error' THEN epoch END IGNORE NULLS) OVER ({WK} {BEFORE}) AS failed_at FROM a)
    SELECT event_id, CASE WHEN event_type = 'click' AND seen > 0 THEN 'polling' WHEN failed_at IS NULL THEN 'none'
                          WHEN epoch > failed_at THEN 'after_state_change' ELSE 'unchanged' END AS retry
    FROM b WHERE event_type IN ('view', 'click')"""


@query(RETRY_SQL)
def retry_classification(spark, d):
    calls = F.col("event_type").isin("view", "click")
    return ordered.classify_retries(events(spark, d), ["user_id"], "k", ORDER, calls, _is("click"), _is("error"), _is("purchase")).select("event_id", "retry")


@query(f"""
    WITH a AS (SELECT *, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER ({W} {BEFORE}) AS g FROM {EVENTS}),
    b AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN us END IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY us, event_id {BEFORE}) AS s FROM a)
    SELECT event_id, greatest(us - s, 0)::BIGINT AS micros FROM b WHERE event_type = 'purchase' AND s IS NOT NULL""")
def turn_durations(spark, d):
    turns = ordered.turn_durations(events(spark, d), ["user_id"], ORDER, "ts", _is("signup"), _is("purchase"))
    return turns.select("event_id", F.round(F.col("seconds") * 1e6).cast("long").alias("micros"))


@query(f"""
    WITH a AS (SELECT *, count(CASE WHEN event_type = 'click' THEN 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM {EVENTS}),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id, run, event_type ORDER BY us, event_id) AS n,
                 min(CASE WHEN event_type = 'click' THEN us END) OVER (PARTITION BY user_id, run) AS asked FROM a WHERE run > 0)
    SELECT event_id, (us - asked)::BIGINT AS micros FROM b WHERE event_type = 'view' AND n = 1""")
def assistant_latency(spark, d):
    first = ordered.first_reply(events(spark, d), ["user_id"], ORDER, "ts", _is("click"), _is("view"))
    return first.select("event_id", F.round(F.col("seconds") * 1e6).cast("long").alias("micros"))


@query(f"SELECT event_id, (us - prior)::BIGINT AS micros FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN us END IGNORE NULLS) OVER ({W} {BEFORE}) AS prior FROM {EVENTS}) WHERE event_type = 'click' AND us >= prior")
def user_response(spark, d):
    e = ordered.pair_latest(events(spark, d), ["user_id"], ORDER, _is("view"), F.col("us"), "prior")
    return e.filter(_is("click") & (F.col("us") >= F.col("prior"))).select("event_id", (F.col("us") - F.col("prior")).alias("micros"))


@query(f"SELECT user_id, min(us)::BIGINT AS first_us, max(us)::BIGINT AS last_us FROM {EVENTS} GROUP BY 1")
def observed_span(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def _spans(spark, d):
    return events(spark, d).select("event_id", "us", (F.col("us") + F.col("cents") * 10_000_000).alias("end_us"))


SPANS = f"(SELECT event_id, us AS s, us + cents * 10000000 AS e FROM {EVENTS} WHERE cents > 0)"


@query(f"SELECT count(*)::BIGINT AS overlap_pairs FROM {SPANS} a JOIN {SPANS} b ON a.event_id < b.event_id AND a.s < b.e AND b.s < a.e")
def overlap_pairs(spark, d):
    return intervals.concurrency(_spans(spark, d), "event_id", "us", "end_us").select("overlap_pairs")


@query(f"""WITH x AS (SELECT s AS t, 1 AS d, event_id FROM {SPANS} UNION ALL SELECT e, -1, event_id FROM {SPANS})
    SELECT max(n)::BIGINT AS max_concurrency FROM (SELECT sum(d) OVER (ORDER BY t, d, event_id ROWS UNBOUNDED PRECEDING) AS n FROM x)""")
def max_concurrency(spark, d):
    return intervals.concurrency(_spans(spark, d), "event_id", "us", "end_us").select("max_concurrency")


@query(f"""SELECT user_id, count(*) AS n, count(*) FILTER (touches) AS overlapping FROM (
    SELECT user_id, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, event_id {BEFORE}) > s, false)
                 OR coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) < e, false) AS touches
    FROM (SELECT user_id, event_id, us AS s, us + cents * 10000000 AS e FROM {EVENTS} WHERE cents > 0)) GROUP BY 1""")
def overlapping_sessions(spark, d):
    s = events(spark, d).filter("cents > 0").withColumn("e", F.col("us") + F.col("cents") * 10_000_000)
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)) > F.col("us")
    touches = F.coalesce(before, F.lit(False)) | F.coalesce(F.lead("us").over(w) < F.col("e"), F.lit(False))
    return s.select("user_id", touches.alias("t")).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("t").alias("overlapping"))


@query(f"SELECT count(*) AS events, count(DISTINCT user_id) AS sessions, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type IN ('view', 'click')) AS calls, sum(cents)::BIGINT AS cents FROM {EVENTS}")
def totals(spark, d):
    return events(spark, d).agg(
        F.count("*").alias("events"), F.countDistinct("user_id").alias("sessions"), F.count_if(_is("error")).alias("failures"),
        F.count_if(F.col("event_type").isin("view", "click")).alias("calls"), F.sum("cents").alias("cents"),
    )


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top_event_types(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(12)


@query("SELECT h::BIGINT AS hour, count(ts) AS n FROM range(24) r(h) LEFT JOIN events ON hour(ts) = h GROUP BY 1")
def hour_histogram(spark, d):
    return rollups.histogram(table(spark, d, "events"), F.hour("ts"), 24, "hour")


@query("SELECT w::BIGINT AS weekday, count(ts) AS n FROM range(7) r(w) LEFT JOIN events ON isodow(ts) - 1 = w GROUP BY 1")
def weekday_histogram(spark, d):
    return rollups.histogram(table(spark, d, "events"), F.weekday("ts"), 7, "weekday")


PER_USER = """SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'click') AS polling,
    count(*) FILTER (event_type = 'purchase') AS changes, count(*) FILTER (event_type = 'signup') AS turns, count(*) FILTER (event_type = 'view') AS calls FROM events GROUP BY 1"""


def _per_user(spark, d):
    names = {"failures": "error", "polling": "click", "changes": "purchase", "turns": "signup", "calls": "view"}
    return table(spark, d, "events").groupBy("user_id").agg(*[F.count_if(_is(t)).alias(n) for n, t in names.items()])


@query(f"SELECT user_id, CASE WHEN turns > changes THEN 'partial' WHEN failures > changes THEN 'aborted' ELSE 'completed' END AS status FROM ({PER_USER})")
def session_status(spark, d):
    status = F.when(F.col("turns") > F.col("changes"), "partial").when(F.col("failures") > F.col("changes"), "aborted").otherwise("completed")
    return _per_user(spark, d).select("user_id", status.alias("status"))


@query(f"SELECT user_id, CASE WHEN turns <= 1 AND calls <= 2 AND failures < 2 THEN 'quick_check' WHEN failures > 3 THEN 'multi_agent' WHEN changes > 3 THEN 'implementation' WHEN polling > 3 THEN 'research' WHEN calls >= 10 THEN 'tool_driven' ELSE 'conversation' END AS kind FROM ({PER_USER})")
def session_type(spark, d):
    """Failures stand in for agents (beyond three) and for minutes; changes and polling for patches and searches (beyond three)."""
    c = {n: F.col(n) for n in ("turns", "calls", "changes", "polling", "failures")}
    kind = classify.session_type(c["turns"], c["calls"], c["changes"] - 3, c["polling"] - 3, c["failures"] - 3, c["failures"])
    return _per_user(spark, d).select("user_id", kind.alias("kind"))


@query("""SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k
    FROM events GROUP BY 1, 2) WHERE k = 1""")
def dominant_model(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return ordered.top_per_group(n, ["user_id"], [F.desc("n"), "event_type"], 1).drop("rank")


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, count(DISTINCT props) AS props FROM events")
def distinct_counts(spark, d):
    return table(spark, d, "events").agg(*[F.countDistinct(c).alias(n) for c, n in (("user_id", "users"), ("event_type", "kinds"), ("props", "props"))])


@query(f"SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase' AND k % 2 = 0) AS accepted, max(cents)::BIGINT AS peak FROM {EVENTS} GROUP BY 1")
def running_max_counters(spark, d):
    return events(spark, d).groupBy("user_id").agg(
        F.count_if(_is("error")).alias("failed"), F.count_if(_is("purchase") & (F.col("k") % 2 == 0)).alias("accepted"), F.max("cents").alias("peak")
    )


@query("SELECT event_type, count(*) FILTER (event_type = 'purchase') AS verified, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def verification_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(_is("purchase")).alias("verified"), F.count_if(_is("error")).alias("failed"))


@query("SELECT event_id, sha256(event_type || chr(0) || '{\"a\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}') AS fingerprint FROM events")
def call_fingerprint(spark, d):
    """Arguments with keys out of order, one of which only concerns the transport."""
    args = F.to_json(F.struct(F.col("k"), F.col("event_type").alias("justification"), F.col("event_id").alias("a")))
    return events(spark, d).select("event_id", tools.call_fingerprint(F.col("event_type"), args).alias("fingerprint"))


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2")
def model_usage(spark, d):
    e = table(spark, d, "events")
    parts = [e.filter(_is(t)).select("user_id", "event_type") for t in ("view", "click", "purchase")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
