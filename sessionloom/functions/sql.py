"""The redaction and classification rules as SQL functions, for queries that are written as SQL text.

`register(spark)` makes them known to a session. They are SQL expressions, so Spark inlines them into the plan and keeps them in the JVM. The
patterns and word lists are those of the Column builders, and the results are the same.

    redact(t), local_text(t)          a text without secrets, identity and paths (or with the latter two), squeezed to 600 (800) characters
    stable_id(t, prefix)              a pseudonym
    work_area(t), is_correction(t), is_acceptance(t), failure_cause(t), command_is(t, kind), canonical_tool(t), platform_of(cwd)
    leaks(t, privacy)                 a table function: the kinds of secret that a text still shows, for a lateral join
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from sessionloom.functions import classify, text


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(value: str, *steps: tuple[str, str]) -> str:
    for pattern, put in steps:
        value = f"regexp_replace({value}, {quoted(pattern)}, {quoted(put)})"
    return value


def _blocks(value: str) -> str:
    omitted = " [context omitted] "
    steps = [(text.BLOCKS[1], omitted), *[(text.BLOCKS[0], omitted)] * text.BLOCK_PASSES, (text.OPEN_BLOCK, omitted)]
    return _replaced(value, *steps, (text.FENCE, " [code omitted] "))


SECRETS = ((text.URL_QUERY, "$1?<redacted-query>$2"), (text.BEARER, "Bearer <redacted>"), (text.NAMED_SECRET, "$1=<redacted>"), (text.KNOWN_SECRET, "<redacted-secret>"))
IDENTITY = (
    (text.EMAIL, "<redacted-email>"), (text.UUID, "<id>"), (text.HOME_POSIX, "~"), (text.HOME_DRIVE, "~"), (text.PATH_POSIX, "<path>"), (text.PATH_DRIVE, "<path>"),
)
TOKEN = ((text.LONG_TOKEN, "<redacted-token>"),)


def _hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"(octet_length(t) - octet_length(replace(t, {quoted(w)}, ''))) div {len(w.encode())}" for w in words)


def _work_area() -> str:
    names = [n for n, _ in classify.WORK_AREAS]
    counts = f"array({', '.join(_hits(w) for _, w in classify.WORK_AREAS)})"
    pick = f"CASE WHEN array_max(n) = 0 THEN 'general' ELSE element_at(array({', '.join(map(quoted, names))}), CAST(array_position(n, array_max(n)) AS INT)) END"
    return f"(SELECT {pick} FROM (SELECT {counts} AS n FROM (SELECT coalesce(lower(work_area.t), '') AS t)))"


def statements() -> list[str]:
    """What defines the functions, in an order in which each knows those that it calls."""
    causes = " ".join(f"WHEN t RLIKE {quoted(p)} THEN {quoted(n)}" for n, p in classify.CAUSES)
    commands = " ".join(f"WHEN {quoted(n)} THEN t RLIKE {quoted(p)}" for n, p in classify.COMMANDS.items())
    leaks = [("bearer", text.BEARER), ("named_secret", text.NAMED_SECRET), ("known_secret", text.KNOWN_SECRET), ("long_token", text.LONG_TOKEN)]
    shown = ", ".join(f"CASE WHEN t RLIKE {quoted(p)} THEN {quoted(n)} END" for n, p in leaks)
    paths = ", ".join(f"CASE WHEN privacy = 'redacted' AND t RLIKE {quoted(p)} THEN 'absolute_path' END" for p in (text.PATH_POSIX, text.PATH_DRIVE))
    scalar = {
        "squeezed(t STRING, most INT)": ("STRING", "(SELECT CASE WHEN length(s) <= squeezed.most THEN s ELSE concat(rtrim(substring(s, 1, squeezed.most - 1)), '…') END FROM (SELECT trim(regexp_replace(squeezed.t, '(?U)\\\\s+', ' ')) AS s))"),
        "redact(t STRING)": ("STRING", f"squeezed({_replaced(_blocks('t'), *SECRETS, *IDENTITY, *TOKEN)}, 600)"),
        "local_text(t STRING)": ("STRING", f"squeezed({_replaced(_blocks('t'), *SECRETS, *TOKEN)}, 800)"),
        "stable_id(t STRING, prefix STRING)": ("STRING", "concat(prefix, '-', substring(sha2(t, 256), 1, 12))"),
        "work_area(t STRING)": ("STRING", _work_area()), "is_correction(t STRING)": ("BOOLEAN", f"t RLIKE {quoted(classify.CORRECTION)}"),
        "is_acceptance(t STRING)": ("BOOLEAN", f"t RLIKE {quoted(classify.ACCEPTANCE)}"), "failure_cause(t STRING)": ("STRING", f"CASE {causes} ELSE 'other' END"),
        "command_is(t STRING, kind STRING)": ("BOOLEAN", f"CASE kind {commands} END"), "canonical_tool(t STRING)": ("STRING", "element_at(split(t, '__|\\\\.'), -1)"),
        "platform_of(cwd STRING)": ("STRING", "CASE WHEN trim(cwd) RLIKE '^[A-Za-z]:\\\\\\\\' THEN 'windows' WHEN startswith(trim(cwd), '/Users/') THEN 'macos' WHEN startswith(trim(cwd), '/') THEN 'posix_other' ELSE 'unknown' END"),
    }
    out = [f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}" for head, (kind, body) in scalar.items()]
    found = f"SELECT explode(array_distinct(array_compact(array({shown}, {paths})))) AS kind"
    return [*out, f"CREATE OR REPLACE TEMPORARY FUNCTION leaks(t STRING, privacy STRING) RETURNS TABLE (kind STRING) RETURN {found}"]


def register(spark: SparkSession) -> None:
    for statement in statements():
        spark.sql(statement)
