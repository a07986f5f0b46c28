"""Session logs: compressed JSON lines, one file per session, as a table of typed records.

A file is decoded as a stream, one line after the other, so a very long session never lies in memory as a
whole. Files are distributed by Spark; the order inside a file is kept as `seq`.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import sound_json

#: The record types of session logs.
KNOWN_TYPES = (
    "session", "permission/preset", "sandbox/mode", "approval/policy", "session/end-seed", "agent/inbox/spliced", "turn/start", "turn/end",
    "step/start", "step/end", "user/message", "assistant/message", "assistant/chunk", "tool/call", "tool/result", "request/header",
    "request/context", "approval/asked", "approval/decided", "llm/retry", "llm/retry-started", "todo/write", "session/title",
    "session/title-llm-request", "plan/mode", "command/run", "command/done", "agent-preset/selected", "subagent/descriptor", "goal/change",
    "web/deepseek-search-llm-request", "reasoning-chunks", "tool-call-chunks", "text-chunks",
)
#: Known records before the header that are kept, at most.
BEFORE_HEADER = 50
#: Lines of one batch.
BATCH_LINES = 4_096

RAW = "path string, seq long, value string, readable boolean"


def _lines(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    import zstandard

    def stream():
        reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True)
        return io.TextIOWrapper(reader, encoding="utf-8", errors="replace", newline="\n")

    def batch(first: int, values: list, readable: bool) -> pd.DataFrame:
        return pd.DataFrame({"path": path, "seq": range(first, first + len(values)), "value": values, "readable": readable})

    try:  # a damaged file is left out whole, so it is read through before its first line is given out
        for _ in stream():
            pass
    except zstandard.ZstdError:
        yield batch(0, [None], False)
        return
    seq, kept = 0, []
    for line in stream():
        kept.append(line.rstrip("\r\n"))
        if len(kept) == BATCH_LINES:
            yield batch(seq, kept, True)
            seq, kept = seq + len(kept), []
    if kept:
        yield batch(seq, kept, True)


def read_session_logs(spark: SparkSession, root: str, pattern: str = "session.jsonl.zst*") -> DataFrame:
    """path, seq, value, readable of all lines under root; a file that cannot be decoded gives one row, readable false."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                yield from _lines(path, content)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "content").mapInPandas(decode, RAW)


def json_kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, a number's type, or null, of a VARIANT."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def json_number(value: Column, path: str) -> Column:
    """The number at a path of a VARIANT; texts and booleans are none."""
    part = F.try_variant_get(value, path, "variant")
    return F.when(~json_kind(part).isin("STRING", "BOOLEAN", "OBJECT", "ARRAY", "VOID"), F.try_variant_get(value, path, "double"))


def classified(raw: DataFrame) -> DataFrame:
    """The lines of raw with type, time (epoch milliseconds), data (JSON), header (place of their session's) and reason, null for records.

    Blank lines are skipped. Reasons: unreadable (file), malformed (no JSON object, or a record after the header whose
    data is none), unknown (type, '<missing>' for a blank one), no_header (the file has no session record), early (a
    record too far before the header) and later_header. Times that are no numbers are null.
    """
    lines = raw.filter("NOT readable OR trim(value) <> ''").withColumn("value", sound_json(F.col("value"))).withColumn("v", F.try_parse_json("value"))
    # objects with a key twice are no VARIANT, but JSON still
    loose = lambda path: F.when(F.col("v").isNull(), F.get_json_object("value", path))
    kind = F.coalesce(F.nullif(F.coalesce(F.try_variant_get("v", "$.type", "string"), loose("$.type")), F.lit("")), F.lit("<missing>"))
    is_object = F.coalesce(json_kind(F.col("v")) == "OBJECT", loose("$").startswith("{"), F.lit(False))
    time = F.coalesce(json_number(F.col("v"), "$.time"), loose("$.time").try_cast("double"))
    rows = lines.withColumns({"ok": is_object, "type": kind, "time": time})
    has_data = F.coalesce(json_kind(F.try_variant_get("v", "$.data", "variant")) == "OBJECT", loose("$.data").startswith("{"), F.lit(False))
    # the header record has its fields beside its type; all others have them in `data`
    data = F.when(F.col("type") == "session", F.col("value")).when(has_data, F.get_json_object("value", "$.data"))
    rows = rows.withColumn("data", data).withColumn("known", F.col("ok") & F.col("type").isin(*KNOWN_TYPES)).drop("v")
    rows = rows.withColumn("header", F.min(F.when(F.col("known") & (F.col("type") == "session"), F.col("seq"))).over(Window.partitionBy("path")))
    place = F.sum(F.col("known").cast("int")).over(Window.partitionBy("path").orderBy("seq"))
    rows = rows.withColumn("place", place)
    reason = (
        F.when(~F.col("readable"), "unreadable").when(~F.col("ok"), "malformed").when(~F.col("known"), "unknown")
        .when(F.col("header").isNull(), "no_header").when((F.col("seq") < F.col("header")) & (F.col("place") > BEFORE_HEADER), "early")
        .when((F.col("type") == "session") & (F.col("seq") > F.col("header")), "later_header")
        .when(F.col("data").isNull() & (F.col("seq") > F.col("header")), "malformed")
    )
    return rows.withColumn("reason", reason)


def normalise_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, bad): path, seq, type, time and data of the records; path, seq, type and reason of the other lines (see `classified`)."""
    rows = classified(raw)
    records = rows.filter("reason IS NULL").select("path", "seq", "type", "time", "data")
    return records, rows.filter("reason IS NOT NULL").select("path", "seq", "type", "reason")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The raw lines of snapshots {session, events}, one a line: the header first, then the events in order.

    A snapshot may stand in an envelope {kind: session, snapshot}; a request line {schema, operation} is passed over.
    Anything else gives one row that is not readable. The path tells the file and the session.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter("trim(value) <> ''")
    part = lambda p: F.get_json_object("value", p)
    lines = lines.filter(~(part("$.schema").isNotNull() & part("$.operation").isNotNull()))
    inner = F.when(part("$.kind") == "session", part("$.snapshot")).otherwise(F.col("value"))
    both = lines.withColumn("s", inner).withColumns({"header": F.get_json_object("s", "$.session"), "events": F.from_json(F.get_json_object("s", "$.events"), "array<string>")})
    good = F.coalesce(F.col("header").startswith("{"), F.lit(False)) & F.col("events").isNotNull()
    name = F.coalesce(F.nullif(F.get_json_object("header", "$.id"), F.lit("")), F.sha1("value"))
    head = F.when(F.col("header") == "{}", '{"type":"session"}').otherwise(F.concat(F.lit('{"type":"session",'), F.expr("substring(header, 2)")))
    rows = F.when(good, F.concat(F.array(head), F.col("events"))).otherwise(F.array(F.lit(None).cast("string")))
    return both.select(F.concat("file", F.lit("#"), name).alias("path"), good.alias("readable"), F.posexplode(rows).alias("seq", "value")).select(
        "path", F.col("seq").cast("long").alias("seq"), "value", "readable"
    )


def call_id(data: Column) -> Column:
    """The call of a result: its own id, else that of the message's source, else of the first content item that has one; '' if none."""
    some = lambda path: F.nullif(F.get_json_object(data, path), F.lit(""))
    items = F.from_json(F.get_json_object(data, "$.message.content"), "array<struct<toolCallId: string>>")
    ids = F.filter(F.transform(items, lambda x: x["toolCallId"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(some("$.callId"), some("$.message.source.callId"), F.get(ids, 0), F.lit(""))


def write_report(df: DataFrame, path: str, source_root: str) -> None:
    """Writes a report table as JSON; a place under the source folder is refused."""
    if f"{path.rstrip('/')}/".startswith(f"{source_root.rstrip('/')}/"):
        raise ValueError("a report is not written under its source folder")
    df.write.json(path)


def write_batches(df: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Evidence packs, one folder a batch."""
    df.write.partitionBy(batch).json(path)
