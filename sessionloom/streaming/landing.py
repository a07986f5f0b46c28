"""Landing of session logs: a stream of log files into stored tables, in batches that may come again.

    lines     every line, accepted or with the reason against it, by created_date (of its session's header) and batch
    sessions  the folded sessions of a batch's files, by batch
    coverage  what a batch read and left out, by batch

A file that comes again (it has grown, or its batch is repeated) comes whole, so only the sessions of a batch's files
are folded, and the latest batch that has a path holds that session. A batch overwrites its own partitions only: repeated, it leaves
the same tables. Readers take the batches that are done, those with a row in coverage, which is written last.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sessionloom.sessions import fold
from sessionloom.sources import log_source
from sessionloom.sources.session_logs import classified, json_number

#: Unknown types that a batch's coverage names, the commonest first; their counts are exact up to about as many different ones.
NAMED = 1_000


def observed(raw: DataFrame) -> tuple[DataFrame, Observation]:
    """The classified lines of raw, and what an observation of them tells once they have been written: no second pass.

    Numbers: files, records, unreadable_files, malformed_lines, unknown_records, early_records, later_headers, without_header (lines), and unknown_types by name.
    """
    told = Observation("ingest")
    rows = classified(raw)
    has = lambda reason: F.count_if(F.col("reason") == reason)
    first = F.col("first") & (F.col("seq") == F.col("first_seq"))
    rows = rows.withColumns({"first": F.lit(True), "first_seq": F.min("seq").over(Window.partitionBy("path"))})
    rows = rows.observe(
        told, F.count_if(first).alias("files"), F.count_if(F.col("reason").isNull()).alias("records"), has("unreadable").alias("unreadable_files"), has("malformed").alias("malformed_lines"),
        has("unknown").alias("unknown_records"), has("early").alias("early_records"), has("later_header").alias("later_headers"),
        F.count_if(first & F.col("header").isNull() & (F.col("reason") != "unreadable")).alias("without_header"),
        F.expr(f"approx_top_k(CASE WHEN reason = 'unknown' THEN type END, {NAMED})").alias("unknown_types"),
    )
    return rows.drop("first", "first_seq"), told


def with_created(rows: DataFrame) -> DataFrame:
    """Adds created_date, the day of a session's creation (null: unknown), to classified lines."""
    here = Window.partitionBy("path")
    named = F.max(F.when((F.col("type") == "session") & (F.col("seq") == F.col("header")), json_number(F.try_parse_json("data"), "$.createdAt"))).over(here)
    early = F.min_by(F.col("time"), F.when((F.col("seq") < F.col("header")) & F.col("time").isNotNull() & F.col("reason").isNull(), F.col("seq"))).over(here)
    return rows.withColumn("created_date", F.to_date(F.timestamp_millis(F.coalesce(named, early).cast("long"))))


def land_batch(raw: DataFrame, root: str, batch: int, **names) -> dict:
    """Lands the lines of some files as batch number `batch`; gives its coverage. names: those of fold.fold_sessions."""
    spark, base = raw.sparkSession, root.rstrip("/")
    rows, told = observed(raw)
    lines = with_created(rows).select("path", "seq", "type", "time", "data", "reason", "created_date", F.lit(batch).cast("long").alias("batch"))
    # sessions without a date have a partition of their own; a batch's partitions are replaced, others stay
    put = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{base}/{name}")
    put(lines, "lines", "batch", "created_date")
    landed = spark.read.schema(lines.schema).parquet(f"{base}/lines").filter(F.col("batch") == batch)
    records = landed.filter("reason IS NULL").select("path", "seq", "type", "time", "data")
    put(fold.fold_sessions(records, **names).withColumn("batch", F.lit(batch).cast("long")), "sessions", "batch")
    seen = told.get
    seen["unknown_types"] = {x["item"]: x["count"] for x in seen["unknown_types"] or [] if x["item"] is not None}
    schema = ", ".join(f"{k} {'map<string,long>' if k == 'unknown_types' else 'long'}" for k in seen) + ", batch long"
    put(spark.createDataFrame([(*seen.values(), batch)], schema), "coverage", "batch")
    return seen


def land(spark: SparkSession, source: str, root: str, checkpoint: str, **names) -> StreamingQuery:
    """Lands all log files under source that are new or have changed, then stops; started again, it goes on where it ended."""
    log_source.register(spark)
    lines = spark.readStream.format("session_logs").load(source)

    def step(batch: DataFrame, number: int) -> None:
        land_batch(batch, root, number, **names)

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def coverage(spark: SparkSession, root: str) -> DataFrame:
    """What each batch that is done read and left out."""
    return _table(spark, root, "coverage")


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """The landed sessions, each as its latest batch has it."""
    done = coverage(spark, root).select("batch")
    rows = _table(spark, root, "sessions").join(done, "batch", "left_semi")
    latest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["path", "batch"], "left_semi").drop("batch")


def records(spark: SparkSession, root: str, since: datetime, until: datetime) -> DataFrame:
    """(path, seq, type, time, data) of the sessions created in a range, both ends included.

    The folded sessions tell which those are; lines are stored by batch and day, and partitions that hold none of them are
    pruned at run time by the days and batches that the filter on the sessions leaves.
    """
    lo, hi = (m.timestamp() * 1000 for m in (since, until))
    done = coverage(spark, root).select("batch")
    heads = _table(spark, root, "sessions").join(done, "batch", "left_semi").groupBy("path").agg(F.max_by(F.struct("batch", "created_ms"), "batch").alias("h"))
    heads = heads.select("path", "h.batch", "h.created_ms").filter((F.col("created_ms") >= lo) & (F.col("created_ms") <= hi))
    heads = heads.select("path", "batch", F.to_date(F.timestamp_millis(F.col("created_ms").cast("long"))).alias("created_date"))
    lines = _table(spark, root, "lines").filter("reason IS NULL")
    return lines.join(heads, ["batch", "created_date", "path"]).select("path", "seq", "type", "time", "data")


def rejected(spark: SparkSession, root: str) -> DataFrame:
    """(path, seq, type, reason) of lines that were not taken, of each file as its latest batch has it."""
    rows = _table(spark, root, "lines").join(coverage(spark, root).select("batch"), "batch", "left_semi")
    latest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.filter("reason IS NOT NULL").join(latest, ["path", "batch"], "left_semi").select("path", "seq", "type", "reason")
