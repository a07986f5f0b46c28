"""Registration of queries with their SQL, and the driver tables in the vocabulary of session logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query (spark, sf_dir) under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session = user_id; view, click: calls; purchase: successful state change; error: failed result; signup: turn start."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").withColumns({"us": us, "k": k, "cents": F.round(F.col("value") * 100).cast("long")})


#: The same columns in DuckDB.
EVENTS = "(SELECT *, epoch_us(ts) AS us, json_extract_string(props, '$.k')::BIGINT AS k, round(value * 100)::BIGINT AS cents FROM events) e"
ORDER = ["us", "event_id"]
