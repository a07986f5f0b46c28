"""Incremental refresh by content fingerprint: unchanged rows are kept, the others are parsed again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_fingerprint(df: DataFrame, columns: list[str], contract: str = "") -> DataFrame:
    """Adds a SHA-256 of the columns (and of the parser's contract, where there is one)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.withColumn("fingerprint", F.sha2(F.concat_ws("|", *parts, *([F.lit(contract)] if contract else [])), 256))


def refresh(current: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """current with `status`: hit (same key and fingerprint), invalid (same key only) or miss."""
    have = known.select(key, F.col("fingerprint").alias("__had"))
    status = F.when(F.col("__had").isNull(), "miss").when(F.col("__had") == F.col("fingerprint"), "hit").otherwise("invalid")
    return current.join(have, key, "left").withColumn("status", status).drop("__had")


def misses(current: DataFrame, known: DataFrame) -> DataFrame:
    return current.join(known.select("fingerprint"), "fingerprint", "left_anti")


def is_storage_error(e: Exception) -> bool:
    """Whether a write failed at the storage (no space, no permission, lost), by the exceptions that Hadoop's file systems raise."""
    return any(name in str(e) for name in ("java.io.", "java.nio.file.", "org.apache.hadoop.fs.", "AccessControlException", "TASK_WRITE_FAILED"))


def refresh_table(current: DataFrame, stored: str, parse: Callable[[DataFrame], DataFrame], scratch: str, key: str = "path", parts: int = 64) -> dict[str, int]:
    """Brings a stored table up to date with current(key, fingerprint, ...); returns hits, misses, invalid, removed and write_errors.

    parse gives the rows (with the key) of the entries of current that are new or changed; the others keep theirs. The table is
    partitioned by a hash of the key, and only partitions with a change are written: first to a folder of their own under
    scratch, then over the old ones. Where the storage refuses the write (write_errors), each partition is the old one or the new one, whole, and the
    next refresh goes on from there; other errors are raised. Null keys take no part.
    """
    spark = current.sparkSession
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")
    current = current.filter(F.col(key).isNotNull())
    try:
        old = spark.read.parquet(stored)
        known = old.select(key, "fingerprint").distinct()
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old, known = None, spark.createDataFrame([], current.select(key, "fingerprint").schema)
    told = refresh(current.select(key, "fingerprint"), known, key)
    gone = known.join(current.select(key), key, "left_anti").select(key, "fingerprint", F.lit("removed").alias("status"))
    counts = {r["status"]: r["count"] for r in told.unionByName(gone).groupBy("status").count().collect()}
    out = {"hits": counts.get("hit", 0), "misses": counts.get("miss", 0), "invalid": counts.get("invalid", 0), "removed": counts.get("removed", 0), "write_errors": 0}
    changed = told.filter("status <> 'hit'")
    touched = [r["part"] for r in changed.unionByName(gone).select(part.alias("part")).distinct().collect()]  # at most `parts`
    if not touched:
        return out
    rows = parse(current.join(changed.select(key), key, "left_semi")).join(changed.select(key, "fingerprint"), key).withColumn("part", part)
    if old is not None:
        kept = told.filter("status = 'hit'").select(key)
        rows = rows.unionByName(old.filter(F.col("part").isin(touched)).join(kept, key, "left_semi"))
    staged = f"{scratch.rstrip('/')}/refresh-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    fresh = spark.read.schema(rows.schema).parquet(staged)
    # a partition that has lost its last row is overwritten by nothing, so a row without a key stands in for it
    empty = spark.createDataFrame([(p,) for p in touched], "part int")
    full = fresh.unionByName(empty.join(fresh.select("part").distinct(), "part", "left_anti"), allowMissingColumns=True)
    try:
        full.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("part").parquet(stored)
    except Exception as e:
        if not is_storage_error(e):
            raise
        out["write_errors"] = 1
    return out


def stored_rows(spark, stored: str, key: str = "path") -> DataFrame:
    """The rows of a table of refresh_table."""
    return spark.read.parquet(stored).filter(F.col(key).isNotNull()).drop("part", "fingerprint")
