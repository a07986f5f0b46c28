"""Overlap and concurrency of intervals by a sweep in two phases: no pair is built, no global window over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sweep(intervals: DataFrame, id_col: str, start: str, end: str, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Edges of intervals(id, start, end in microseconds) with `active`, the intervals open before each.

    Ends come before starts at equal times; empty intervals are left out. Net changes are summed by
    time bucket, carried over the (few) buckets, and counted on inside each bucket.
    """
    rows = intervals.filter(F.col(start) < F.col(end))
    edges = rows.select(F.col(id_col).alias("id"), F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    edges = edges.select("id", "e.t", "e.d", F.floor(F.col("e.t") / bucket_us).alias("bucket"))
    net = edges.groupBy("bucket").agg(F.sum("d").alias("net"))
    carry = net.select("bucket", F.coalesce(F.sum("net").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"))
    w = Window.partitionBy("bucket").orderBy("t", "d", "id").rowsBetween(Window.unboundedPreceding, -1)
    return edges.join(carry, "bucket").withColumn("active", F.col("carry") + F.coalesce(F.sum("d").over(w), F.lit(0)))


def concurrency(intervals: DataFrame, id_col: str, start: str, end: str, bucket_us: int = 3_600_000_000) -> DataFrame:
    """One row: overlapping pairs and the largest number of intervals open at once."""
    edges = sweep(intervals, id_col, start, end, bucket_us).filter("d = 1")
    return edges.agg(F.coalesce(F.sum("active"), F.lit(0)).cast("long").alias("overlap_pairs"), F.coalesce(F.max(F.col("active") + 1), F.lit(0)).cast("long").alias("max_concurrency"))


def overlapping(intervals: DataFrame, id_col: str, start: str, end: str, bucket_us: int = 3_600_000_000) -> DataFrame:
    """The ids of intervals that overlap any other.

    An interval does if another is open when it starts, or if another starts before it ends: the next start is the
    first later one of its bucket, or of the buckets after it.
    """
    rows = intervals.filter(F.col(start) < F.col(end)).select(F.col(id_col).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"), F.floor(F.col(start) / bucket_us).alias("bucket"))
    open_ = sweep(intervals, id_col, start, end, bucket_us).filter("d = 1 AND active > 0").select("id")
    firsts = rows.groupBy("bucket").agg(F.min("s").alias("s"))
    after = firsts.select("bucket", F.min("s").over(Window.orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    following = F.lead("s").over(Window.partitionBy("bucket").orderBy("s", "id"))
    nexts = rows.withColumn("near", following).join(after, "bucket").filter(F.coalesce("near", "later") < F.col("e")).select("id")
    return open_.union(nexts).distinct()
