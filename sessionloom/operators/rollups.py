"""Aggregations of sessions and events: signals, histograms, ranks, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_signals(df: DataFrame, names: list[str]) -> DataFrame:
    """signal, total, affected of per-session counters; signals that never occur are dropped."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).cast("long").alias("n")) for n in names])).alias("s")).select("s.*")
    return long.groupBy("signal").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("affected")).filter("total > 0")


def histogram(df: DataFrame, value: Column, size: int, name: str) -> DataFrame:
    """Counts of the values 0 .. size-1, with zeros for those that are absent."""
    counts = df.groupBy(value.cast("long").alias(name)).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(size).withColumnRenamed("id", name)
    return every.join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def nearest_rank(c: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def token_projection(uncached: Column, cache_read: Column, cache_write: Column, output: Column) -> dict[str, Column]:
    """Input counts cached reads; the total adds cache writes and output."""
    return {"input_tokens": uncached + cache_read, "cached_input_tokens": cache_read, "output_tokens": output, "total_tokens": uncached + cache_read + cache_write + output}
