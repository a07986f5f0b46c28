"""Shared helpers of the training-data operators: table access, scratch tables, sizes, components.

Intermediate tables are written to the shared folder named by ``spark.checkpoint.dir`` and read
back, so that a lost executor costs at most one stage and lineage stays short.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under spark.checkpoint.dir; a temporary folder only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sessionloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Whether Spark drops a query's shuffle files when it has ended; else they stay until the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes from which on a batch of rows for a Python worker is full. A batch lies in the executor's memory beside its heap, twice while it grows, and once more in the worker.
ARROW, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 12 << 20


@contextmanager
def tidy(spark: SparkSession):
    """Queries that run within leave no shuffle files behind, for results that are made once; and Python workers get their rows in small batches."""
    before = {key: spark.conf.get(key) for key in (TIDY, ARROW)}
    spark.conf.set(TIDY, "true")
    spark.conf.set(ARROW, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back."""
    path = scratch_path(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a plan (file bytes, scaled by the columns that are read); 0 if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def parts_for(df: DataFrame, each: int = 64 << 20) -> int:
    """Shuffle partitions: the session's number, more when the input is larger than that many shares."""
    spark = df.sparkSession
    want = -(-min(plan_bytes(df), 1 << 50) // each)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), want)


def slot_bitmap(keys: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of 2**bits slots (fixed size), set where the top bits of a 64-bit key occur."""
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = (
        keys.select(F.shiftright(slot, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int")).alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    import numpy as np

    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    with tidy(keys.sparkSession):
        found = words.toArrow()  # at most 2**(bits - 5) rows, whatever the input; as columns, 16 bytes each
    out[found["w"].to_numpy()] = found["b"].to_numpy().astype(np.uint32)
    return out.tobytes()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b); label is the smallest node that can be reached.

    Alternates the large-star and the small-star step until nothing changes, which a count and a sum of
    hashes of the edges tell; the rounds grow with the logarithm of the longest chain. Each step is one
    min per node (combined before the shuffle) and one join, so a node with very many
    neighbours is never gathered in a task.
    """
    cur = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low2, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").filter("a <> b").distinct()
        )
        cur = written(small, "edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("label"))
