"""Order-sensitive operators inside a session: as-of pairing, retries, turns, latencies. Window functions only.

Every function takes the columns that name the session and the order, so that all of them share one
partitioning: Spark plans one exchange for a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _so_far(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def pair_latest(df: DataFrame, keys: list[str], order: list[str], is_call: Column, value: Column, name: str) -> DataFrame:
    """Adds the value of the latest earlier call with the same keys (null: none)."""
    return df.withColumn(name, F.last(F.when(is_call, value), ignorenulls=True).over(_before(keys, order)))


def state_epoch(df: DataFrame, session: list[str], order: list[str], changed: Column, name: str = "epoch") -> DataFrame:
    """Adds the number of successful state changes before each row."""
    return df.withColumn(name, F.coalesce(F.sum(changed.cast("long")).over(_before(session, order)), F.lit(0).cast("long")))


def classify_retries(
    df: DataFrame, session: list[str], fingerprint: str, order: list[str], is_call: Column, polling: Column, failed: Column, changed: Column,
    mode: str | None = None, keep_all: bool = False,
) -> DataFrame:
    """Calls with `retry`: polling for a repeated polling call; else, after an earlier failure of the same
    fingerprint, after_state_change if a state change succeeded since or (where one is named) the mode of
    approval is another, or unchanged; else none.

    A failure keeps the epoch before its own result, and the mode of its call. keep_all: other rows stay, with a null retry.
    """
    df = state_epoch(df, session, order, changed)
    keys = [*session, fingerprint]
    about = F.struct("epoch", (F.col(mode) if mode else F.lit("")).alias("mode"))
    df = df.withColumn("__seen", F.count(F.when(is_call, 1)).over(_before(keys, order)))
    df = df.withColumn("__failed", F.last(F.when(failed, about), ignorenulls=True).over(_before(keys, order)))
    other = F.col(mode) != F.col("__failed.mode") if mode else F.lit(False)
    kind = (
        F.when(polling & (F.col("__seen") > 0), "polling").when(F.col("__failed").isNull(), "none")
        .when((F.col("epoch") > F.col("__failed.epoch")) | other, "after_state_change").otherwise("unchanged")
    )
    df = df if keep_all else df.filter(is_call)
    return df.withColumn("retry", F.when(is_call, kind)).drop("__seen", "__failed")


def turn_durations(df: DataFrame, keys: list[str], order: list[str], ts: str, is_start: Column, is_end: Column) -> DataFrame:
    """Ends with `seconds` since their start, at least 0; a start serves one end; ends without one are dropped."""
    df = df.withColumn("__g", F.coalesce(F.count(F.when(is_end, 1)).over(_before(keys, order)), F.lit(0)))
    started = F.last(F.when(is_start, F.col(ts)), ignorenulls=True).over(_before([*keys, "__g"], order))
    df = df.withColumn("__s", started).filter(is_end & F.col("__s").isNotNull())
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return df.withColumn("seconds", F.greatest((micros(F.col(ts)) - micros(F.col("__s"))) / 1e6, F.lit(0.0))).drop("__g", "__s")


def first_reply(df: DataFrame, session: list[str], order: list[str], ts: str, asks: Column, replies: Column) -> DataFrame:
    """The first reply after each run of asks, with `seconds` since the last ask of the run."""
    df = df.withColumn("__run", F.count(F.when(asks, 1)).over(_so_far(session, order)))
    df = df.filter((F.col("__run") > 0) & (asks | replies))
    keys = [*session, "__run"]
    df = df.withColumn("__ask", F.first(F.when(asks, F.col(ts)), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order)))
    df = df.withColumn("__n", F.count(F.when(replies, 1)).over(_so_far(keys, order))).filter(replies & (F.col("__n") == 1))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return df.withColumn("seconds", (micros(F.col(ts)) - micros(F.col("__ask"))) / 1e6).filter("seconds >= 0").drop("__run", "__ask", "__n")


def message_kinds(df: DataFrame, session: list[str], order: list[str], correction: Column) -> DataFrame:
    """User messages with `ordinal` and `kind`: prompt, correction, follow_up (ordinals 2 to 4) or message."""
    df = df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*session).orderBy(*order)))
    kind = F.when(F.col("ordinal") == 1, "prompt").when(correction, "correction").when(F.col("ordinal") <= 4, "follow_up").otherwise("message")
    return df.withColumn("kind", kind)


def keep_first(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def within_budget(df: DataFrame, group: list[str], order: list[str], size: Column, budget: int, least: int) -> DataFrame:
    """Rows in order while more than `least` of the budget is left, with `room` and `truncated`."""
    used = F.coalesce(F.sum(size).over(_before(group, order)), F.lit(0))
    df = df.withColumn("room", (budget - used).cast("long")).filter(F.col("room") > least)
    return df.withColumn("truncated", size > F.col("room"))
