"""Retries on keyed state, over files that arrive one by one, against the batch."""

from pyspark.sql import functions as F

from sessionloom.operators import ordered
from sessionloom.streaming import keyed


def run(spark, folder, schema, name, idle, late):
    """The result of a stream over the files of a folder, one a batch."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        keyed.use_keyed_state(spark)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
        q = keyed.keyed_retries(stream, idle, late).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}-mark").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.table(name)


def test_keyed_retries_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kind = F.col("event_type")
    steps = events.select(
        F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.isin("view", "click").alias("is_call"),
        F.get_json_object("props", "$.k").alias("print"), F.when(F.col("event_id") % 7 == 0, "all").otherwise("default").alias("mode"), (kind == "click").alias("polls"),
        (kind == "error").alias("failed"), (kind == "purchase").alias("changed"),
    )
    cuts = steps.selectExpr("percentile_approx(ts, array(0.3D, 0.7D)) AS c").first().c
    parts = (steps.filter(F.col("ts") <= cuts[0]), steps.filter((F.col("ts") > cuts[0]) & (F.col("ts") <= cuts[1])), steps.filter(F.col("ts") > cuts[1]))
    for n, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
    got = run(spark, f"{tmp_path}/in", steps.schema, "keyed_retries", "365 days", "365 days")
    want = ordered.classify_retries(steps, ["session"], "print", ["ts", "event_id"], F.col("is_call"), F.col("polls"), F.col("failed"), F.col("changed"), mode="mode").select("session", "event_id", "retry")
    assert got.count() == want.count() > 0 and not got.exceptAll(want).count()


def test_an_idle_session_is_forgotten(spark, tmp_path):
    """The same call fails in two sessions and comes again: soon in one, after the idle time in the other, which then is as new."""
    schema = "session string, ts timestamp, event_id long, is_call boolean, print string, mode string, polls boolean, failed boolean, changed boolean"
    row = lambda s, sec, n, call: (s, sec, n, call, "p", "default", False, not call, False)
    batches = ([row("a", 0, 1, True), row("a", 1, 2, False), row("b", 0, 3, True), row("b", 1, 4, False)], [row("a", 60, 5, True), row("c", 36_000, 6, True)], [row("c", 36_001, 7, True)], [row("b", 36_002, 8, True), row("a", 36_002, 9, True)])
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_000_000_000))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
    got = run(spark, f"{tmp_path}/in", df.schema, "keyed_idle", "1 hour", "1 minute")
    assert {r.event_id: r.retry for r in got.collect()} == {1: "none", 3: "none", 5: "unchanged", 6: "none", 7: "none", 8: "none", 9: "none"}
