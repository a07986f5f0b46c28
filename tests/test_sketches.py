"""Sketches of days merged for a range, against exact counts and quantiles of the same rows."""

import random

from pyspark.sql import functions as F

from sessionloom.operators import sketches


def table(spark, n=6000):
    rng = random.Random(3)
    rows = [(i % 30 if i % 50 else None, f"p{rng.randrange(4)}", f"u{rng.randrange(2500)}", float(rng.randrange(10_000)), [rng.randrange(500) for _ in range(rng.randrange(3))]) for i in range(n)]
    return spark.createDataFrame([*rows, (3, None, None, None, None)], "d int, project string, user string, x double, xs array<int>")


def test_any_range_is_answered_from_the_sketches(spark, tmp_path):
    rows = table(spark)
    sketches.daily(rows, F.col("d"), ["project"], ["user"], ["x", "xs"]).write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    assert stored.count() == rows.select("d", "project").distinct().count()
    for cut in ("day BETWEEN 3 AND 9", "project = 'p1'", "day IS NULL", "day >= 0 OR day IS NULL"):
        got = sketches.answers(sketches.merged(stored.filter(cut))).first()
        some = rows.withColumnRenamed("d", "day").filter(cut)
        exact = some.agg(F.count("*").alias("n"), F.countDistinct("user").alias("u")).first()
        assert got.n == exact.n and abs(got.user - exact.u) <= max(3, 0.06 * exact.u)
        values = sorted(r.x for r in some.filter("x IS NOT NULL").collect())
        listed = sorted(x for r in some.select(F.explode("xs").alias("x")).collect() for x in [r.x])
        for have, p, of in ((got.x_p50, 0.5, values), (got.x_p90, 0.9, values), (got.xs_p90, 0.9, listed)):
            below, upto = sum(v < have for v in of) / len(of), sum(v <= have for v in of) / len(of)
            assert below - 0.03 <= p <= upto + 0.03


def test_merging_is_the_same_in_any_order_and_empty_ranges_have_nothing(spark):
    s = sketches.daily(table(spark, 500), F.col("d"), ["project"], ["user"], ["x", "xs"])
    by = {r.project: r.n for r in sketches.merged(s, ["project"]).collect()}
    assert sum(by.values()) == 501
    r = sketches.answers(sketches.merged(s.filter("day = 99"))).first()
    assert (r.n, r.user, r.x_p50, r.xs_p90) == (0, 0, None, None)
    lone = sketches.answers(sketches.merged(s.filter("project IS NULL"))).first()
    assert (lone.n, lone.user, lone.x_p50, lone.xs_p50) == (1, 0, None, None)
