"""What Python workers hold: small batches while they work, little when they have ended, and rows dealt to all parts."""

import tracemalloc

import numpy as np
import pyarrow as pa
import psutil
from pyspark.sql import functions as F

from sessionloom.llm import jaccard_join as jj
from sessionloom.llm import suffix_dedup as sd
from sessionloom.llm import textkit as tk
from sessionloom.llm.common import BATCH_BYTES, written


def test_batches_of_written_tables_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    docs = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    found = [r["size"] for r in written(docs.mapInArrow(sizes, "size long"), "sizes").collect()]
    assert sum(found) >= 40_000_000
    assert max(found) < BATCH_BYTES + 100_000


def test_a_task_gives_its_memory_back():
    def hold(batches):
        tk.prefix_hash(np.zeros(1 << 20, np.uint8))
        kept.append(bytes(1))
        held = [bytes(64_000) for _ in range(3000)]
        kept.extend(bytes(500) for _ in range(10_000))  # these stay, so that what was made before does not end the heap
        yield from batches
        del held

    kept = []
    before = psutil.Process().memory_info().rss
    assert list(tk.lean(hold)(iter([1, 2]))) == [1, 2]
    assert not tk._powers
    assert psutil.Process().memory_info().rss - before < 100e6


def test_anchors_found_some_rows_at_a_time_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab c\u00e9"), n)) for n in (0, 5, 90, 700, 3000, 100, 2500, 0)] + [None]
    column = pa.array(texts)
    _, off, grams = sd._grams(column, 10)
    at, lo, hi = sd._anchors(off, grams, 40, 10)
    for at_once in (1, 1000, 1 << 19):
        monkeypatch.setattr(sd, "AT_ONCE", at_once)
        for got, want in zip(sd._places(column, 40, 10), (at, lo, hi, grams[at])):
            assert len(at) and np.array_equal(got, want)


def test_anchors_of_a_slice_take_little_memory():
    column = pa.array(["".join(map(chr, np.random.default_rng(i).integers(97, 123, 4000))) for i in range(1000)])
    tk._powers.clear()
    tracemalloc.start()
    sd._places(column, 204, 51)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80e6


def test_no_stage_of_the_comparison_has_two_sets_of_workers(spark):
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    sets = spark.range(1, 3).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("n"), F.lit(b"abcd").alias("set"))
    kept = jj._only(sets, sets.select("node"))
    plan = jj._compared(pairs.hint("merge"), kept.hint("merge"), 75, 100, 4)
    assert plan.count() == 1
    assert "SortMergeJoin" in plan._jdf.queryExecution().executedPlan().toString()
    wide = jj._sketches(sets.withColumns({"own": F.lit(6), "most": F.lit(6)}).select("node", "own", "most", "set"), sets.select("node"))
    assert wide._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_lean_functions_of_groups_keep_their_arguments():
    assert tk.lean(lambda pdf: pdf + 1)(1) == 2
    assert tk.lean(lambda key, pdf: (key, pdf))(1, 2) == (1, 2)


def test_rows_for_any_part_are_dealt_to_many_parts(spark):
    docs = spark.range(0, 64, 1, 16).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one two three four five"), "id").alias("text"))
    hot = spark.sparkContext.broadcast(bytes(1 << (jj.HOT_BITS - 3)))
    parts = jj.parts_for(docs)
    found = {r["part"] for r in jj._postings(docs, 5, 75, 100, hot).filter("kind = 0").select("part").collect()}
    assert len(found) > 1 and all(0 <= p < parts for p in found)
