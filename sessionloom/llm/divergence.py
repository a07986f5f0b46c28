"""Source divergence audit: how far the term frequencies of a language's sources are apart, in exact integers.

Partial counts are made by Arrow kernels inside the tasks (ascii_lower, split_pattern_regex, dictionary_encode, hash group_by): one
row per task, language, source and term, with occurrences and documents. They are dealt by language and term once;
counts, document frequencies and the language's own counts come from that one shuffle. Kept terms are written as columnar
shards with their scaled frequencies, and sources are compared shard by shard, in tiles of a bounded number of sources and terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import parts_for, written

#: What stands between terms: all ASCII characters but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Text bytes that are split at a time, and rows of partial counts that a task holds before it gives them out.
SLICE_BYTES, HELD_ROWS = 8 << 20, 1 << 19
#: Sources a side and terms of one tile (about; terms are dealt by hash).
TILE_SOURCES, TILE_TERMS = 256, 8192
#: Frequencies are scaled to this, and every kept term has so many occurrences more.
SCALE, MORE = 1_000_000_000, 5

COUNTS = "lang string, source string, term string, n long, docs long"


def _summed(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    out = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select([*keys, "n", "docs"])


def slice_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Occurrences and documents of each (lang, source, term) of some rows."""
    parts = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN)
    terms, doc = pc.list_flatten(parts), pc.list_parent_indices(parts)
    there = pc.greater(pc.binary_length(terms), 0)
    coded = terms.filter(there).dictionary_encode()
    per_doc = pa.table({"doc": doc.filter(there), "term": coded.indices}).group_by(["doc", "term"]).aggregate([([], "count_all")])
    langs, sources, at = lang.dictionary_encode(), source.dictionary_encode(), per_doc["doc"].combine_chunks()
    coded_rows = pa.table({"lang": langs.indices.take(at), "source": sources.indices.take(at), "term": per_doc["term"], "n": per_doc["count_all"]})
    out = coded_rows.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ([], "count_all")])
    whole = lambda dictionary, name: dictionary.take(out[name].combine_chunks()).cast(pa.string())
    return pa.table({
        "lang": whole(langs.dictionary, "lang"), "source": whole(sources.dictionary, "source"), "term": whole(coded.dictionary, "term"),
        "n": out["n_sum"].cast(pa.int64()), "docs": out["count_all"].cast(pa.int64()),
    })


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of at most SLICE_BYTES of text; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _task_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        for part in _slices(batch):
            held.append(slice_counts(part["lang"], part["source"], part["text"]))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [_summed(held)]
                rows = held[0].num_rows
                if 2 * rows > HELD_ROWS:  # too many different terms to keep on gathering
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from _summed(held).to_batches()


def scaled(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + MORE) / (total + MORE * terms)), exact whatever the counts."""
    over = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {MORE} AS DECIMAL(20,0))"
    return F.expr(f"1 + ({over}) div CAST({total} + {MORE} * {terms} AS DECIMAL(20,0))").cast("long")


def _tile(key: tuple, rows: pa.Table, sources: pa.Table) -> pa.Table:
    """For a tile's pairs of sources: the sum, over the terms that one of its sources has in this shard, of what the two
    differ by beyond the difference that they have at any term that both lack."""
    lang, _, a, b = (x.as_py() for x in key)
    ids, zero, block = (sources[c].to_numpy() for c in ("id", "zero", "block"))
    order = np.argsort(ids, kind="stable")
    ids, zero, block = ids[order], zero[order], block[order]
    term = rows["term"].combine_chunks().dictionary_encode()
    p = np.repeat(zero[:, None], len(term.dictionary), axis=1)
    p[np.searchsorted(ids, rows["id"].to_numpy()), term.indices.to_numpy()] = rows["p"].to_numpy()
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    one, two, value = [], [], []
    for i in left.tolist():
        js = right[right > i]
        one.append(np.full(len(js), ids[i]))
        two.append(ids[js])
        value.append(np.abs(p[js] - p[i]).sum(axis=1) - len(term.dictionary) * np.abs(zero[js] - zero[i]))
    flat = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64), pa.int64())
    one = flat(one)
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "one": one, "two": flat(two), "value": flat(value)})


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source, ...).

    Terms are runs of ASCII letters and non-ASCII characters, ASCII capitals folded; those in min_docs or more documents of
    a language are kept. A group is a (lang, source) that occurs. Every group and every language gives each kept term a
    scaled frequency (see `scaled`). Part `pair`: the sum of absolute differences to each other source of the language. Part
    `term`: the `top` kept terms of a group that it has more of than its language, by the difference. Ranks start at 1
    in each group and part: larger values first, ties by the item's bytes.

    A null text, lang or source is an empty one; groups without terms, and languages without kept terms, have pairs all
    the same. Repeated rows count each time. Other columns take no part; an empty table gives an empty result.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    base = docs.select(some("lang"), some("source"), some("text"))
    parts = base.mapInArrow(_task_counts, COUNTS)
    whole = parts.repartition(parts_for(base), "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    whole = whole.withColumns({
        "in_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "first": (F.col("source") == F.min("source").over(of_term)).cast("long"),
    })
    kept = written(whole.filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first"), "terms")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("some"))
    of_lang, by_source = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("source")
    groups = base.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total", "some"])
    groups = groups.select(
        "lang", "source", "total", F.sum("some").over(of_lang).alias("terms"), F.sum("total").over(of_lang).alias("lang_total"),
        (F.row_number().over(by_source) - 1).cast("long").alias("id"), F.count("*").over(of_lang).alias("sources"),
    )
    groups = written(groups.withColumn("zero", F.when(F.col("terms") > 0, scaled("0", "total", "terms"))), "groups")

    known = kept.join(groups, ["lang", "source"])
    # all terms of one shard are in one place; sources whose count is 0 are not written
    shard = F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / TILE_TERMS))
    shards = written(
        known.select("lang", "source", "id", "sources", "term", shard.alias("shard"), scaled("n", "total", "terms").alias("p"), scaled("lang_n", "lang_total", "terms").alias("q")),
        "shards",
    )

    mine, blocks = F.floor(F.col("id") / TILE_SOURCES), F.ceil(F.col("sources") / TILE_SOURCES)
    tiles = [F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")]
    spread = lambda df, *more: df.withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), blocks - 1))}).select("lang", "shard", *tiles, "id", *more)
    dealt = spread(shards, "term", "p")
    every = groups.filter("terms > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.ceil(F.col("terms") / TILE_TERMS) - 1)))
    zeros = spread(every, "zero", mine.alias("block"))
    tile = ["lang", "shard", "a", "b"]
    found = dealt.groupBy(*tile).cogroup(zeros.groupBy(*tile)).applyInArrow(_tile, "lang string, one long, two long, value long")
    sums = found.groupBy("lang", "one", "two").agg(F.sum("value").alias("more"))

    here = groups.select("lang", "source", "terms", F.col("id").alias("i"), F.col("zero").alias("z"))
    there = groups.select("lang", F.col("source").alias("item"), F.col("id").alias("j"), F.col("zero").alias("other_z"))
    both = here.join(there, "lang").filter("i <> j").withColumns({"one": F.least("i", "j"), "two": F.greatest("i", "j")}).join(sums, ["lang", "one", "two"], "left")
    apart = F.coalesce(F.col("terms") * F.abs(F.col("z") - F.col("other_z")), F.lit(0)) + F.coalesce("more", F.lit(0))
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", apart.cast("long").alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    terms = shards.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
