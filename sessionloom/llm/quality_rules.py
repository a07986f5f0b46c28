"""Document rules: base statistics, then a hashed n-gram likelihood ratio against a trusted target.

Only DataFrame functions are used. A document's tokens are runs of letters and digits or of other
marks; its features are hashed tokens and token pairs. Two multinomials over the hash slots, of the
trusted documents and of the raw corpus, give each slot a weight; a document's score is the mean
weight of its features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import written

#: Hash slots of the two multinomials; their weights are the only thing that reaches the driver.
BITS = 13
SLOTS = 1 << BITS
#: Scores below this are rejected: the mean weight, in nats per feature.
THRESHOLD = -0.02

ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _covered(at: Column) -> Column:
    """Words covered by the 3-word windows that start at these ascending positions."""
    return F.aggregate(
        at,
        F.struct(F.lit(0).alias("e"), F.lit(0).alias("c")),
        lambda a, p: F.struct((p + 3).alias("e"), (a["c"] + p + 3 - F.greatest(p, a["e"])).alias("c")),
        lambda a: a["c"].cast("long"),
    )


def base_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to docs(text, ...).

    For the repeated words, the hash of each 3-word window and its position share a long. Sorted, equal
    windows stand side by side; those found so are compared by their full hashes once more.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(
        F.size("__w") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    bits = F.col("__b")
    high = F.call_function("shiftleft", F.lit(-1).cast("long"), bits)
    packed = F.transform("__h", lambda x, i: x.bitwiseAND(F.col("__m")).bitwiseOR(i.cast("long")))
    near = F.filter(
        F.sequence(F.lit(0), F.size("__s") - 2),
        lambda k: F.call_function("shiftrightunsigned", F.get("__s", k).bitwiseXOR(F.get("__s", k + 1)), bits) == 0,
    )
    low = F.bitwise_not("__m")
    sides = F.transform("__n", lambda k: F.array(F.get("__s", k).bitwiseAND(low).cast("int"), F.get("__s", k + 1).bitwiseAND(low).cast("int")))
    place = F.flatten(F.filter(sides, lambda a: F.get("__h", a[0]) == F.get("__h", a[1])))
    out = docs.withColumn("__w", _words(text))
    out = out.withColumns({"__h": windows, "__l": lines, "__b": F.when(F.size("__w") < 1 << 24, 24).otherwise(31)})
    out = out.withColumn("__m", high)
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(packed)))
    out = out.withColumn("__n", F.when(F.col("__s").isNotNull(), near))
    out = out.withColumn("__p", F.when(F.col("__n").isNotNull(), place))
    out = out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": F.when(F.col("__p").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.sort_array(F.array_distinct("__p")))),
        }
    ).drop("__w", "__h", "__l", "__b", "__m", "__s", "__n", "__p")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _hashes(text: Column) -> Column:
    """Hashes of the tokens of a text: runs of letters and digits, and runs of other marks."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"), F.lit(0)), lambda t: F.xxhash64(t))


def _slot(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(SLOTS)).cast("int")


def slot_weights(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """Log ratio of the two multinomials for each slot (add-one smoothing, 6 digits).

    Counts run over all documents; trusted(doc_id) marks those of the target. Without any trusted
    document all weights are 0.
    """
    ids = written(trusted.select("doc_id").filter("doc_id is not null").distinct(), "trusted").withColumn("__t", F.lit(1))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select("doc_id", text.alias("text")).join(ids, "doc_id", "left")
    hashed = marked.select("__t", _hashes(F.col("text")).alias("h"))
    both = F.transform("h", lambda x, i: _slot(x) * SLOTS + _slot(F.get("h", i - 1), x))
    each = hashed.select("__t", F.explode(both).alias("b"))
    each = each.select("__t", F.shiftright("b", BITS).alias("one"), F.col("b").bitwiseAND(SLOTS - 1).alias("two"))
    counts = (
        each.groupingSets([["one"], ["two"]], "one", "two")
        .agg(F.count("*").alias("raw"), F.count("__t").alias("target"))
        .select(F.coalesce("one", "two").alias("slot"), "raw", "target")
        .toPandas()  # 2 * SLOTS rows at most
    )
    import math

    raw, target = [1.0] * SLOTS, [1.0] * SLOTS
    for slot, r, t in zip(counts["slot"], counts["raw"], counts["target"]):
        raw[slot] += r
        target[slot] += t
    if sum(target) == SLOTS:
        return [0.0] * SLOTS
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [round(math.log(t) - math.log(r) + shift, 6) for r, t in zip(raw, target)]


def score(hashes: Column, weights: list[float]) -> Column:
    """Mean weight of a text's features (each token, and each with the token before it); 0 without tokens."""
    w = F.expr("cast(split('" + ",".join(map(repr, weights)) + "', ',') as array<double>)")
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("long").alias("p"))
    total = F.aggregate(
        hashes,
        start,
        lambda a, x: F.struct((a["s"] + F.get(w, _slot(x)) + F.get(w, _slot(a["p"], x))).alias("s"), x.alias("p")),
        lambda a: a["s"],
    )
    return F.when(F.size(hashes) > 0, total / (2 * F.size(hashes))).otherwise(0.0)


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...) with the base statistics, base_failed, score and kept.

    A null text is an empty one (no words, so base_failed). Null ids are never trusted. Repeated rows
    are judged one by one. Existing columns of the names that are added are replaced. An empty table
    gives an empty result.
    """
    weights = slot_weights(docs, trusted)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED])
    scored = base_statistics(docs).withColumn("__h", _hashes(text)).withColumn("score", F.round(score(F.col("__h"), weights), 6))
    # a row of a generator: filters on it stay above, so that the expressions behind it are not repeated
    told = scored.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(F.struct(*ADDED[:-1]))))
    return told.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
