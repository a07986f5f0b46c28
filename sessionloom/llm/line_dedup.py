"""Line dedup: later copies of repeated line runs go. DataFrame functions only.

The lines of all documents are sequences of line ids. Equal prefixes of length m of their suffixes are ranked by prefix
doubling: a suffix's rank at length 2m comes from its rank at m and that of the suffix m lines later. The rank of a
class of equal prefixes is its first place, so ranks are exact from the second round on, however long the prefix. After each
round only suffixes whose rank is shared go on, since the longest common prefix of any other with its neighbours is below
m. From the wanted length on, longest-common-prefix intervals are read off the ranks: as long as a suffix and its
first copy both advance by one line and stay of one rank, their common prefix goes on. Each such stretch is a maximal
repeated run with the place of its first copy; later copies are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import written

_KEY = ["nid", "th"]


def _name(*parts: Column) -> Column:
    """A 128-bit name."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def _repeated(suffixes: DataFrame) -> DataFrame:
    """The suffixes whose name occurs at another place too, with the first place (lo) that has it.

    Counting is combined before the shuffle. The names are written, so that both sides of the join are plain
    shuffles, of which a name that very many suffixes share can be split.
    """
    places = suffixes.groupBy("name").agg(F.min(F.struct(*_KEY, "pos")).alias("lo"), F.max(F.struct(*_KEY, "pos")).alias("hi"))
    return suffixes.join(written(places.filter("lo <> hi").select("name", "lo"), "names"), "name")


def maximal_runs(ranked: DataFrame, length: int) -> DataFrame:
    """(nid, th, start, lines): the maximal runs of at least `length` lines that have an earlier copy.

    ranked: (nid, th, pos, lo) of the suffixes that share their first `length` lines, lo being the first of them.
    """
    later = ranked.filter(F.struct(*_KEY, "pos") != F.col("lo")).select(
        *_KEY, "pos", F.col("lo.nid").alias("n0"), F.col("lo.th").alias("t0"), (F.col("lo.pos") - F.col("pos")).alias("shift")
    )
    along = [*_KEY, "n0", "t0", "shift"]
    turn = F.row_number().over(Window.partitionBy(*along).orderBy("pos"))
    stretch = later.distinct().withColumn("stretch", F.col("pos") - turn).groupBy(*along, "stretch")
    runs = stretch.agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    return runs.select(*_KEY, "start", (F.col("end") - F.col("start") + length).alias("lines"))


def line_dedup(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with the text that is left, and n_lines and n_removed_lines.

    Lines are split at \\n; those without a word (only ASCII white space) count neither in runs nor in the
    numbers, and stay. A run of min_lines or more lines, or (if given) of fewer lines with min_words or more
    words, that also starts earlier (a smaller doc_id, or the same document before) is deleted; runs are
    judged on the input.

    Nulls: a null text stays null, without lines; a null doc_id comes before all others. Rows of one
    doc_id are ordered by the hash of their texts; repeated rows (id and text) are one document and get
    the same result. Columns named n_lines or n_removed_lines are replaced; others stay. An empty table
    gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    nid = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    key = {"nid": nid, "th": F.xxhash64(text)}
    split = F.split(text, "\n")
    lines = F.filter(F.transform(split, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))
    by_words = min_words is not None
    size = {"words": F.size(F.filter(F.split("s.x", r"[\x20\x09-\x0D]+"), lambda w: w != ""))} if by_words else {}
    ids = F.transform(lines, lambda s: F.struct(_name(s["x"]).alias("name"), *([s["x"].alias("x")] if by_words else [])))
    suffixes = written(
        docs.select(*[v.alias(k) for k, v in key.items()], F.posexplode(ids).alias("pos", "s"))
        .select(*_KEY, "pos", "s.name", *[v.alias(k) for k, v in size.items()]),
        "line-ids",
    )
    ranked, length, runs = _repeated(suffixes), 1, []
    while length < min_lines:
        # with a bound on words every length counts, so the next is one line longer: the words of the first line are added
        step = 1 if by_words else min(length, min_lines - length)
        total = {}
        ranked = written(ranked.drop("name"), "ranked")  # else each round's plan would hold those of all rounds before, several times
        if by_words:
            runs.append(maximal_runs(ranked.filter(F.col("words") >= min_words), length))
            total = {"words": F.col("more") + F.col("head"), "head": F.col("head")} if length > 1 else {"words": F.col("more") + F.col("words"), "head": F.col("words")}
        later = ranked.select(*_KEY, (F.col("pos") - step).alias("pos"), F.col("lo").alias("next"), *[F.col("words").alias("more")] * by_words).distinct()
        mine = ranked.select(*_KEY, "pos", "lo", *(["words"] + ["head"] * (length > 1)) * by_words)
        joined = mine.distinct().join(later, [*_KEY, "pos"])
        ranked = _repeated(joined.select(*_KEY, "pos", F.struct("lo", "next").alias("name"), *[v.alias(k) for k, v in total.items()]))
        length += step
    found = maximal_runs(ranked, min_lines)
    for more in runs:
        found = found.union(more)
    gone = found.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "lines")).alias("__runs"))

    names = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    worded = F.transform(lines, lambda s: s["i"])
    base = docs.select(*[F.col(f"`{c}`") for c in names], *[v.alias(f"__{k}") for k, v in key.items()], worded.alias("__worded"))
    out = base.join(gone.withColumnsRenamed({k: f"__{k}" for k in _KEY}), ["__nid", "__th"], "left")
    # the runs of a document as places among its lines; inline keeps them and the lines from being computed once per element
    places = F.flatten(F.transform("__runs", lambda r: F.sequence(r["start"], r["start"] + r["lines"] - 1)))
    doomed = F.array_distinct(F.transform(places, lambda p: F.get("__worded", p)))
    told = F.struct(F.when(F.col("__runs").isNotNull(), split).alias("__lines"), F.coalesce(doomed, F.array().cast("array<int>")).alias("__doomed"))
    out = out.select(*[F.col(f"`{c}`") for c in names], "__worded", F.inline(F.array(told)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__doomed"), lambda i: F.get("__lines", i))
    return out.withColumns(
        {
            "n_lines": F.size("__worded").cast("long"),
            "n_removed_lines": F.size("__doomed").cast("long"),
            "text": F.when(F.col("__lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        }
    ).select(*[F.col(f"`{c}`") for c in names], "n_lines", "n_removed_lines")
