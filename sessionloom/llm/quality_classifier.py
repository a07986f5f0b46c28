"""Quality classifier: document scores learnt from preference pairs (Bradley-Terry), cut at a quantile.

Features are statistics of the whole text, taken once. Weights minimise the logistic loss of the feature differences
of pairs (a document of label 1, one of label 0). All labelled rows are learnt from: they are dealt into groups, and each
row of a group's larger class meets a number of the other class. Only sums of gradients, curvatures and counts reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import textkit as tk
from sessionloom.llm.common import written

#: Labelled rows of a group, about, and rows of the rarer class that each group gets at least (copies, where they are too few).
GROUP, RARE = 1024, 64
#: Pairs of a row of a group's larger class, at least; more while all pairs are fewer than PAIRS.
PARTNERS, PAIRS = 8, 200_000
#: The weight of the squared-norm penalty.
PENALTY = 1e-3
#: Sums are rounded to this fraction, so that they do not depend on their order.
UNIT = 2.0**-40
#: Scores that are sorted on the driver to find the cut, at most; more are narrowed down by counts first.
SORTED, BINS = 10_000, 4096
#: Scores from here on are predicted to be of label 1.
CUT = 0.7

MARKS = b"#*$%&|<>!?.,;:'\"()-_/\\@=+{}[]~"
_CLASS = np.full(256, 7, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 line break, 5 mark, 6 other ASCII, 7 above ASCII
_CLASS[:128] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[list(b" \t\x0b\x0c\r")], _CLASS[10] = 3, 4
_CLASS[list(MARKS)] = 5
NAMES = 8 + len(MARKS) + 13


def text_features(column) -> np.ndarray:
    """A row of statistics for each text; the same numbers for a text wherever it stands."""
    words = tk.Words(column)
    data, off = words.data, words.off
    n = len(off) - 1
    out = np.zeros((n, NAMES))
    kind = _CLASS[data]
    for i in range(n):
        s, e, a, b = off[i], off[i + 1], words.first[i], words.first[i + 1]
        f = out[i]
        if a == b:
            f[-1] = 1
            continue
        size = e - s
        f[:8] = np.bincount(kind[s:e], minlength=8) / size
        bytes_ = np.bincount(data[s:e], minlength=256)
        f[8 : 8 + len(MARKS)] = np.sqrt(bytes_[list(MARKS)] / size)
        g = f[8 + len(MARKS) :]
        h, length = words.hash[a:b], words.end[a:b] - words.start[a:b]
        _, counts = np.unique(h, return_counts=True)
        m = b - a
        g[0], g[1], g[2] = np.log1p(m) / 10, length.mean() / 10, min(length.max(), 100) / 100
        g[3], g[4] = len(counts) / m, counts.max() / m
        g[5] = (length <= 3).mean()
        pairs = h[:-1] * np.uint64(31) + h[1:]
        g[6] = len(np.unique(pairs)) / max(1, m - 1)
        last, first = data[words.end[a:b] - 1], data[words.start[a:b]]
        g[7] = (_CLASS[last] == 5).mean()
        g[8] = (_CLASS[first] == 1).mean()
        breaks = bytes_[10] + 1
        g[9], g[10] = min(m / breaks, 200) / 200, breaks / m
        probability = counts / m
        g[11] = -(probability * np.log(probability)).sum() / max(1.0, np.log(m)) if m > 1 else 1
    return out


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = (x - mean) / scale
    return np.hstack([z, np.clip(z, -3, 3) ** 2])


def _sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss of differences, summed."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return -(d.T @ p), (d * (p * (1 - p))[:, None]).T @ d


def _newton(mean_sums, size: int) -> np.ndarray:
    """Newton's method; mean_sums(w) gives gradient and curvature, each divided by the number of pairs."""
    w = np.zeros(size)
    for _ in range(25):
        grad, hess = mean_sums(w)
        step = np.linalg.solve(hess + PENALTY * np.eye(size), grad + PENALTY * w)
        w = w - step * min(1.0, 5.0 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> dict:
    """The model of rows in memory, on drawn pairs; the cut is the score quantile at the share of label 0."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = _expand(x, mean, scale)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w, cut = np.zeros(z.shape[1]), 0.0
    if len(good) and len(bad):
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        w = _newton(lambda w: [v / pairs for v in _sums(d, w)], z.shape[1])
        cut = float(np.quantile(z @ w, len(bad) / len(label)))
    return {"mean": mean, "scale": scale, "w": w, "cut": cut}


def _dealt(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """A row per group of rows(doc_id, x, y): good and bad (its sizes), own (marks of rows, not copies) and x, label 1 first, as bytes."""
    groups = -(-(good + bad) // GROUP)
    few = min(good, bad)
    copies = F.when(F.col("y") == int(good < bad), min(groups, -(-groups * RARE // few))).otherwise(1)
    each = rows.select("*", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    each = each.withColumn("g", F.pmod(F.xxhash64("doc_id") + F.col("copy"), F.lit(groups)))

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by([("y", "descending"), ("doc_id", "ascending")])
        n = int(np.sum(part["y"].to_numpy()))
        x = part["x"].combine_chunks().flatten().to_numpy()
        own = (part["copy"].to_numpy() == 0).tobytes()
        return pa.table({"good": [n], "bad": [part.num_rows - n], "own": pa.array([own], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    return written(each.groupBy("g").applyInArrow(pack, "good long, bad long, own binary, x binary"), "groups")


def _groups(batches):
    """(sizes of both labels, marks of rows that are no copies, features) of each group."""
    for batch in batches:
        for good, bad, own, x in zip(*(batch.column(c) for c in ("good", "bad", "own", "x"))):
            yield good.as_py(), bad.as_py(), np.frombuffer(own.as_py(), bool), np.frombuffer(x.as_py()).reshape(-1, NAMES)


def _total(dealt: DataFrame, of_group, size: int) -> np.ndarray:
    """The sum over all groups of of_group(good, bad, own, x), in whole UNITs; a task adds up its own."""

    def run(batches):
        total = np.zeros(size, object)
        for group in _groups(batches):
            total += np.array([int(v) for v in np.rint(of_group(*group) / UNIT)], object)
        yield pa.RecordBatch.from_pydict({"v": [[str(v) for v in total]]})

    each = dealt.mapInArrow(run, "v array<string>").select(F.posexplode("v").alias("i", "v"))
    rows = each.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # `size` rows
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = float(r["v"]) * UNIT
    return out


def _ranked(scores: DataFrame, n: int, k: int) -> float:
    """The k-th smallest (from 0) of n scores: counts in bins narrow the range down until few are left."""
    lo, hi = scores.agg(F.min("s"), F.max("s")).first()
    while n > SORTED and lo < hi:
        bin_ = F.least(F.floor((F.col("s") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        within = scores.filter(F.col("s").between(lo, hi)).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))
        for r in sorted(within.collect(), key=lambda r: r["b"]):  # BINS rows at most
            n, lo, hi = r["n"], r["lo"], r["hi"]
            if k < n:
                break
            k -= n
    if lo == hi:
        return lo
    return sorted(r["s"] for r in scores.filter(F.col("s").between(lo, hi)).collect())[k]


def fit_rows(rows: DataFrame) -> dict:
    """The model of all of rows(doc_id, x, y), each id once."""
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    n = good + bad
    if not good or not bad:
        return {"mean": np.zeros(NAMES), "scale": np.ones(NAMES), "w": np.zeros(2 * NAMES), "cut": 0.0}
    dealt = _dealt(rows, good, bad)
    mean = _total(dealt, lambda g, b, own, x: x[own].sum(axis=0) / n, NAMES)
    scale = np.sqrt(_total(dealt, lambda g, b, own, x: ((x[own] - mean) ** 2).sum(axis=0) / n, NAMES)) + 1e-9
    most = max(PARTNERS, -(-PAIRS // max(good, bad)))
    pairs = dealt.agg(F.sum(F.greatest("good", "bad") * F.least("good", "bad", F.lit(most)))).first()[0]
    size = 2 * NAMES
    upper = np.triu_indices(size)

    def mean_sums(w):
        def of_group(g, b, own, x):
            z = _expand(x, mean, scale)
            grad, hess = np.zeros(size), np.zeros((size, size))
            at = np.arange(max(g, b))
            for shift in range(min(g, b, most)):
                other = (at + shift) % min(g, b)
                one, two = (at, other) if g >= b else (other, at)
                p, c = _sums(z[one] - z[g + two], w)
                grad, hess = grad + p, hess + c
            return np.concatenate([grad, hess[upper]]) / pairs

        v = _total(dealt, of_group, size + len(upper[0]))
        hess = np.zeros((size, size))
        hess[upper] = v[size:]
        return v[:size], hess + np.triu(hess, 1).T

    w = _newton(mean_sums, size)

    def score(batches):
        for _, _, own, x in _groups(batches):
            yield pa.RecordBatch.from_pydict({"s": _expand(x[own], mean, scale) @ w})

    scores = written(dealt.mapInArrow(score, "s double"), "scores")
    place = (n - 1) * bad / n
    low = int(place)
    a, b = _ranked(scores, n, low), _ranked(scores, n, min(low + 1, n - 1))
    return {"mean": mean, "scale": scale, "w": w, "cut": a + (b - a) * (place - low)}


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1; the cut lies at CUT."""
    if not model["w"].any():
        return np.full(len(x), 0.5)  # nothing was learnt
    s = _expand(x, model["mean"], model["scale"]) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(s - model["cut"] + np.log(CUT / (1 - CUT)), -40, 40)))


def _features(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                x = pa.array(text_features(part.column("text")).ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(x, NAMES).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs(doc_id, text, ...).

    labels(doc_id, quality): all those of quality 0 or 1 whose id is not held out (a condition on doc_id) are
    learnt from; they are joined with the features, not with the texts.

    Nulls: a null text is empty (and scored); a null id is not held out and never learnt from. Repeated
    rows are scored one by one; of repeated labels the larger counts, of repeated documents the smallest
    features. Without labels of both kinds all scores are 0.5 (below CUT, so predicted is 0). Other columns
    are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    told = written(_features(docs), "features")
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    model = fit_rows(written(told.join(known, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")), "labelled"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = apply(model, batch.column(1).flatten().to_numpy().reshape(-1, NAMES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = told.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
