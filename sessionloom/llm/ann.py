"""Approximate largest inner products by collision counting over single random projections.

Every vector is projected on random lines, one sorted array each. A query opens a window around its own
projection in every array and widens all of them by a constant factor (virtual rehashing); only the entries
that a wider window newly takes in are counted. Vectors that lie in at least THRESHOLD of the windows collide
and are verified by their exact inner product. A query is done when a vector as near as its k-th nearest so far
would have collided with a chance of CERTAIN, so the windows follow the data and no share of it is fixed.

Vectors are dealt row by row into shards of bounded size, however often an id is repeated, each with sorted
arrays of its own, and the queries into large blocks; each block visits each shard. One more coordinate makes
all vectors equally long, so that the nearest in distance have the largest inner product.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import written

#: Projections (sorted arrays), factor of the window widths, share of the windows that a candidate lies in.
PROJECTIONS = 24
WIDEN = 2.0
THRESHOLD = 0.6
#: Chance that a vector as near as the k-th found has collided, at which a query's windows stop widening.
CERTAIN = 0.97
FIRST_WIDTH = 0.02
#: Vectors of a shard, queries of a block, and queries of a block where blocks may be smaller so that all cores work.
SHARD_ROWS = 32_768
BLOCK_QUERIES = 32_768
LEAST_QUERIES = 64


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: of the usual length, finite, not zero."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~F.coalesce(bad, F.lit(True))).filter(F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (usual["d"] if usual else 0))


def dealt(df: DataFrame, name: str, n: int, *by: str) -> DataFrame:
    """df with the number, below n, of the part that the hash of some columns gives each row."""
    return df.withColumn(name, F.pmod(F.xxhash64(*by), F.lit(n)).cast("int"))


def salted(rows: DataFrame) -> DataFrame:
    """rows with a number of each row; to be written, so that a row stays in its shard when a task is repeated."""
    return rows.withColumn("salt", F.monotonically_increasing_id())


def sharded(rows: DataFrame, shards: int) -> DataFrame:
    """Salted rows by shard: also the rows of one id are spread."""
    return dealt(rows, "shard", shards, "vec_id", "salt").drop("salt")


def nearest(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query.

    queries: a condition on vec_id. Scores are inner products of the original vectors in double
    precision; ties go to the smaller vec_id. A query's candidates are all rows of other ids.

    Vectors that are null, zero, of an unusual length or hold null or non-finite components, and rows with a
    null id, take no part. Repeated rows are candidates of their own, and as queries count once. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = written(salted(valid_vectors(vectors, id_col, vec_col)), "vectors")
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    shards = max(1, -(-stats["n"] // SHARD_ROWS))
    asked = rows.filter(queries).drop("salt").dropDuplicates(["vec_id"])
    n_asked, cores = asked.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n_asked // BLOCK_QUERIES), min(-(-cores // shards), n_asked // LEAST_QUERIES))
    longest = float(stats["m"] or 1.0) ** 0.5

    def everywhere(df, name, n):
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    data = everywhere(sharded(rows, shards), "block", blocks)
    ask = everywhere(dealt(asked, "block", blocks, "vec_id"), "shard", shards)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        left = left.sort_values("vec_id")
        shard = Shard(left["vec_id"].to_numpy(), np.stack(left["v"]), longest, seed)
        out = []
        for qid, q in zip(right["vec_id"].to_numpy(), right["v"]):
            hit, score = shard.search(qid, q, k)
            best = np.lexsort((shard.ids[hit], -score))[:k]
            out.append(pd.DataFrame({"query_id": qid, "vec_id": shard.ids[hit][best], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    found = data.groupBy("shard", "block").cogroup(ask.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def safe_ratio(projections: int, least: int, certain: float) -> float:
    """The smallest half window width, in distances, at which a vector at that distance lies in `least` of the windows
    with the chance `certain`. Its projections differ from the query's by normal numbers of that deviation."""
    lo, hi = 0.0, 8.0
    for _ in range(60):
        mid = (lo + hi) / 2
        p = math.erf(mid / math.sqrt(2))
        chance = sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(least, projections + 1))
        lo, hi = (lo, mid) if chance >= certain else (mid, hi)
    return hi


_LEAST = math.ceil(THRESHOLD * PROJECTIONS)
_SAFE = safe_ratio(PROJECTIONS, _LEAST, CERTAIN)


class Shard:
    """Sorted arrays of the projections of some vectors, all brought to length 1 by one more coordinate."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, seed: int):
        n, d = x.shape
        self.ids, self.x, self.rough, self.longest = ids, x, x.astype(np.float32), longest
        self.lines = np.random.default_rng(seed).standard_normal((d + 1, PROJECTIONS))
        unit = x / longest
        tail = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", unit, unit)))
        proj = unit @ self.lines[:-1] + tail[:, None] * self.lines[-1]
        self.order = np.argsort(proj, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(proj, self.order.T, axis=0).T)
        kind = np.uint16 if n < 1 << 16 else np.uint32  # holds every place, and n
        self.place = np.empty((PROJECTIONS, n), kind)
        np.put_along_axis(self.place, self.order, np.arange(n, dtype=kind)[None, :], axis=1)
        #: No two of the vectors are further apart on any line than this.
        self.whole = float(np.ptp(proj)) + 1.0

    def _widened(self, counts: np.ndarray, left, right, lo, hi) -> None:
        """Brings the counts from the windows [left, right) to the wider [lo, hi)."""
        new = int((left - lo).sum() + (hi - right).sum())
        if 16 * new < self.order.size:
            for order, a, b, c, d in zip(self.order, lo.tolist(), left.tolist(), right.tolist(), hi.tolist()):
                counts[order[a:b]] += 1
                counts[order[c:d]] += 1
            return
        # so many entries are new that comparing places is cheaper than following the arrays
        kind = self.place.dtype.type
        counts[:] = 0
        for place, a, size in zip(self.place, lo.tolist(), (hi - lo).tolist()):
            counts += (place - kind(a)) < kind(size)

    def search(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the verified vectors of other ids that may be among the k nearest, and their inner products with q."""
        n, norm = len(self.ids), float(np.sqrt(q @ q))
        at, rough = (q / norm) @ self.lines[:-1], q.astype(np.float32)
        left = right = np.array([np.searchsorted(a, v) for a, v in zip(self.sorted, at)])
        counts, waits = np.zeros(n, np.uint8), self.ids != qid
        hit, score = np.zeros(0, np.int64), np.zeros(0, np.float32)
        width, kth, all_in = FIRST_WIDTH, -np.inf, False
        while not all_in:
            # the last windows hold all of every array, wherever the query lies
            all_in = width >= self.whole + np.abs(at).max()
            if all_in:
                lo, hi = np.zeros_like(left), np.full_like(right, n)
            else:
                lo = np.array([np.searchsorted(a, v) for a, v in zip(self.sorted, at - width)])
                hi = np.array([np.searchsorted(a, v, side="right") for a, v in zip(self.sorted, at + width)])
            self._widened(counts, left, right, lo, hi)
            left, right = lo, hi
            new = np.flatnonzero((counts >= _LEAST) & waits)
            if len(new):
                waits[new] = False
                hit = np.concatenate([hit, new])
                score = np.concatenate([score, self.rough[new] @ rough if 4 * len(new) < n else (self.rough @ rough)[new]])
            if len(hit) >= k:
                kth = float(np.partition(score, len(score) - k)[len(score) - k])
                safe = _SAFE * math.sqrt(max(0.0, 2.0 - 2.0 * kth / (self.longest * norm)))
                if width >= safe:
                    break
                width = min(width * WIDEN, safe)
            else:
                width *= WIDEN
        hit = hit[score >= kth - 1e-5 * self.longest * norm]
        # in double precision and row by row, so that equal vectors have equal scores
        return hit, np.einsum("ij,j->i", self.x[hit], q)
