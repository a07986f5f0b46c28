"""Substring dedup by seed and extend: later copies of word runs go.

Seeds are winnowed word grams: every window of `window` words holds one, chosen by content alone, so
two equal windows hold the same seed at the same place. Documents are joined on the seeds that repeat: every
occurrence of a seed comes to one task with the words around it that its windows cover. There it is extended to both
sides against the first occurrence, word by word; windows inside the extension have an earlier copy. Windows that reach
further are looked up, by all their words, among the other occurrences of the seed. Runs of repeated windows are
the maximal repeats of at least `window` words.

Seeds with OFTEN occurrences or more would crowd a task: their windows are dealt by their own words instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import textkit as tk
from sessionloom.llm.common import parts_for
from sessionloom.llm.spans import bitmap_bits, keyed, may_repeat, merged, real_id, repeated_anchors, winnow, with_spans

#: Words of a seed.
GRAM = 5
#: Occurrences from which on a seed's windows are spread over all tasks.
OFTEN = 1000
#: Salt of the second 64 bits of a window's hash.
SECOND = 0x2545F4914F6CDD1D
#: What a task gets: occurrences of seeds with their words, windows of frequent seeds, runs that are settled.
SEEDS, WINDOWS, RUNS = 0, 1, 2

OCCURRENCE = np.dtype([("seed", "<u8"), ("nid", "<i8"), ("th", "<i8"), ("lo", "<u4"), ("windows", "<u4"), ("before", "<u4")])
WINDOW = np.dtype([("nid", "<i8"), ("th", "<i8"), ("pos", "<u4"), ("h", "<u8"), ("g", "<u8")])
RUN = np.dtype([("nid", "<i8"), ("th", "<i8"), ("s", "<u4"), ("e", "<u4")])


def _windows(words: tk.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows that stay in a row, and the first word of the seed of each."""
    grams, _ = words.grams(GRAM)
    at = winnow(grams, window - GRAM + 1)
    start = np.flatnonzero(words.row[: len(at)] == words.row[window - 1 : window - 1 + len(at)])
    return start, at[start]


def _columns(rec: np.ndarray) -> bytes:
    """Column after column, which packs well in a shuffle."""
    return b"".join(rec[name].tobytes() for name in rec.dtype.names)


def _records(blob: bytes, kind: np.dtype, n: int) -> np.ndarray:
    rec, at = np.empty(n, kind), 0
    for name in kind.names:
        rec[name] = np.frombuffer(blob, kind[name], n, at)
        at += kind[name].itemsize * n
    return rec


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] numbers, then the same from begin[1] on."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def repeated_runs(docs: DataFrame, window: int, often: int = OFTEN) -> DataFrame:
    """(nid, th, s, e): starts s to e - 1 of windows of docs(nid, th, text) that have an earlier copy."""
    spark, bits, parts = docs.sparkSession, bitmap_bits(docs), parts_for(docs)

    def seeds(column):
        words = tk.Words(column)
        _, at = _windows(words, window)
        return words.grams(GRAM)[0][np.unique(at)] if len(at) else np.zeros(0, np.uint64)

    bitmaps = spark.sparkContext.broadcast(repeated_anchors(docs, seeds, bits, often))

    def send(batches):
        twice, many = (np.frombuffer(b, np.uint32) for b in bitmaps.value)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                cols = list(zip(*_sent(part, twice, many, bits, window, parts))) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int8(), pa.binary()))], names=["part", "kind", "blob"])

    def join(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[1] == RUNS:
            return pd.concat([_frame(_records(b, RUN, len(b) // RUN.itemsize)) for b in pdf["blob"]], ignore_index=True)
        if key[1] == WINDOWS:
            rec = np.concatenate([_records(b, WINDOW, len(b) // WINDOW.itemsize) for b in pdf["blob"]])
            return _frame(_runs(_later(rec)[1]))
        return pd.concat([_frame(x) for x in _extended(*_gathered(pdf["blob"]), window)], ignore_index=True)

    rows = docs.mapInArrow(send, "part int, kind byte, blob binary").repartition(parts, "part")
    return rows.groupBy("part", "kind").applyInPandas(join, "nid long, th long, s int, e int")


def _frame(runs: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"nid": runs["nid"], "th": runs["th"], "s": runs["s"].astype(np.int32), "e": runs["e"].astype(np.int32)})


def _sent(part, twice, many, bits: int, window: int, parts: int):
    """(part, kind, blob) of a slice of rows: occurrences by seed, windows of frequent seeds by their hash, settled runs.

    Of occurrences with the same words all around and of equal windows, only the slice's first is sent; the others
    have an earlier copy for certain.
    """
    words = tk.Words(part.column("text"))
    start, at = _windows(words, window)
    if not len(start):
        return
    seed = words.grams(GRAM)[0][at]
    hit = may_repeat(twice, seed, bits)
    start, at, seed = start[hit], at[hit], seed[hit]
    if not len(start):
        return
    row = words.row[start]
    nid, th, pos = part.column("nid").to_numpy()[row], part.column("th").to_numpy()[row], start - words.first[row]
    h, g = words.grams(window)[0][start], words.grams(window, SECOND)[0][start]
    hot = may_repeat(many, seed, bits)
    settled = []

    if hot.any():
        rec = np.empty(int(hot.sum()), WINDOW)
        rec["nid"], rec["th"], rec["pos"], rec["h"], rec["g"] = nid[hot], th[hot], pos[hot], h[hot], g[hot]
        lead, rest = _later(rec)
        settled.append(_runs(rest))
        target = (lead["h"] % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((lead["pos"], lead["th"], lead["nid"], target))
        lead = lead[order]
        yield from ((i, WINDOWS, _columns(lead[s:e])) for i, s, e in tk.occupied(target[order]))

    # windows that follow one another at one seed are one occurrence of it
    new = np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new & ~hot)
    size = np.diff(np.append(np.flatnonzero(new), len(start)))[~hot[new]]
    last = first + size - 1
    rec = np.empty(len(first), OCCURRENCE)
    rec["seed"], rec["nid"], rec["th"], rec["lo"] = seed[first], nid[first], th[first], pos[first]
    rec["windows"], rec["before"] = size, at[first] - start[first]
    # the first and the last window are all of an occurrence's words
    order = np.lexsort((rec["lo"], rec["th"], rec["nid"], h[last], h[first], rec["before"], rec["windows"], rec["seed"]))
    rec, first, last = rec[order], first[order], last[order]
    differ = np.zeros(len(rec), bool)
    differ[:1] = True
    for x in (h[first], h[last], g[first], g[last]):
        differ[1:] |= x[1:] != x[:-1]
    for name in ("seed", "windows", "before"):
        differ[1:] |= rec[name][1:] != rec[name][:-1]
    rest = rec[~differ & _moved(rec, differ, "lo")]
    run = np.empty(len(rest), RUN)
    run["nid"], run["th"], run["s"], run["e"] = rest["nid"], rest["th"], rest["lo"], rest["lo"] + rest["windows"]
    settled.append(run)
    rec, first = rec[differ], first[differ]
    target = (tk.mix(rec["seed"]) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    rec, begin = rec[order], start[first[order]]
    for i, s, e in tk.occupied(target[order]):
        mine = rec[s:e]
        around = words.hash[_spread(begin[s:e], mine["windows"].astype(np.int64) + window - 1)]
        yield i, SEEDS, np.uint32(len(mine)).tobytes() + _columns(mine) + around.tobytes()

    runs = np.concatenate(settled)
    if len(runs):
        yield int(runs["th"][0] % parts), RUNS, _columns(runs)


def _moved(rec: np.ndarray, lead: np.ndarray, place: str) -> np.ndarray:
    """Whether each record stands elsewhere than the last one before it (or itself) that is marked in lead."""
    top = np.maximum.accumulate(np.where(lead, np.arange(len(rec)), 0))
    return (rec["nid"] != rec["nid"][top]) | (rec["th"] != rec["th"][top]) | (rec[place] != rec[place][top])


def _later(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of equal windows, and the others at other places."""
    rec = rec[np.lexsort((rec["pos"], rec["th"], rec["nid"], rec["g"], rec["h"]))]
    lead = np.ones(len(rec), bool)
    lead[1:] = (rec["h"][1:] != rec["h"][:-1]) | (rec["g"][1:] != rec["g"][:-1])
    return rec[lead], rec[~lead & _moved(rec, lead, "pos")]


def _runs(rec: np.ndarray) -> np.ndarray:
    """Windows as runs of starts that follow one another."""
    rec = np.sort(rec, order=["nid", "th", "pos"])
    new = np.ones(len(rec), bool)
    new[1:] = (rec["nid"][1:] != rec["nid"][:-1]) | (rec["th"][1:] != rec["th"][:-1]) | (rec["pos"][1:] > rec["pos"][:-1].astype(np.int64) + 1)
    begin = np.flatnonzero(new)
    out = np.empty(len(begin), RUN)
    out["nid"], out["th"], out["s"] = rec["nid"][begin], rec["th"][begin], rec["pos"][begin]
    out["e"] = rec["pos"][np.append(begin[1:], len(rec))[: len(begin)] - 1] + 1
    return out


def _gathered(blobs) -> tuple[np.ndarray, np.ndarray]:
    recs, around = [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        recs.append(_records(blob[4 : 4 + n * OCCURRENCE.itemsize], OCCURRENCE, n))
        around.append(np.frombuffer(blob, "<u8", offset=4 + n * OCCURRENCE.itemsize))
    return np.concatenate(recs), np.concatenate(around)


def _extended(rec: np.ndarray, around: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows with an earlier copy: those that the first occurrence of their seed shows, and the others.

    around has the hashes of the words that each occurrence's windows cover, one occurrence after the other.
    """
    size = rec["windows"].astype(np.int64) + window - 1
    off = np.cumsum(size) - size
    order = np.lexsort((rec["lo"], rec["th"], rec["nid"], rec["seed"]))
    rec, size, off = rec[order], size[order], off[order]
    centre = np.append(True, rec["seed"][1:] != rec["seed"][:-1])
    top = np.maximum.accumulate(np.where(centre, np.arange(len(rec)), 0))
    again = np.append(False, rec["seed"][1:] == rec["seed"][:-1])  # a repeated row is the same place
    for name in ("nid", "th", "lo"):
        again[1:] &= rec[name][1:] == rec[name][:-1]
    own = np.flatnonzero(~centre & ~again)
    top = top[own]
    before, windows = rec["before"].astype(np.int64), rec["windows"].astype(np.int64)
    at, after = off + before, size - before - GRAM

    def reach(offsets, room) -> np.ndarray:
        """How many of these words, seen from the seed, are the same as around the first occurrence."""
        out, active = np.zeros(len(own), np.int64), np.arange(len(own))
        for d in offsets:
            active = active[room[own[active]] > out[active]]
            active = active[room[top[active]] > out[active]]
            active = active[around[at[own[active]] + d] == around[at[top[active]] + d]]
            if not len(active):
                break
            out[active] += 1
        return out

    left = reach(range(-1, GRAM - window - 1, -1), before)
    right = reach(range(GRAM, window), after)
    same = reach(range(GRAM), np.full(len(rec), GRAM)) == GRAM
    # a window with so many words before the seed lies inside the extension if these are shared, and so are the words after it
    most = np.minimum(before[own], left)
    least = np.maximum(before[own] - windows[own] + 1, window - GRAM - right)
    found = same & (most >= least)
    mine = rec[own]
    shown = np.empty(int(found.sum()), RUN)
    shown["nid"], shown["th"] = mine["nid"][found], mine["th"][found]
    shown["s"] = mine["lo"][found] + (before[own] - most)[found]
    shown["e"] = mine["lo"][found] + (before[own] - least)[found] + 1

    which = np.repeat(np.arange(len(own)), windows[own])
    step = _spread(np.zeros(len(own), np.int64), windows[own])
    ahead = before[own][which] - step
    open_ = ~(found[which] & (ahead <= most[which]) & (ahead >= least[which]))
    which, step = which[open_], step[open_]
    begin = off[own][which] + step
    rest = np.empty(len(which), WINDOW)
    rest["nid"], rest["th"], rest["pos"] = mine["nid"][which], mine["th"][which], mine["lo"][which] + step
    if len(rest):
        rest["h"], rest["g"] = tk.run_hash(around, window)[begin], tk.run_hash(around, window, SECOND)[begin]
    return shown, _runs(_later(rest)[1])


def substring_dedup(docs: DataFrame, window: int = 20, with_text: bool = False, often: int = OFTEN) -> DataFrame:
    """Removes each word that is covered by a window of `window` words with an earlier copy.

    Words are runs of anything but ASCII white space. Earlier: a smaller doc_id, or the same document and
    an earlier start; windows are judged on the input. Returns doc_id, n_words, n_removed,
    kept_sha256 (of the kept words, joined by one blank) and, if asked for, that text.

    Nulls: a null text has no words; a null doc_id comes before all others. Rows of one doc_id are ordered
    by the hash of their texts; repeated rows (id and text) are one document, and each gets its
    result. Other columns are ignored; an empty table gives no rows.
    """
    runs = repeated_runs(keyed(docs), window, often)

    def cut(batches):
        for batch in batches:
            rows = []
            for nid, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode().split()
                kept, at = [], 0
                for s, e in merged([(x["s"], x["e"] + window - 1) for x in spans or ()]):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                body = b" ".join(kept)
                rows.append((real_id(nid), len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest()) + ((body.decode(),) if with_text else ()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return with_spans(docs, runs).mapInArrow(cut, schema)
