"""Exact substring dedup over a sparse suffix array of the bytes of all texts.

Suffixes start at winnowed anchors: every window of `window` bytes holds an anchor gram chosen by
content alone, so that two equal windows hold the same gram at the same place. Suffixes at grams that
occur once cannot matter and are left out. The others come with the bytes before them that such windows
need. Suffixes with equal bytes are found by 128-bit BLAKE2 digests, and the first of them stands for all. The
distinct ones are range-partitioned by their leading bytes with sampled splitters, and each bucket sorts its
suffixes by a multikey sort of 8-byte symbols. Splitters never part suffixes with equal leading bytes,
so no match crosses a bucket's boundary; those of a frequent anchor are dealt by the longer contexts that equal windows share. The longest common prefix with the sorted neighbours says which
windows around an anchor can have a copy. Rolling hashes pair those windows up, and each pair is compared byte by byte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import textkit as tk
from sessionloom.llm.common import parts_for, plan_bytes, written
from sessionloom.llm.spans import bitmap_bits, keyed, may_repeat, merged, real_id, repeated_anchors, winnow, with_spans

#: Leading bytes of a suffix that the splitters look at.
LEAD = 24
#: Leading bytes of suffixes that the splitters are taken from: about this many for each bucket.
#: Leads that the driver aims to see, at most.
MOST_SAMPLED = 1_000_000
SAMPLED = 40
#: Occurrences from which on the suffixes at an anchor are spread over all buckets by longer contexts.
OFTEN = 1000
#: Bytes of texts whose anchors are looked for at once, about: some ten arrays of 8 bytes for each.
AT_ONCE = 1 << 19
#: Suffixes that are sorted at once, at least (more only if more have the same leading bytes).
CHUNK = 4096


def _grams(column, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, off = tk.text_bytes(column)
    if len(data) < gram:
        return data, off, np.zeros(0, np.uint64)
    p = tk.prefix_hash(data)  # it only chooses anchors: what they propose is decided by bytes
    n = len(data) - gram + 1
    return data, off, tk.mix((p[gram:] - p[:n]) * tk._power(tk._R_INV, len(p), "i")[:n])


def _anchors(off: np.ndarray, grams: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, and the first and last window start that chose each."""
    at = winnow(grams, window - gram + 1)
    inside = np.zeros(len(at) + 1, np.int8)
    for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
        if e - s >= window:
            inside[s : e - window + 1] = 1
    start = np.flatnonzero(inside[: len(at)])
    if not len(start):
        return start, start, start
    at = at[start]
    new = np.ones(len(start), bool)
    new[1:] = at[1:] != at[:-1]
    begin = np.flatnonzero(new)
    return at[begin], start[begin], start[np.append(begin[1:], len(start)) - 1]


def _places(column, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places in all bytes of a column, the first and last window start that chose each, and their grams; some rows at a time."""
    _, off = tk.text_bytes(column)
    none = np.zeros(0, np.int64)
    found, row = [(none, none, none, np.zeros(0, np.uint64))], 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + AT_ONCE, side="right")) - 1)
        _, mine, grams = _grams(column.slice(row, end - row), gram)
        at, lo, hi = _anchors(mine, grams, window, gram)
        found.append((at + off[row], lo + off[row], hi + off[row], grams[at]))
        row = end
    at, lo, hi, grams = (np.concatenate(x) for x in zip(*found))
    return at, lo, hi, grams


def suffix_order(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey sort of data[start:end] by 8-byte symbols (zeros after the end).

    Each round reads and sorts only the suffixes that are still tied, by their next symbol, so that memory
    does not grow with the width. Returns the order and
    an upper bound, in bytes, of each suffix's longest common prefix with its neighbours.
    """
    n, rounds = len(start), -(-width // 8)

    def symbols(some: np.ndarray, r: int) -> np.ndarray:
        out = np.zeros(len(some), np.uint64)
        for j in range(r * 8, r * 8 + 8):
            at = start[some] + j
            byte = np.where(at < end[some], data[np.minimum(at, len(data) - 1)], 0)
            out = (out << np.uint64(8)) | byte.astype(np.uint64)
        return out

    order, group, shared = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    tied = np.arange(n)
    for r in range(rounds):
        if len(tied) < 2:
            break
        part = order[tied]
        s = symbols(part, r)
        sub = np.lexsort((s, group[tied]))
        order[tied] = part[sub]
        g, s = group[tied], s[sub]
        equal = np.zeros(len(tied), bool)
        equal[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1]) & (tied[1:] == tied[:-1] + 1)
        group[tied] = np.cumsum(~equal)
        both = equal.copy()
        both[:-1] |= equal[1:]
        # a neighbour that stays tied shares this symbol; else it shares less than one symbol more
        shared[tied[both]] = (r + 1) * 8
        tied = tied[both]
    out = np.empty(n, np.int64)
    out[order] = shared + 7
    return order, out


def _copied_windows(bodies: list[bytes], lead: np.ndarray, count: np.ndarray, settled: np.ndarray, window: int, keep_first: bool):
    """For each suffix, the first and last of its windows that are to go (-1: none).

    bodies: in the order of their places in the corpus; lead: bytes before the suffix in its body; count: its windows,
    from the body's first byte on; settled: whether its body is known to stand elsewhere too (later on). To go are
    windows that stand twice or more; if the first copy is kept, those that stand earlier.
    """
    raw = b"".join(bodies)
    data = np.frombuffer(raw, np.uint8)
    off = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    _, shared = suffix_order(data, off[:-1] + lead, off[1:], window)
    need = np.clip(lead + shared - window + 1, 0, count)  # windows that reach no further than the shared prefix
    if not keep_first:
        need = np.where(settled, count, need)  # windows of others may equal any of theirs
    row = np.repeat(np.arange(len(bodies)), need)
    place = np.arange(len(row)) - np.repeat(np.cumsum(need) - need, need)
    begin = off[row] + place
    first, last = np.full(len(bodies), 1 << 40), np.full(len(bodies), -1)
    if len(row):
        _, lowest, back, n = np.unique(tk.rolling_hash(tk.prefix_hash(data), begin, begin + window), return_index=True, return_inverse=True, return_counts=True)
        twin = _verified(raw, begin, begin[lowest[back]], window)
        hit = twin != begin
        if not keep_first:
            hit |= np.isin(begin, twin[hit])
        np.minimum.at(first, row[hit], place[hit])
        np.maximum.at(last, row[hit], place[hit])
    if not keep_first:
        full = np.flatnonzero(settled)
        first[full], last[full] = 0, count[full] - 1
    return first, last


def _verified(raw: bytes, begin: np.ndarray, twin: np.ndarray, window: int) -> np.ndarray:
    """The first place with the bytes of each window, given a place with the same hash, which it mostly is.

    Neighbouring windows with neighbouring twins are compared as one stretch. Where a stretch differs, its hash
    is that of several texts, and all windows of the chunk are named by their bytes instead.
    """
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1] + 1) | (twin[1:] != twin[:-1] + 1)
    at = np.flatnonzero(new)
    for i, j in zip(at.tolist(), np.append(at[1:], len(begin)).tolist()):
        a, b, size = int(begin[i]), int(twin[i]), j - i - 1 + window
        if a != b and raw[a : a + size] != raw[b : b + size]:
            seen: dict[bytes, int] = {}
            return np.array([seen.setdefault(raw[x : x + window], x) for x in begin.tolist()], np.int64)
    return twin


#: A suffix with the windows it stands for: the digest of its bytes, its document, where its bytes begin, how many
#: they are, how many of them lie before the anchor, whether they stand elsewhere too as far as is known, and whether the anchor is frequent.
FOUND = np.dtype([("h", "<u8"), ("g", "<u8"), ("nid", "<i8"), ("th", "<i8"), ("s", "<i8"), ("size", "<u4"), ("before", "<u4"), ("full", "?"), ("often", "?")])


def _settled(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each digest, marked full if there are more; and the others at other places."""
    rec = rec[np.lexsort((rec["s"], rec["th"], rec["nid"], rec["g"], rec["h"]))]
    new = np.ones(len(rec), bool)
    new[1:] = (rec["h"][1:] != rec["h"][:-1]) | (rec["g"][1:] != rec["g"][:-1])
    at = np.flatnonzero(new)
    more = np.diff(np.append(at, len(rec))) > 1
    if len(at):
        more |= np.logical_or.reduceat(rec["full"], at)
    top = np.maximum.accumulate(np.where(new, np.arange(len(rec)), 0))
    same = (rec["nid"] == rec["nid"][top]) & (rec["th"] == rec["th"][top]) & (rec["s"] == rec["s"][top])
    lead, rest = rec[at], rec[~same]
    lead["full"], rest["full"] = more, True
    return lead, rest


def _columns(rec: np.ndarray) -> bytes:
    return b"".join(rec[name].tobytes() for name in FOUND.names)


def _records(blob: bytes) -> np.ndarray:
    rec, at = np.empty(len(blob) // FOUND.itemsize, FOUND), 0
    for name in FOUND.names:
        rec[name] = np.frombuffer(blob, FOUND[name], len(rec), at)
        at += FOUND[name].itemsize * len(rec)
    return rec


def _suffixes(docs: DataFrame, bitmap, parts: int, window: int, gram: int, bits: int) -> DataFrame:
    """(nid, th, s, e, before, full, often, send) of each suffix at a repeated anchor.

    often: the anchor has OFTEN occurrences or more. full: the same bytes stand elsewhere too. send: it is the first with its bytes, which are to be compared. A slice of
    rows sends one of equal suffixes to the others' task; the rest are settled, so a task gets one a slice at most.
    """

    def find(batches):
        slots, many = (np.frombuffer(b, np.uint32) for b in bitmap.value)
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in tk.slices(batch, "text", 4 << 20):
                data, off = tk.text_bytes(part.column("text"))
                at, lo, hi, grams = _places(part.column("text"), window, gram)
                hit = may_repeat(slots, grams, bits)
                at, lo, hi, grams = at[hit], lo[hit], hi[hit], grams[hit]
                row = np.searchsorted(off, lo, side="right") - 1
                rec, raw = np.zeros(len(at), FOUND), data.tobytes()
                digests = [
                    hashlib.blake2b(raw[s:e], digest_size=16, salt=b.to_bytes(8, "little")).digest()
                    for s, e, b in zip(lo.tolist(), (hi + window).tolist(), (at - lo).tolist())
                ]
                both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
                rec["h"], rec["g"] = both[:, 0], both[:, 1]
                rec["nid"], rec["th"] = part.column("nid").to_numpy()[row], part.column("th").to_numpy()[row]
                rec["s"], rec["size"], rec["before"] = lo - off[row], hi - lo + window, at - lo
                rec["often"] = may_repeat(many, grams, bits)
                rec, rest = _settled(rec)
                target = (rec["h"] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(target, kind="stable")
                rec = rec[order]
                out = [(i, False, press.compress(_columns(rec[s:e]))) for i, s, e in tk.occupied(target[order])]
                if len(rest):
                    out.append((int(rest["th"][0] % parts), True, press.compress(_columns(rest))))
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.binary()))], names=["part", "final", "blob"])

    def settle(key, pdf: pd.DataFrame) -> pd.DataFrame:
        press = zstandard.ZstdDecompressor()
        rec = np.concatenate([_records(press.decompress(blob)) for blob in pdf["blob"]])
        lead, rest = (rec[:0], rec) if key[1] else _settled(rec)
        rec, send = np.concatenate([lead, rest]), np.repeat([True, False], [len(lead), len(rest)])
        size = rec["size"].astype(np.int64)
        return pd.DataFrame({"nid": rec["nid"], "th": rec["th"], "s": rec["s"], "e": rec["s"] + size, "before": rec["before"].astype(np.int32), "full": rec["full"], "often": rec["often"], "send": send})

    sent = docs.mapInArrow(tk.lean(find), "part int, final boolean, blob binary").repartition(parts, "part").groupBy("part", "final")
    return written(sent.applyInPandas(tk.lean(settle), "nid long, th long, s long, e long, before int, full boolean, often boolean, send boolean"), "suffixes")


def _halves(body: bytes, before: int, window: int, gram: int) -> list[tuple[bytes, int, int, bytes]]:
    """A suffix at a frequent anchor as up to two: (bytes, first of them, bytes before the anchor, what equal windows share).

    The windows that begin within half of the reach before the anchor share so many bytes from the anchor on; the others
    share more than that before it. Where only a passage around the anchor is common, these contexts differ.
    """
    half = (window - gram) // 2
    out, begin = [], max(0, before - half)
    if len(body) - begin >= window:
        out.append((body[begin:], begin, before - begin, body[before : before + window - half]))
    if before > half:
        out.append((body[: before - half - 1 + window], 0, before, body[before - half - 1 : before + gram]))
    return out


def copied_spans(docs: DataFrame, window: int, gram: int, keep_first: bool = False, often: int = OFTEN) -> DataFrame:
    """(nid, th, s, e): byte spans of docs(nid, th, text) covered by windows that occur at least twice.

    keep_first: only by those that occur earlier too (by nid, th and place).
    """

    def anchors(column):
        return _places(column, window, gram)[3]

    bits, head = bitmap_bits(docs), min(LEAD, gram)  # windows that are equal share the gram
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs, anchors, bits, often))
    parts = parts_for(docs)
    splitters = _splitters(docs, parts, window, gram)
    told = _suffixes(docs, bitmap, parts, window, gram, bits)
    wanted = told.filter("send").groupBy("nid", "th").agg(F.collect_list(F.struct("s", "e", "before", "full", "often")).alias("wanted"))

    def cut(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in tk.slices(batch, "text", 16 << 20):
                out: dict[int, list] = {}
                for nid, th, text, found in zip(*(part.column(name).to_pylist() for name in ("nid", "th", "text", "wanted"))):
                    raw = text.encode()
                    for x in found:
                        body, before = raw[x["s"] : x["e"]], x["before"]
                        if x["often"]:
                            for some, begin, ahead, shared in _halves(body, before, window, gram):
                                out.setdefault(zlib.crc32(shared) % parts, []).append((some, ahead, x["full"], nid, th, x["s"] + begin))
                        else:
                            out.setdefault(bisect_right(splitters, body[before : before + head]), []).append((body, before, x["full"], nid, th, x["s"]))
                blobs = [press.compress(_pack(rows)) for rows in out.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    # the texts are dealt by (nid, th), as they are again when the spans are cut out: one exchange serves both
    buckets = docs.join(wanted.hint("merge"), ["nid", "th"]).mapInArrow(tk.lean(cut), "bucket int, blob binary").repartition(parts, "bucket").groupBy("bucket")

    def solve(rows: list[tuple]):
        bodies = [r[0] for r in rows]
        before = np.array([r[1] for r in rows], np.int64)
        full = np.array([r[2] for r in rows], bool)
        count = np.array([len(b) for b in bodies]) - window + 1
        first, last = _copied_windows(bodies, before, count, full, window, keep_first)
        keep = np.flatnonzero(last >= 0 if keep_first else (last >= 0) & ~full)
        if not len(keep):
            return None
        nid, th, s = (np.array([rows[i][j] for i in keep], np.int64) for j in (3, 4, 5))
        return pd.DataFrame({"nid": nid, "th": th, "s": s + first[keep], "e": s + last[keep] + window})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        press = zstandard.ZstdDecompressor()
        rows = [r for blob in pdf["blob"] for r in _unpack(press.decompress(blob))]
        rows.sort(key=lambda r: (r[0][r[1] : r[1] + head], *r[3:]))
        rows = [r for i, r in enumerate(rows) if not i or r[3:] != rows[i - 1][3:]]  # a repeated row is the same place
        out, begin = [], 0
        for i in range(1, len(rows) + 1):
            # suffixes with equal leading bytes are compared together
            if i == len(rows) or i - begin >= CHUNK and rows[i][0][rows[i][1] :][:head] != rows[i - 1][0][rows[i - 1][1] :][:head]:
                if (got := solve(rows[begin:i])) is not None:
                    out.append(got)
                begin = i
        none = pd.DataFrame({"nid": [], "th": [], "s": [], "e": []}, dtype="int64")
        return pd.concat(out, ignore_index=True) if out else none

    compared = buckets.applyInPandas(tk.lean(compare), "nid long, th long, s long, e long")
    return compared.union(told.filter("not send" if keep_first else "full").select("nid", "th", "s", "e"))


def _splitters(docs: DataFrame, parts: int, window: int, gram: int) -> list[bytes]:
    """Up to parts - 1 leading byte strings that part a sample of the suffixes evenly; the sample aims at MOST_SAMPLED at most and never has more than four times that."""
    want, size = min(parts * SAMPLED, MOST_SAMPLED), max(1, plan_bytes(docs))
    # winnowing keeps about two of (window - gram) places
    share = min(1.0, max(want * (window - gram) / (2 * size), 200_000 / size))

    def leads(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                at, _, _, _ = _places(part.column("text"), window, gram)
                raw = tk.text_bytes(part.column("text"))[0].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[a : a + min(LEAD, gram)] for a in at.tolist()], pa.binary())], names=["lead"])

    found = docs.sample(share, 5).select("text").mapInArrow(tk.lean(leads), "lead binary")
    keys = sorted(found.limit(4 * want).toArrow()["lead"].to_pylist())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


_HEAD = struct.Struct("<II?qqq")


def _pack(rows: list[tuple]) -> bytes:
    return b"".join([x for body, *rest in rows for x in (_HEAD.pack(len(body), *rest), body)])


def _unpack(data: bytes):
    at = 0
    while at < len(data):
        n, *rest = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        yield data[at : at + n], *rest
        at += n


def suffix_dedup(
    docs: DataFrame, window: int = 400, gram: int = 100, with_text: bool = False, keep: tuple[str, ...] = (), keep_first: bool = False, often: int = OFTEN
) -> DataFrame:
    """Removes each byte that is covered by a `window`-byte string which also starts anywhere else.

    Texts are UTF-8 bytes; matches never cross documents; strings are judged on the input. If the first copy is kept,
    only strings that also start earlier count: in a smaller doc_id (of equal ones, by the hash of the text), or
    further left in the same document. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, the kept bytes
    as text (characters that were cut through are dropped); and the other columns of docs named in keep.

    Nulls: a null text is empty; a null doc_id stays null. Each row is a document of its own: the texts of
    repeated rows are copies of each other, and all go; if the first copy is kept, they are one document. Other columns are ignored; an empty table gives
    no rows.
    """
    spans = copied_spans(keyed(docs), window, gram, keep_first, often)

    def cut(batches):
        for batch in (part for whole in batches for part in tk.slices(whole, "text")):
            rows = []
            for nid, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, kept, at = text.encode(), [], 0
                runs = merged([(x["s"], x["e"]) for x in found or ()])
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                body = b"".join([*kept, raw[at:]])
                row = (real_id(nid), len(raw), len(raw) - len(body), len(runs), hashlib.sha256(body).hexdigest())
                rows.append(row + ((body.decode("utf-8", "ignore"),) if with_text else ()))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.string()] * with_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * with_text
            cols = list(zip(*rows)) or [()] * len(kinds)
            kept_cols = [batch.column(3 + i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, kinds)], *kept_cols], names=[*names, *keep])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return with_spans(docs, spans, keep).mapInArrow(tk.lean(cut), schema)
