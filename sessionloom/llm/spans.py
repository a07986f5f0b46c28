"""What the two substring operators share: row keys, repeated anchors, and joining removed spans to texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import textkit as tk
from sessionloom.llm.common import parts_for, plan_bytes, tidy

#: Slots of the bitmap of repeated anchors, as a power of two: 2**26 bits are 8 MB, 2**30 are 128 MB. In between, a slot for 64 bytes of input.
BITMAP_BITS = (26, 30)
#: Tasks that count anchors, at most, as a power of two.
COUNTING_BITS = 20
#: Low bits of a winnowing key, for the position; the high bits order the grams.
PLACE = np.uint64((1 << 31) - 1)


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(nid, th, text, the columns to keep): the id with null as the smallest long, the hash of the text, null texts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    nid = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(nid.alias("nid"), F.xxhash64(text).alias("th"), text.alias("text"), *[F.col(f"`{c}`") for c in keep])


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """For each run of w grams, the index of its smallest (the first of equals)."""
    n = len(grams)
    if n < w:
        return np.zeros(0, np.int64)
    key = (grams & ~PLACE) | (np.arange(n, dtype=np.uint64) & PLACE)
    return (tk.window_minimum(key, w) & PLACE).astype(np.int64)


def bitmap_bits(docs: DataFrame) -> int:
    least, most = BITMAP_BITS
    return min(most, max(least, (plan_bytes(docs) >> 6).bit_length()))


def repeated_anchors(docs: DataFrame, anchors, slots: int, often: int | None = None):
    """Bitmap of the slots (2**slots in all) of anchor hashes that occur at least twice in all texts.

    anchors(column) gives the anchor hashes of a slice of rows. A task sends each hash of a slice once, with
    its count, in one binary value for each range of hashes. Winnowing takes the smallest
    hashes, so they are mixed anew to spread over all ranges and slots. With `often`, returns two bitmaps; the
    second has the slots of hashes that occur at least that many times.
    """
    parts = 1 << max(0, (min(parts_for(docs), 1 << COUNTING_BITS) - 1).bit_length())
    bits = parts.bit_length() - 1
    least = [2] if often is None else [2, often]

    def find(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                h, n = np.unique(tk.mix(anchors(part.column("text"))), return_counts=True)
                n = n.astype("<u4")
                some = tk.occupied(h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64))
                blobs = [h[s:e].tobytes() + n[s:e].tobytes() for _, s, e in some]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in some], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def count(pdf):
        import pandas as pd

        h = np.concatenate([np.frombuffer(b, "<u8", len(b) // 12) for b in pdf["blob"]])
        n = np.concatenate([np.frombuffer(b, "<u4", len(b) // 12, len(b) // 12 * 8) for b in pdf["blob"]])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        total, mine = np.add.reduceat(n, at), 1 << (slots - bits)
        slot = (h[at] >> np.uint64(64 - slots)).astype(np.int64) & (mine - 1)
        made = []
        for few in least:
            out = np.zeros(mine, bool)
            out[slot[total >= few]] = True
            made.append(np.packbits(out, bitorder="little").tobytes())
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [made]})

    rows = docs.select("text").mapInArrow(tk.lean(find), "part int, blob binary").repartition(parts, "part").groupBy("part")
    each = 1 << (slots - bits - 3)
    whole = [bytearray(1 << (slots - 3)) for _ in least]
    with tidy(docs.sparkSession):
        found = rows.applyInPandas(tk.lean(count), "part int, bits array<binary>").toArrow()  # 2**(slots - 3) bytes a bitmap: BITMAP_BITS bounds them
    for row in found.to_pylist():
        for bitmap, bits_of in zip(whole, row["bits"]):
            bitmap[row["part"] * each : (row["part"] + 1) * each] = bits_of
    return bytes(whole[0]) if often is None else (bytes(whole[0]), bytes(whole[1]))


def may_repeat(bitmap: np.ndarray, anchors: np.ndarray, slots: int) -> np.ndarray:
    """Whether each anchor hash may occur twice, by the bitmap of repeated anchors."""
    return tk.in_bitmap(bitmap, tk.mix(anchors), slots)


def with_spans(docs: DataFrame, spans: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs with its removed spans: nid, text, spans array<struct<s, e>> (null: none), the columns to keep."""
    gathered = spans.groupBy("nid", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rows = keyed(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"__{c}") for c in keep]), tuple(f"__{c}" for c in keep))
    return rows.join(gathered.hint("merge"), ["nid", "th"], "left").select("nid", "text", "spans", *[F.col(f"`__{c}`").alias(c) for c in keep])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with touching ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def real_id(nid: int) -> int | None:
    return None if nid == -(1 << 63) else nid
