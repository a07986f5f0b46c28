"""Best-fit packing of tokenized documents into sequences of a fixed length (best-two-fit)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import textkit as tk
from sessionloom.llm.common import written

#: Pieces that one task packs together. Groups are dealt at random; each leaves about one open sequence.
GROUP_PIECES = 1 << 16


def best_two_fit(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length (1..capacity).

    A bin takes the longest piece that fits until none does. Then its smallest piece gives way to
    the two unpacked pieces that fill the widened gap best, if they fill more of it. The unpacked
    pieces are counts by length, with a bit mask of the lengths that are left.
    """
    order = np.argsort(np.asarray(lengths, dtype=np.int64), kind="stable")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order.tolist():
        stacks[lengths[i]].append(i)
    left = sum(1 << n for n in range(1, capacity + 1) if stacks[n])
    low = [(2 << n) - 1 for n in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal left
        i = stacks[n].pop()
        if not stacks[n]:
            left &= ~(1 << n)
        return i

    number = 0
    while left:
        chosen, gap = [], capacity
        while n := (left & low[gap]).bit_length() - 1 if left & low[gap] else 0:
            chosen.append(take(n))
            gap -= n
        if gap and len(chosen) > 1:
            small = lengths[chosen[-1]]
            room, best, pair = gap + small, small, None
            x = (left & low[room]).bit_length() - 1 if left & low[room] else 0
            while x > 0 and 2 * x > best:
                rest = left & low[min(room - x, x)]
                if rest >> x & 1 and len(stacks[x]) < 2:
                    rest &= ~(1 << x)
                y = rest.bit_length() - 1
                if rest and x + y > best:
                    best, pair = x + y, (x, y)
                    if best == room:
                        break
                x = (left & (low[x] >> 1)).bit_length() - 1
            if pair:
                back = chosen.pop()
                chosen += [take(pair[0]), take(pair[1])]
                stacks[small].append(back)
                left |= 1 << small
        at = 0
        for i in chosen:
            bins[i], offsets[i] = number, at
            at += lengths[i]
        number += 1
    return bins, offsets


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the ids as binary, if asked for)."""

    def encode(batches):
        from sessionloom.llm.tokenizing import word_bpe

        bpe = word_bpe(tokenizer)
        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                flat, bounds = bpe.encode(part.column(1))
                rows: list[tuple] = []
                end = np.array([end_id], dtype=np.uint32)
                for doc, s, e in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    ids = np.concatenate([flat[s:e], end]).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        raw = ids[at : at + capacity].tobytes()
                        rows.append((doc, k, at, len(raw) // 4, zlib.crc32(raw)) + ((raw,) if with_ids else ()))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tk.lean(encode), schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """Packs docs(doc_id, text, ...) into sequences of at most `capacity` tokens.

    Each document is its ids followed by end_id. Only longer ones are cut, into pieces of
    `capacity`; the last may be shorter. The pieces (a few numbers each) are written once, dealt at
    random into groups of about group_pieces, and every group is packed by best-two-fit in one task.

    Nulls: a null text is empty (one token, end_id); a null doc_id stays null. Repeated rows and ids
    are packed row by row. An empty table gives no rows. Other columns are ignored.
    Returns doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.
    """
    pieces = written(tokenized_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    groups = -(-max(1, pieces.count()) // group_pieces)

    def pack(pdf):
        bins, offsets = best_two_fit(pdf["length"].tolist(), capacity)
        return pdf.assign(sequence_id=pdf["g"].to_numpy(np.int64) * (1 << 32) + bins, offset=offsets).drop(columns="g")

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("g").applyInPandas(tk.lean(pack), schema)
