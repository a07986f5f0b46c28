"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

A record file is a run of frames:

    u64 length | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload | "\\n"

Payload: u8 (1 if there is an id) | i64 doc_id | u32 number of ids | the ids, 2 bytes each where the
vocabulary allows, else 4. All little-endian. Spark's text writer puts the frames into files, so the
files appear by its commit protocol, on any file system that it writes to; the "\\n" is its separator.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm import textkit as tk
from sessionloom.llm.common import parts_for, written

HEAD = struct.Struct("<QI")
DOC = struct.Struct("<BqI")
CRC = struct.Struct("<I")


def masked(crc: int) -> int:
    """Rotates a checksum and adds a constant, so that checksums of checksums stay safe."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    payload = DOC.pack(doc_id is not None, doc_id or 0, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + CRC.pack(masked(zlib.crc32(size))) + payload + CRC.pack(masked(zlib.crc32(payload)))


def frames_of(data: bytes, wide: bool):
    """(offset, frame length, doc_id, ids) of each frame; raises where a checksum differs."""
    at = 0
    while at < len(data):
        size, crc = HEAD.unpack_from(data, at)
        if masked(zlib.crc32(data[at : at + 8])) != crc:
            raise ValueError(f"damaged length at byte {at}")
        payload = data[at + 12 : at + 12 + size]
        if masked(zlib.crc32(payload)) != CRC.unpack_from(data, at + 12 + size)[0]:
            raise ValueError(f"damaged record at byte {at}")
        has, doc_id, n = DOC.unpack_from(payload)
        ids = np.frombuffer(payload, dtype="<u4" if wide else "<u2", count=n, offset=DOC.size)
        yield at, size + 16, doc_id if has else None, ids
        at += size + 17


def write_records(docs: DataFrame, tokenizer: str, path: str, end_id: int, wide: bool = False) -> None:
    """Encodes docs(doc_id, text, ...) and writes record files under path, in ascending doc_id order.

    The raw texts are range-partitioned and sorted by (doc_id, hash of the text), so that each file
    holds one range of ids; repeated ids stand side by side, null ids first. A null text is empty:
    its record holds end_id alone. Other columns are ignored; an empty table gives no records.
    """

    def encode(batches):
        from sessionloom.llm.tokenizing import word_bpe

        bpe, end = word_bpe(tokenizer), np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                flat, bounds = bpe.encode(part.column(1))
                out = [
                    frame(doc, np.concatenate([flat[s:e], end]), wide)
                    for doc, s, e in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(parts_for(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    framed = ranged.select("doc_id", "text").mapInArrow(encode, "frame binary")
    framed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_records(spark: SparkSession, path: str, wide: bool = False, with_ids: bool = False) -> DataFrame:
    """One row per record: file, offset, length, doc_id, n_tokens, ids_crc32, before (ids before it in its file)[, ids].

    A damaged frame raises. A record without an id has a null doc_id; repeated ids and records are rows of their own, in
    the order of the file; a path without records gives no rows.
    """

    def parse(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cols: list[list] = [[] for _ in range(7 + with_ids)]
                name, before = batch.column(0)[i].as_py().rpartition("/")[2], 0
                for at, size, doc, ids in frames_of(batch.column(1)[i].as_py(), wide):
                    row = [name, at, size, doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before]
                    for c, v in zip(cols, row + [ids.astype(np.int32)] * with_ids):
                        c.append(v)
                    before += len(ids)
                kinds = [pa.string(), *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
                names = ["file", "offset", "length", "doc_id", "n_tokens", "ids_crc32", "before", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names[: len(cols)])

    schema = "file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, before long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, schema + ", ids array<int>" * with_ids)


def build_index(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """Reads the files back and writes the offset index; adds `start`, the ids of all records before each.

    Null and repeated ids are kept as in the files; a path without records gives an empty index.
    """
    records = written(read_records(spark, path, wide), "record-index")
    totals = records.groupBy("file").agg(F.sum("n_tokens").alias("t"))  # one row per file
    # by the numbers of the files: their names have five digits at least, so beyond part-99999 they do not sort as texts
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    base = totals.select("file", (F.sum("t").over(Window.orderBy(number, "file")) - F.col("t")).alias("base"))
    return records.join(base, "file").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int, wide: bool = False) -> DataFrame:
    """doc_id and ids of the records of `index` (any subset of it) in random order, by offset and length.

    The order is drawn over the index, a few numbers a record. Its entries are gathered by file, so that each file is read
    once, in one task, and its records are sent to their places; a file is about as large as a task of write_records.
    A null doc_id stays null; a record that is named twice comes twice; an empty index gives no rows. Order and
    numbers of partitions follow the seed alone.
    """

    def cut(batches):
        for batch in batches:
            for content, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                data, rows = memoryview(content.as_buffer()), []
                for x in wanted:
                    _, _, doc, ids = next(frames_of(bytes(data[x["offset"] : x["offset"] + x["length"]]), wide))
                    rows.append((x["turn"], doc, ids.astype(np.int32)))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["turn", "doc_id", "ids"])

    turn = F.xxhash64(F.lit(seed), "file", "offset")
    wanted = index.groupBy("file").agg(F.collect_list(F.struct("offset", "length", turn.alias("turn"))).alias("wanted"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    records = files.join(wanted, "file").select("content", "wanted").mapInArrow(cut, "turn long, doc_id long, ids array<int>")
    return records.orderBy("turn").select("doc_id", "ids")
