"""A Spark data source for session logs: `spark.read.format("session_logs")` and `spark.readStream.format("session_logs")`.

Rows: path, seq, value, readable, modified (epoch milliseconds of the file). Files are listed on the driver, as Spark's own
file index does, and dealt to partitions by size; a task reads a file as a stream of decompressed lines, so neither a file nor a
session has to fit in memory. Filters on `path` leave files out before they are opened. A stream's offset is the last
file by time of change and path; a log that has grown comes again, whole.

Files are opened with Arrow's file systems (local and mounted paths, hdfs, s3, gs). For a store that only Spark reads,
`session_logs.read_session_logs` goes through Spark's binary files.
"""

from __future__ import annotations

import fnmatch
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "path string, seq long, value string, readable boolean, modified long"
#: Lines and characters of one batch; compressed bytes of one partition; characters that are read at a time.
BATCH_LINES, BATCH_CHARS, PART_BYTES, READ_CHARS = 4_096, 8 << 20, 64 << 20, 1 << 20


@dataclass(frozen=True)
class LogFile:
    path: str
    size: int
    modified: int


@dataclass
class Files(InputPartition):
    files: list[LogFile]

    def __post_init__(self) -> None:
        self.value = None


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def list_files(root: str, pattern: str) -> list[LogFile]:
    """The files under root whose names fit the pattern, by time of change and path."""
    from pyarrow import fs

    store, base = _store(root)
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    files = [LogFile(f.path, f.size or 0, (f.mtime_ns or 0) // 1_000_000) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern)]
    return sorted(files, key=lambda f: (f.modified, f.path))


def dealt(files: list[LogFile], most: int = PART_BYTES) -> list[Files]:
    """Files in runs of about that many bytes; a larger file is a partition of its own."""
    out, run, size = [], [], 0
    for f in files:
        if run and size + f.size > most:
            out.append(Files(run))
            run, size = [], 0
        run.append(f)
        size += f.size
    return out + ([Files(run)] if run else [])


def text_stream(root: str, path: str) -> io.TextIOBase:
    raw = _store(root)[0].open_input_stream(path, compression=None)
    if path.endswith((".zst", ".zstd")):
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n")


def log_lines(root: str, file: LogFile) -> Iterator[tuple]:
    """(path, seq, value, readable) of a log's lines. A damaged file is left out whole, so it is read through first."""
    import zstandard

    try:
        with text_stream(root, file.path) as lines:
            while lines.read(READ_CHARS):
                pass
    except (zstandard.ZstdError, EOFError):
        yield file.path, 0, None, False
        return
    with text_stream(root, file.path) as lines:
        for n, line in enumerate(lines):
            yield file.path, n, line.rstrip("\r\n"), True


class JsonStream:
    """Reads one JSON value after the other from a stream of characters, with the text of the value at hand only."""

    SPACE = " \t\r\n"

    def __init__(self, read):
        self.read, self.held, self.at, self.ended = read, "", 0, False
        self.decoder = json.JSONDecoder()

    def more(self) -> bool:
        part = "" if self.ended else self.read(max(READ_CHARS, len(self.held) - self.at))
        self.ended = not part
        self.held, self.at = self.held[self.at :] + part, 0
        return bool(part)

    def peek(self) -> str:
        """The next character that is no blank; '' at the end."""
        while True:
            while self.at < len(self.held):
                if self.held[self.at] not in self.SPACE:
                    return self.held[self.at]
                self.at += 1
            if not self.more():
                return ""

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"no {wanted} in the JSON")
        self.at += 1

    def value(self) -> str:
        """The text of the next value."""
        self.peek()
        while True:
            try:
                end = self.decoder.raw_decode(self.held, self.at)[1]
                if end < len(self.held) or not self.more():  # a number may go on
                    out, self.at = self.held[self.at : end], end
                    return out
            except ValueError:
                if not self.more():
                    raise

    def members(self) -> Iterator[str]:
        """The names of an object; the reader takes each value before the next name."""
        self.take("{")
        if self.peek() != "}":
            while True:
                name = json.loads(self.value())
                self.take(":")
                yield name
                if self.peek() != ",":
                    break
                self.at += 1
        self.take("}")

    def items(self) -> Iterator[str]:
        """The texts of an array's values."""
        self.take("[")
        if self.peek() != "]":
            while True:
                yield self.value()
                if self.peek() != ",":
                    break
                self.at += 1
        self.take("]")


def _envelope(stream: JsonStream, out: list) -> Iterator[tuple[str, str]]:
    """('header' or 'event', text) of the snapshot that comes next, events as they are read; out gets what else was told."""
    for name in stream.members():
        if name == "snapshot" and stream.peek() == "{":
            yield from _envelope(stream, out)
        elif name == "events" and stream.peek() == "[":
            out.append("events")
            for event in stream.items():
                yield "event", event
        else:
            value = stream.value()
            if name == "session" and value.startswith("{"):
                yield "header", value
            elif name in ("schema", "operation"):
                out.append(name)


def snapshot_rows(root: str, file: LogFile) -> Iterator[tuple]:
    """(path, seq, value, readable) of a file of snapshots {session, events}, bare or in an envelope {kind, snapshot}; the header is row 0.

    The file is read twice: first for what each snapshot is, then for its events. A request line {schema, operation} is passed over; what is no
    snapshot is one row that is not readable. What stands after a broken value cannot be told apart, and is one such row too.
    """
    known: list[dict | None] = []
    with text_stream(root, file.path) as text:
        stream = JsonStream(text.read)
        while stream.peek():
            told, header, events = [], None, 0
            try:
                if stream.peek() == "{":
                    for kind, value in _envelope(stream, told):
                        header, events = (value, events) if kind == "header" else (header, events + 1)
                else:
                    stream.value()
            except (ValueError, RecursionError):
                known.append(None)
                break
            if {"schema", "operation"} <= set(told) and header is None:
                known.append({})
            else:
                known.append({"header": header} if header is not None and "events" in told else None)
    with text_stream(root, file.path) as text:
        stream = JsonStream(text.read)
        for n, one in enumerate(known):
            if one is None:
                yield f"{file.path}#{n}", 0, None, False
                if n == len(known) - 1:
                    return  # perhaps broken
            name = None
            if one:
                header = json.loads(one["header"])
                name = f"{file.path}#{header.get('id') or f'stream-{n:06d}'}"
                yield name, 0, json.dumps({"type": "session", **{k: v for k, v in header.items() if k != "type"}}), True
            seq = 0
            for kind, value in _envelope(stream, []) if stream.peek() == "{" else [("other", stream.value())]:
                if name and kind == "event":
                    seq += 1
                    yield name, seq, value, True


def batches(root: str, kind: str, files: list[LogFile]) -> Iterator[pa.RecordBatch]:
    """The rows of files in batches of a bounded size."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
    names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    rows, chars = [], 0
    for file in files:
        for row in snapshot_rows(root, file) if kind == "snapshots" else log_lines(root, file):
            value = row[2] and row[2].encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            rows.append((row[0], row[1], value, row[3], file.modified))
            chars += len(value or "")
            if len(rows) == BATCH_LINES or chars > BATCH_CHARS:
                yield batch(rows)
                rows, chars = [], 0
    if rows:
        yield batch(rows)


class LogReader(DataSourceReader):
    def __init__(self, root: str, kind: str, pattern: str, part_bytes: int):
        self.root, self.kind, self.pattern, self.part_bytes, self.tests = root, kind, pattern, part_bytes, []

    def pushFilters(self, filters):
        """Filters on the path of a log leave files out; Spark applies all of them again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and self.kind == "logs":
                if isinstance(f, EqualTo):
                    self.tests.append(lambda p, v=f.value: p == v)
                elif isinstance(f, In):
                    self.tests.append(lambda p, v=f.value: p in v)
                elif isinstance(f, StringStartsWith):
                    self.tests.append(lambda p, v=f.value: p.startswith(v))
                elif isinstance(f, StringEndsWith):
                    self.tests.append(lambda p, v=f.value: p.endswith(v))
                elif isinstance(f, StringContains):
                    self.tests.append(lambda p, v=f.value: v in p)
            yield f

    def partitions(self) -> list[Files]:
        files = [f for f in list_files(self.root, self.pattern) if all(t(f.path) for t in self.tests)]
        self.tests = []  # tasks need none of them
        return dealt(files, self.part_bytes) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches(self.root, self.kind, partition.files)


class LogStreamReader(DataSourceStreamReader):
    """Files in the order of their last change. settle: files changed in the last so many milliseconds wait for a later batch."""

    def __init__(self, root: str, kind: str, pattern: str, part_bytes: int, settle: int):
        self.root, self.kind, self.pattern, self.part_bytes, self.settle = root, kind, pattern, part_bytes, settle

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        import time

        ready = [f for f in list_files(self.root, self.pattern) if f.modified <= time.time() * 1000 - self.settle]
        return {"modified": ready[-1].modified, "path": ready[-1].path} if ready else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        key = lambda o: (o["modified"], o["path"])
        return dealt([f for f in list_files(self.root, self.pattern) if key(start) < (f.modified, f.path) <= key(end)], self.part_bytes)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches(self.root, self.kind, partition.files)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class SessionLogs(DataSource):
    """Options: path; kind (logs or snapshots); pattern of file names; partBytes; settleMs (streams)."""

    @classmethod
    def name(cls) -> str:
        return "session_logs"

    def schema(self) -> str:
        return SCHEMA

    def _told(self) -> tuple:
        kind = self.options.get("kind", "logs")
        if kind not in ("logs", "snapshots"):
            raise ValueError("kind is logs or snapshots")
        pattern = self.options.get("pattern", "session.jsonl.zst*" if kind == "logs" else "*.jsonl*")
        return self.options["path"], kind, pattern, int(self.options.get("partBytes", PART_BYTES))

    def reader(self, schema) -> LogReader:
        return LogReader(*self._told())

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(*self._told(), int(self.options.get("settleMs", 0)))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SessionLogs)
