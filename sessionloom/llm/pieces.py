"""SentencePiece encoding and decoding with the byte span of every piece in the original text."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import textkit as tk
from sessionloom.llm.tokenizing import UnitCache

MARK = "▁".encode()
CACHE_UNITS = 500_000


class CharsMap:
    """A compiled character map: a double-array trie of byte strings and their normal forms."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=n // 4, offset=4).tolist() if n else []
        self.forms = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, normal form) of the longest key that starts at `at`."""
        if not self.units:
            return None
        u = self.units
        node, found = 0, None
        node ^= _offset(u[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(u) or (u[node] & 0x800000FF) != text[i]:
                break
            unit = u[node]
            node ^= _offset(unit)
            if unit >> 8 & 1:
                value = u[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.forms[value : self.forms.index(b"\0", value)])
        return found


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Pieces:
    """One sentencepiece model: normalisation with alignment, encoding, decoding."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.spec, self.map = model.normalizer_spec, CharsMap(model.normalizer_spec.precompiled_charsmap)
        plain = not self.map.units and self.spec.add_dummy_prefix and self.spec.escape_whitespaces and not self.spec.remove_extra_whitespaces
        surfaces = [p.piece.replace("▁", " ") for p in model.pieces if p.type != p.BYTE]
        #: Pairs of bytes that some piece holds side by side. Between other pairs nothing is ever merged.
        self.pairs = np.zeros((256, 256), bool)
        for raw in map(str.encode, surfaces):
            self.pairs[list(raw[:-1]), list(raw[1:])] = True
        self.break_id = self.library.piece_to_id("<0x0A>")
        #: Blanks are kept as they are and no piece holds a line break: texts may be cut into units.
        self.by_units = plain and model.trainer_spec.byte_fallback and not any("\n" in x for x in surfaces)
        self.names = [b"%d," % i for i in range(len(model.pieces))]
        self.pieces = [p.piece for p in model.pieces]
        self.cache = UnitCache(self._learn_all, self._forget, CACHE_UNITS, 21)

    def _forget(self) -> None:
        self.counts: list[int] = []
        self.decimals: list[bytes] = []
        self.decoded: list[bytes] = []
        self.spans: list[bytes] = []

    def normalise(self, text: bytes, prefix: bool = True) -> tuple[bytes, list[int]]:
        """The normal form, and for each of its bytes (and its end) the source byte that it came from.

        prefix: whether the text is the beginning of one, where the model may put a blank of its own.
        """
        out, src, at = bytearray(), [], 0
        strip = self.spec.remove_extra_whitespaces
        blank = MARK if self.spec.escape_whitespaces else b" "

        def form(at: int) -> tuple[int, bytes]:
            if found := self.map.longest(text, at):
                return found
            if not self.map.units:  # no key begins anywhere: all up to the next blank stays as it is
                end = text.find(b" ", at)
                n = 1 if end == at else (end if end > 0 else len(text)) - at
                return n, text[at : at + n]
            lead = text[at]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return n, text[at : at + n]

        if strip:
            while at < len(text) and form(at)[1].strip(b" ") == b"":
                at += form(at)[0]
        if prefix and at < len(text) and self.spec.add_dummy_prefix:
            out += blank
            src += [at] * len(blank)
        spaced = strip
        while at < len(text):
            n, new = form(at)
            if strip and spaced:
                new = new.lstrip(b" ")
            if new:
                spaced = strip and new.endswith(b" ")
                same = new == text[at : at + n] and b" " not in new and not self.map.units
                put = new.replace(b" ", blank)
                out += put
                src += range(at, at + n) if same else [at] * len(put)
            at += n
        end = len(text)
        if strip:
            while out.endswith(blank):
                end = src[-len(blank)]
                del out[-len(blank) :], src[-len(blank) :]
        return bytes(out), [*src, end]

    def spans_of(self, text: bytes, pieces: list[str], prefix: bool = True) -> tuple[list[int], list[int]]:
        """Source byte bounds of each piece of the text's encoding."""
        norm, src = self.normalise(text, prefix)
        at, starts, ends = 0, [], []
        for i, piece in enumerate(pieces):
            raw = piece.encode()
            if norm[at : at + len(raw)] != raw:
                raw = norm[at : at + 1]  # a byte piece
            starts.append(src[at])
            at += len(raw)
            ends.append(src[at])
        if at != len(norm):
            raise ValueError("the pieces do not cover the normal form")
        return starts, ends

    def encode_text(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids, span starts and span ends of one text, without the unit table."""
        ids = self.library.encode(text)
        return (ids, *self.spans_of(text.encode(), self.library.encode(text, out_type=str)))

    def _learn_all(self, units: list[bytes]) -> None:
        for k in range(0, len(units), 2000):
            self._learn([u.decode() for u in units[k : k + 2000]])

    def _learn(self, units: list[str]) -> None:
        """Encodes and decodes many units in one call each, set apart by line breaks; aligns each with its normal form."""
        flat = np.array(self.library.encode("\n" + "\n".join(["" if u == "\n" else u for u in units])), dtype=np.int64)
        breaks = np.flatnonzero(flat == self.break_id)
        texts = self.library.decode(flat.tolist()).split("\n")[1:]
        if len(breaks) != len(units) or len(texts) != len(units):
            raise ValueError("a unit holds a line break")
        ids = flat.tolist()
        for u, s, e, text in zip(units, (breaks + 1).tolist(), [*breaks[1:].tolist(), len(flat)], texts):
            mine = ids[s:e] if u != "\n" else [self.break_id]
            starts, ends = self.spans_of(u.encode(), [self.pieces[i] for i in mine], prefix=False)
            self.counts.append(len(mine))
            self.decimals.append(b"".join([self.names[i] for i in mine]))
            self.decoded.append(text.encode() if u != "\n" else b"\n")
            self.spans.append(np.array([b - a for a, b in zip(starts, ends)], "<u4").tobytes())

    def rows(self, column):
        """(number of ids, comma-joined ids, decoded text, bytes covered by each piece) of each row.

        Piece lengths count the blank that stands for the library's prefix in the first piece.
        """
        data, off = tk.text_bytes(column)
        raw = data.tobytes()
        bounds = list(zip(off[:-1].tolist(), off[1:].tolist()))
        if not self.by_units:
            yield from (self._row(raw[s:e]) for s, e in bounds)
            return
        full = np.flatnonzero(np.diff(off) > 0)
        data = np.insert(data, off[:-1][full], 0x20)
        off = off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
        begin = np.ones(len(data), bool)
        begin[1:] = ~self.pairs[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        begin[off[:-1][full]] = True
        start = np.flatnonzero(begin)
        end = np.concatenate([start[1:], [len(data)]]) if len(start) else start
        idx = self.cache.entries(data, start, end)
        first = np.searchsorted(start, off).tolist()
        numbers = idx.tolist()
        counts = np.fromiter(map(self.counts.__getitem__, numbers), np.int64, len(numbers))
        total = np.concatenate([[0], np.cumsum(counts)])[first].tolist()
        for i, (s, e) in enumerate(bounds):
            if MARK in raw[s:e]:
                yield self._row(raw[s:e])
                continue
            mine = numbers[first[i] : first[i + 1]]
            yield (
                total[i + 1] - total[i],
                b"".join(map(self.decimals.__getitem__, mine))[:-1],
                b"".join(map(self.decoded.__getitem__, mine))[1:],
                b"".join(map(self.spans.__getitem__, mine)),
            )

    def _row(self, text: bytes):
        ids, starts, ends = self.encode_text(text.decode())
        lengths = np.array(ends, dtype=np.int64) - np.array(starts, dtype=np.int64) if ids else np.zeros(0, np.int64)
        if len(lengths) and self.spec.add_dummy_prefix:
            lengths[0] += 1
        return len(ids), ",".join(map(str, ids)).encode(), self.library.decode(ids).encode(), lengths.astype("<u4").tobytes()


_loaded: dict[str, Pieces] = {}


def pieces_model(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """Encodes docs(doc_id, text, ...): ids, starts and ends (byte spans in the text) and the decoded text.

    A null text is empty (no ids, decoded to an empty text). Rows are treated one by one, so
    repeated rows and ids repeat in the result; other columns are ignored.
    """

    def run(batches):
        sp = pieces_model(model)
        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                ids, starts, ends, decoded = [], [], [], []
                if sp.by_units:
                    shift = 1 if sp.spec.add_dummy_prefix else 0
                    for _, a, b, c in sp.rows(part.column(1)):
                        end = np.maximum(np.cumsum(np.frombuffer(c, "<u4").astype(np.int64)) - shift, 0)
                        ids.append(np.array(a.split(b",") if a else [], dtype=np.int32))
                        starts.append(np.concatenate([[0], end[:-1]]) if len(end) else end)
                        ends.append(end)
                        decoded.append(b.decode())
                else:
                    for text in part.column(1).to_pylist():
                        mine, begin, end = sp.encode_text(text or "")
                        ids.append(mine)
                        starts.append(begin)
                        ends.append(end)
                        decoded.append(sp.library.decode(mine))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, longs), pa.array(ends, longs), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "starts", "ends", "decoded"],
                )

    return _doc_text(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_crc32 (of the bytes covered by each piece).

    A null text is empty (no ids, decoded to an empty text), a null doc_id stays null. Rows are treated one by one, so
    repeated rows and ids repeat in the result, in no order; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        sp = pieces_model(model)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                rows = [(n, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest(), zlib.crc32(c)) for n, a, b, c in sp.rows(part.column(1))]
                n, a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"],
                )

    return _doc_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")


def _doc_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
