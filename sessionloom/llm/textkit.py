"""Vectorised byte and word views of an Arrow text column, used inside tasks."""

from __future__ import annotations

import ctypes
import inspect
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}
#: Masks of the first 0..8 bytes of a little-endian word, and the bytes that are hashed in words of 8.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
SHORT = 64


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the next call."""
    have = _powers.get(name)
    if have is None or len(have) < n + 1:
        size = (int(n) | 0xFFFF) + 1
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def release() -> None:
    """Gives back to the system what this process has freed, and the powers that it keeps (two tables of 8 bytes for each byte of a slice)."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _released(out):
    release()
    return out


def lean(f):
    """f of a task (a generator of batches) or of a group, which gives its memory back when it has ended.

    Python workers outlive their tasks, and idle ones share an executor's memory with those at work.
    """
    if inspect.isgeneratorfunction(f):

        def run(batches):
            yield from f(batches)
            release()

        return run
    if len(inspect.signature(f).parameters) == 1:
        return lambda pdf: _released(f(pdf))
    return lambda key, pdf: _released(f(key, pdf))


def slices(batch: pa.RecordBatch, column: str, most: int = 3 << 20):
    """Row ranges of a batch whose texts have about `most` bytes (one long text may have more)."""
    if batch.num_rows == 0:
        return
    _, off = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (nulls are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with p[i] = sum of data[j] * R**j for j < i, modulo 2**64."""
    p = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_R, len(data), "r")[:-1], out=p[1:])
    return p


def rolling_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the byte strings data[start:end], the same wherever they stand.

    There are known texts with equal hashes (a polynomial modulo 2**64 cannot tell some regular strings apart), so they
    choose places and propose matches; what they propose is decided by bytes.
    """
    inv = _power(_R_INV, len(p), "i")
    return mix((p[end] - p[start]) * inv[start] + (end - start).astype(np.uint64) * _M)


def words_of_8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place of data on as a little-endian word (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def block(eight: np.ndarray, start: np.ndarray, size: np.ndarray, i: int) -> np.ndarray:
    """The i-th 8 bytes of byte strings of these sizes, zeros after their ends."""
    return eight[start + 8 * i] & _FIRST[np.minimum(size - 8 * i, 8)]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end].

    Every 8 bytes are mixed in by a bijection before the next are added, so strings of one length up to 8 never
    share a hash, and others do so by chance alone. Long strings go through XXH3.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    eight, size = words_of_8(data), end - start
    h = mix(block(eight, start, size, 0) ^ (size.astype(np.uint64) * _M))
    for i in range(1, SHORT // 8):
        more = np.flatnonzero(size > 8 * i)
        if not len(more):
            return h
        h[more] = mix(h[more] * _R + block(eight, start[more], size[more], i))
    for k in np.flatnonzero(size > SHORT).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].data, 0x51ED270B)
    return h


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each row: byte bounds, 64-bit hashes, first word of each row."""

    def __init__(self, col, lower: bool = False):
        data, off = text_bytes(col)
        if lower:
            data = LOWER[data]
        solid = ~SPACE[data]
        begin, final = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        final[:-1] &= ~solid[1:]
        cut = off[(off > 0) & (off < len(data))]
        begin[cut] = solid[cut]
        final[cut - 1] = solid[cut - 1]
        self.data, self.off = data, off
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(final) + 1
        self.first = np.searchsorted(self.start, off)

    @cached_property
    def hash(self) -> np.ndarray:
        return span_hash(self.data, self.start, self.end)

    @cached_property
    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows by the index of their first word, and which of them stay in a row."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        return run_hash(self.hash, k, salt), self.row[: n - k + 1] == self.row[k - 1 :]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _R + right)


def run_hash(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of k entries: of lengths 1, 2, 4, ... by joining two halves, then of k by its binary digits."""
    n = len(h) - k + 1
    power, width, out, done = mix(h ^ np.uint64(salt)) if salt else h, 1, None, 0
    while True:
        if k & width:
            # longer parts stand further left
            piece = power[k - done - width : k - done - width + n]
            out = piece if out is None else _joined(piece, out)
            done += width
        if width * 2 > k:
            break
        power = _joined(power[:-width], power[width:])
        width *= 2
    return mix(out + np.uint64(k))


def sequence_hash(h: np.ndarray) -> np.uint64:
    """One hash of a whole short sequence of hashes."""
    g = np.array([len(h)], dtype=np.uint64)
    for x in h:
        g = mix(g * _R + x)
    return mix(g + np.uint64(0x5851F42D4C957F2D))[0]


def window_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w consecutive entries."""
    n = len(h)
    if n < w:
        return np.zeros(0, h.dtype)
    pad = -n % w
    x = np.concatenate([h, np.full(pad, np.iinfo(h.dtype).max, h.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def in_bitmap(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether the slot of the top bits of each hash is set; bitmap holds 2**bits bits in uint32 words."""
    slot = h >> np.uint64(64 - bits)
    return (bitmap[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def occupied(target: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values of a sorted array: the parts that a slice has something for, however many there are in all."""
    if not len(target):
        return []
    begin = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    return list(zip(target[begin].tolist(), begin.tolist(), np.append(begin[1:], len(target)).tolist()))
