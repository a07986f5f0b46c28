"""Exact, cached encoding with public tokenizer files, for use inside tasks.

A text is cut into units that the tokenizer never joins with their neighbours, so its ids are the
ids of its units, one after the other. Each unit that a worker has not met goes to the library;
repeated units are looked up, for all units of a slice of rows at once: by a 64-bit hash, and then by their bytes.
"""

from __future__ import annotations

import os

import numpy as np

from sessionloom.llm import textkit as tk

#: Units kept by one Python worker before its table starts afresh.
CACHE_UNITS = 1_500_000


class UnitTable:
    """64-bit unit hash -> entry number, with open addressing; entries index pools of values."""

    def __init__(self, bits: int = 22):
        self.mask = np.uint64((1 << bits) - 1)
        self.key = np.zeros(1 << bits, np.uint64)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        s = (h & self.mask).astype(np.int64)
        idx = self.slot[s]
        off = np.flatnonzero((idx >= 0) & (self.key[s] != h))
        while len(off):
            s[off] = (s[off] + 1) & int(self.mask)
            idx[off] = self.slot[s[off]]
            off = off[(idx[off] >= 0) & (self.key[s[off]] != h[off])]
        return idx

    def add(self, h: np.ndarray) -> None:
        """Gives new, distinct hashes the entries n, n + 1, ..."""
        todo, s = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(todo):
            free = self.slot[s[todo]] < 0
            s[todo[~free]] = (s[todo[~free]] + 1) & int(self.mask)
            _, win = np.unique(s[todo[free]], return_index=True)
            won = todo[free][win]
            self.key[s[won]], self.slot[s[won]] = h[won], (self.n + won).astype(np.int32)
            todo = np.setdiff1d(todo, won, assume_unique=True)
        self.n += len(h)


class Pool:
    """Runs of values, one for each entry."""

    def __init__(self, dtype):
        self.values, self.start, self.used, self.n = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(flat) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.n + len(counts) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.values[self.used : self.used + len(flat)] = flat
        self.start[self.n + 1 : self.n + len(counts) + 1] = self.used + np.cumsum(counts)
        self.used, self.n = self.used + len(flat), self.n + len(counts)

    def take(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these entries, joined, and the end of each run."""
        begin = self.start[idx]
        counts = self.start[idx + 1] - begin
        ends = np.cumsum(counts)
        at = np.repeat(begin - (ends - counts), counts)
        at += np.arange(len(at))
        return self.values[at], ends


class UnitCache:
    """Numbers of byte strings that have been met. learn(list of new byte strings) gives them the next numbers.

    A hit by hash counts only if its bytes are the same; units of another text's hash are kept beside the table.
    """

    def __init__(self, learn, forget, most: int, bits: int = 22):
        self.learn, self.forget, self.most, self.bits = learn, forget, most, bits
        self.clear()

    def clear(self) -> None:
        self.table, self.bytes, self.beside = UnitTable(self.bits), Pool(np.uint8), {}
        self.forget()

    def _add(self, units: list[bytes], hashes: np.ndarray | None) -> None:
        self.learn(units)
        self.bytes.add(np.frombuffer(b"".join(units), np.uint8), np.array([len(u) for u in units], np.int64))
        if hashes is None:
            self.table.n += len(units)
        else:
            self.table.add(hashes)

    def same(self, idx: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each unit has the bytes of its entry."""
        size = end - start
        at = self.bytes.start[idx]
        ok = self.bytes.start[idx + 1] - at == size
        mine, kept = tk.words_of_8(data), tk.words_of_8(self.bytes.values[: self.bytes.used])
        for i in range(tk.SHORT // 8):
            # strings of one length up to 8 differ in their hashes already
            more = np.flatnonzero(ok & (size > 8 * max(i, 1)))
            if not len(more):
                break
            ok[more] = tk.block(mine, start[more], size[more], i) == tk.block(kept, at[more], size[more], i)
        for k in np.flatnonzero(ok & (size > tk.SHORT)).tolist():
            ok[k] = np.array_equal(data[start[k] : end[k]], self.bytes.values[at[k] : at[k] + size[k]])
        return ok

    def entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = tk.span_hash(data, start, end)
        if not len(h):
            return np.zeros(0, np.int64)
        idx = self.table.find(h)
        miss = np.flatnonzero(idx < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            if self.table.n and self.table.n + len(new) > self.most:
                self.clear()
                return self.entries(data, start, end)
            if 2 * len(new) > len(self.table.slot):
                self.table = UnitTable(len(new).bit_length() + 1)
            at = miss[first]
            self._add([data[s:e].tobytes() for s, e in zip(start[at].tolist(), end[at].tolist())], new)
            idx[miss] = self.table.find(h[miss])
        idx = idx.astype(np.int64)
        for k in np.flatnonzero(~self.same(idx, data, start, end)).tolist():
            unit = data[start[k] : end[k]].tobytes()
            if unit not in self.beside:
                self.beside[unit] = self.table.n
                self._add([unit], None)
            idx[k] = self.beside[unit]
        return idx


class WordBpe:
    """A word-level BPE of the tokenizers library that folds case and drops white space before it merges.

    Cuts: at white space, and between ASCII letters, digits and marks. Its pre-tokeniser cuts there
    too, but for contractions: words with an apostrophe stay whole. ASCII capitals are folded first,
    as its normaliser does. Rows with "<|", where a special token may stand, go to the library whole.
    """

    KIND = np.zeros(256, np.uint8)
    KIND[33:127] = 3
    KIND[[*range(65, 91), *range(97, 123)]] = 1
    KIND[48:58] = 2

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.final = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.final[i] = token.endswith("</w>")
        self.cache = UnitCache(self._learn, self._forget, CACHE_UNITS)

    def _forget(self) -> None:
        self.ids = Pool(np.uint32)

    def _learn(self, units: list[bytes]) -> None:
        self.ids.add(*self._library([u.decode("utf-8", "replace") for u in units]))

    def _library(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units; runs of ASCII letters share calls, as each ends with its only word-final id."""
        plain = np.array([u.isascii() and u.isalpha() for u in units], dtype=bool)
        out: list = [None] * len(units)
        at = np.flatnonzero(plain)
        for k in range(0, len(at), 4000):
            some = at[k : k + 4000]
            enc = self.library.encode_batch_fast([" ".join([units[i] for i in some])], add_special_tokens=False)
            ids = np.array(enc[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("this tokenizer does not end each word with one word-final id")
            for i, part in zip(some, np.split(ids, ends[:-1])):
                out[i] = part
        at = np.flatnonzero(~plain)
        for i, e in zip(at, self.library.encode_batch_fast([units[i] for i in at], add_special_tokens=False)):
            out[i] = np.array(e.ids, dtype=np.uint32)
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a string column, joined, and the bounds of each row in them."""
        words = tk.Words(column, lower=True)
        data, kind = words.data, self.KIND[words.data]
        cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1 if len(data) else np.zeros(0, np.int64)
        quote = np.flatnonzero(data == 39)
        word_of = np.searchsorted(words.start, cut, side="right") - 1
        keep = words.end[word_of] > cut if len(cut) else np.zeros(0, bool)
        if len(quote):
            whole = np.zeros(len(words.start), bool)
            whole[np.searchsorted(words.start, quote, side="right") - 1] = True
            keep &= ~whole[word_of]
        keep &= words.start[word_of] < cut if len(cut) else keep
        cut = cut[keep]
        start = np.sort(np.concatenate([words.start, cut]))
        end = np.sort(np.concatenate([words.end, cut]))
        flat, ends = self.ids.take(self.cache.entries(data, start, end))
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, words.off)]
        raw = tk.text_bytes(column)[0].tobytes()
        if b"<|" in raw:
            return self._whole(raw, words.off, flat, bounds)
        return flat, bounds

    def _whole(self, raw, off, flat, bounds):
        parts = []
        for i, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            if b"<|" in raw[s:e]:
                parts.append(np.array(self.library.encode(raw[s:e].decode(), add_special_tokens=False).ids, dtype=np.uint32))
            else:
                parts.append(flat[bounds[i] : bounds[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The encoder of this Python worker; its table lasts from task to task."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
