"""Plain Python restatements of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def jaccard(docs):
    sets = {}
    for i, (doc, text) in enumerate(docs):
        w = WORD.findall(lower(text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    shared = Counter()
    for members in where.values():
        m = sorted(members)
        for a in range(len(m)):
            for b in range(a + 1, len(m)):
                shared[m[a], m[b]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if sets[i] and doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def bytes_dedup(docs, window, keep_first=False):
    """keep_first: docs with distinct ids."""
    seen, first = Counter(), {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        raw = (text or "").encode()
        for i in range(len(raw) - window + 1):
            x = raw[i : i + window]
            seen[x] += 1
            first.setdefault(x, (doc, i))
    out = []
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            x = raw[i : i + window]
            if seen[x] > 1 and not (keep_first and first[x] == (doc, i)):
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def word_dedup(docs, window):
    """docs with distinct ids."""
    first = {}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    split = {d: WORD.findall(t or "") for d, t in order}
    for d, _ in order:
        w = split[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = []
    for d, _ in order:
        w = split[d]
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def base_stats(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
                    len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    return sorted(out, key=str)


def token_rows(docs, path, end_id):
    """(doc_id, start, n_tokens, crc) in ascending order of distinct ids."""
    import numpy as np
    from tokenizers import Tokenizer

    t, out, at = Tokenizer.from_file(path), [], 0
    for d, text in sorted(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out
