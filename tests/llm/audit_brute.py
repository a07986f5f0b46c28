"""Plain forms of the audits: divergence, the prefix trie, secret scans."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def divergence(docs, min_docs=30, top=50):
    """docs: (text, lang, source)"""
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, terms = lang or "", TERM.findall((text or "").translate(FOLD))
        counts[lang, source or ""].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in counts}:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        p, have = {}, {}
        for name, some in [(s, [s]) for x, s in counts if x == lang] + [(None, [s for x, s in counts if x == lang])]:
            n = have[name] = {t: sum(counts[lang, s][t] for s in some) for t in kept}
            p[name] = {t: 1 + 1_000_000_000 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}
        for s in (x for x in p if x is not None):
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o not in (None, s)]
            terms = [(p[s][t] - p[None][t], t) for t in kept if have[s][t] > 0 and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def trie(rows):
    """rows: (conv_id, turn, role, text)"""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(xs)] for c, xs in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    digest = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], digest(ends[n])) for n, m in members.items()), key=str
    )


def secrets(docs, rules):
    out = []
    for i, text in docs:
        found = []
        for place, r in enumerate(rules):
            for m in re.finditer(r.regex, text or "", re.ASCII):
                if len(m.group(r.group)) >= r.least:
                    found.append((m.start(), place, r.kind, m.end()))
        told = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        n = Counter(k for _, _, k, _ in found)
        out.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(told([x for x in found if x[1] < 3]).encode()).hexdigest(), told(found)))
    return sorted(out, key=str)
