"""Secret scans behind a trigram inverted index. DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query: alternatives, each a set of trigrams that every match of it
contains (lower case). The index has a posting for each document and trigram that some query asks for. Postings are
intersected per alternative; documents that meet one are candidates, and only their texts are searched with the rule. Rules without
mandatory trigrams search every text. Matches are the expression's, leftmost and not overlapping: the texts between them
and their own lengths, summed along the document, tell where they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import written

#: Alternatives that a query may have, and members of a character class that are told apart.
MOST_ALTERNATIVES, MOST_MEMBERS = 64, 8


@dataclass(frozen=True)
class Rule:
    """Matches of an expression (in the dialect that Java, RE2 and Python share) whose group has at least so many characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The three kinds that every scan reports.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # runs of [0-9a-f]+ with 32 or more characters
)
#: Further kinds: keys and tokens of common forms, and passwords in addresses.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("api", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}"),
    Rule("address", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{1,64}@"),
)
RULES = BASE + MORE


class _Texts:
    """Alternatives while an expression is read: the literal text that just ended there, and the trigrams so far."""

    def __init__(self):
        self.states: set[tuple[str, frozenset[str]]] = {("", frozenset())}

    def add(self, choices: list[str] | None) -> None:
        """One of these characters or texts comes next; None: something that may be anything."""
        if choices is not None and len(self.states) * len(choices) > MOST_ALTERNATIVES:
            choices = None
        if choices is None:
            self.states = {("", have) for _, have in self.states}
            return
        out = set()
        for run, have in self.states:
            for c in choices:
                longer = run + c
                out.add((longer[-2:], have | {longer[i : i + 3] for i in range(len(longer) - 2)}))
        self.states = out


def _members(items: list) -> list[str] | None:
    """The characters of a class, folded, if they are few and ASCII."""
    found = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            found.add(chr(arg).lower())
        elif name == "RANGE" and arg[1] < 128 and arg[1] - arg[0] < MOST_MEMBERS:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return sorted(found) if len(found) <= MOST_MEMBERS else None


def _read(pattern, texts: _Texts) -> None:
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            texts.add([chr(arg).lower()] if arg < 128 else None)
        elif name == "IN":
            texts.add(_members(arg))
        elif name == "SUBPATTERN":
            _read(arg[3], texts)
        elif name == "BRANCH":
            before, states = set(texts.states), set()
            for branch in arg[1]:
                texts.states = set(before)
                _read(branch, texts)
                states |= texts.states
            texts.states = states
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[:2] == (0, 1):
            before = set(texts.states)
            _read(arg[2], texts)
            texts.states |= before
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and 1 <= arg[0] <= MOST_MEMBERS:
            for _ in range(arg[0]):
                _read(arg[2], texts)
            if arg[1] != arg[0]:
                texts.add(None)
        elif not name.startswith(("AT", "ASSERT")):  # these have no width
            texts.add(None)
        if len(texts.states) > MOST_ALTERNATIVES:
            texts.add(None)


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives of trigrams: a text with a match has, folded, all trigrams of one of them. Empty: nothing is mandatory."""
    texts = _Texts()
    _read(_parser.parse(regex), texts)
    found = {have for _, have in texts.states}
    if frozenset() in found:
        return []
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)


def _one_of(trigrams: list[str]) -> str:
    """An expression that finds every place of a folded text at which one of the trigrams stands."""
    by_first: dict[str, list[str]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], []).append(t[1:])
    return "(?=(" + "|".join(re.escape(a) + "(?:" + "|".join(map(re.escape, rest)) + ")" for a, rest in sorted(by_first.items())) + "))"


def postings(texts: DataFrame, key: list[str], trigrams: list[str]) -> DataFrame:
    """(trigram, *key): the documents of texts(*key, text) in which each of the trigrams stands, capitals folded."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_one_of(trigrams)), F.lit(1)))
    return texts.select(F.explode(found).alias("trigram"), *key)


def candidates(index: DataFrame, key: list[str], queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(*key, kinds): the documents that meet the trigram query of a rule, with those rules.

    Alternatives are numbered, and their trigrams are bits; a document's bits are combined before and after the
    shuffle, so a posting list of nearly all documents is no larger group than another.
    """
    asked = [(kind, i, t, 1 << bit, (1 << len(a)) - 1) for kind, some in queries.items() for i, a in enumerate(some) for bit, t in enumerate(sorted(a))]
    wanted = index.sparkSession.createDataFrame(asked, "kind string, alternative int, trigram string, bit long, whole long")
    met = index.join(F.broadcast(wanted), "trigram").groupBy(*key, "kind", "alternative").agg(F.bit_or("bit").alias("bits"), F.first("whole").alias("whole"))
    return met.filter("bits = whole").groupBy(*key).agg(F.collect_set("kind").alias("kinds"))


def _hits(rule: Rule, place: int) -> Column:
    """All matches of a rule in `text`: (kind, i, gap, size, ok), gap being what lies between a match and the one before."""
    rx = F.lit(rule.regex)
    ok = lambda hit: F.length(F.regexp_extract(hit, rule.regex, rule.group) if rule.group else hit) >= rule.least
    both = F.zip_with(
        F.split("text", rule.regex, -1), F.regexp_extract_all("text", rx, F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), ok(hit).alias("ok"))
    )
    numbered = F.transform(both, lambda x, i: F.struct(F.lit(place).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["ok"].alias("ok")))
    return F.filter(numbered, lambda x: x["size"].isNotNull())


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(doc_id, text, ...) with `secrets`: an array of (start, place, kind, end), by start, then by the rules' order.

    start and end count code points, end exclusive; place is the rule's number. Matches whose group is too short are dropped, and
    still take the place that they stand in. A null text is an empty one; a null doc_id is an id like others. Repeated rows
    get the same spans. A column named secrets is replaced; others stay. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = {"__nid": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__th": F.xxhash64(text), "__tk": F.xxhash64(F.lit(1), text)}
    names = list(key)
    texts = docs.select(*[v.alias(k) for k, v in key.items()], text.alias("text"))
    asked = {r.kind: trigram_query(r.regex) for r in rules}
    queries = {k: v for k, v in asked.items() if v}
    found = []
    always = [_hits(r, i) for i, r in enumerate(rules) if r.kind not in queries]
    if always:
        found.append(texts.select(*names, F.inline(F.concat(*always))))
    if queries:
        index = postings(texts, names, sorted({t for some in queries.values() for a in some for t in a}))
        chosen = written(candidates(index, names, queries), "candidates")
        none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>")
        verified = [F.when(F.array_contains("kinds", r.kind), _hits(r, i)).otherwise(none) for i, r in enumerate(rules) if r.kind in queries]
        found.append(texts.join(chosen, names).select(*names, F.inline(F.concat(*verified))))
    hits = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    along = Window.partitionBy(*names, "kind").orderBy("i")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(along)
    # exact copies of a row have the same hits
    spans = hits.distinct().withColumn("end", end).filter("ok")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    span = F.struct((F.col("end") - F.col("size")).alias("start"), F.col("kind").alias("place"), F.get(kinds, F.col("kind")).alias("kind"), "end")
    spans = spans.groupBy(*names).agg(F.sort_array(F.collect_list(span)).alias("secrets"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "secrets"]
    out = docs.select(*others, *[v.alias(k) for k, v in key.items()]).join(spans, names, "left")
    return out.select(*others, F.coalesce("secrets", F.array().cast(spans.schema["secrets"].dataType)).alias("secrets"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_digest(scanned: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the SHA-256 of the base spans, and all spans as a text."""
    base = F.filter("secrets", lambda s: s["place"] < len(BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))
