"""Column builders for cleaning and redacting text. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the report contract, in Java syntax.
BLOCKS = (
    r"(?is)<(?<tag>skill_content|system-reminder|available_skills)\b[^>]*>(?:.*?</\k<tag>>|.*)",
    r"(?is)<(?:environment_context|permissions instructions|skills_instructions|apps_instructions)\b[^>]*>.*?</(?:environment_context|permissions instructions|skills_instructions|apps_instructions)>",
)
FENCE = r"(?s)```.*?```"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
HOME_POSIX = r"/(?:Users|home)/[^/\s]+"
HOME_DRIVE = r"(?i)\b[A-Z]:\\Users\\[^\\\s]+"
PATH_POSIX = r"(?<![:/\w])/(?:[^/\s]+/)+[^/\s,;:)\]]+"
PATH_DRIVE = r"\b[A-Za-z]:\\(?:[^\\\s]+\\)+[^\\\s,;:)\]]+"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}"
NAMED_SECRET = r"(?i)\b(api[_-]?key|access[_-]?token|auth[_-]?token|secret|password)\b\s*[:=]\s*['\"]?[^\s'\",;]{4,}"
KNOWN_SECRET = r"\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})\b"
LONG_TOKEN = r"\b(?=[A-Za-z0-9+/=]{32,}\b)(?=[A-Za-z0-9+/=]*[A-Za-z])(?=[A-Za-z0-9+/=]*\d)[A-Za-z0-9+/=]+\b"

OPEN_BLOCK = r"(?is)<(?:skill_content|system-reminder|available_skills)\b[^>]*>.*"
URL_QUERY = r"(?i)(https?://[^\s<>\[\]()?#]*)[?#](?=[^\s<>\[\]()]*[^\s<>\[\]().,;:!?#])[^\s<>\[\]()]*?([.,;:!?]*)(?=[\s<>\[\]()]|$)"

#: Escapes of a high surrogate without its low one, and of a low one without its high one, after an even number of backslashes.
HALF_PAIRS = (
    r"(?i)(?<!\\)((?:\\\\)*)\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})",
    r"(?i)(?<!\\)(?<!\\ud[89ab][0-9a-f]{2})((?:\\\\)*)\\ud[c-f][0-9a-f]{2}",
)

#: Nested injected blocks are peeled off in this many passes.
BLOCK_PASSES = 8


def let(value: Column, use) -> Column:
    """use(x) with x bound to the value, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _where(c: Column, marks: tuple[str, ...], use) -> Column:
    """use(c) for texts that hold one of the marks, which every match of its pattern has; others stay as they are."""
    return let(c, lambda x: F.when(reduce(lambda a, b: a | b, [x.contains(m) for m in marks]), use(x)).otherwise(x))


def sound_json(c: Column) -> Column:
    """JSON without escapes of half surrogate pairs, which parsers of JSON take and no text can hold: a replacement mark stands for each."""

    def mend(x: Column) -> Column:
        for pattern in HALF_PAIRS:
            x = F.regexp_replace(x, pattern, r"$1\\ufffd")
        return x

    return let(c, lambda x: F.when(x.rlike(r"(?i)\\ud[89a-f]"), mend(x)).otherwise(x))


def strip_blocks(c: Column, environment: str = " [context omitted] ") -> Column:
    """Puts a mark in place of injected context blocks, nested ones pass by pass; an open block goes to the end of the text."""

    def cut(x: Column) -> Column:
        x = F.regexp_replace(x, BLOCKS[1], environment)
        for _ in range(BLOCK_PASSES):
            x = _where(x, ("<",), lambda y: F.regexp_replace(y, BLOCKS[0], " [context omitted] "))
        return _where(x, ("<",), lambda y: F.regexp_replace(y, OPEN_BLOCK, " [context omitted] "))

    return _where(c, ("<",), cut)


def strip_fences(c: Column) -> Column:
    return _where(c, ("```",), lambda x: F.regexp_replace(x, FENCE, " [code omitted] "))


def mask_url_queries(c: Column) -> Column:
    """Masks the query and fragment of a URL; marks that end a sentence stay outside."""
    return _where(c, ("://",), lambda x: F.regexp_replace(x, URL_QUERY, "$1?<redacted-query>$2"))


def mask_credentials(c: Column) -> Column:
    def secrets(x: Column) -> Column:
        low = lambda *marks: reduce(lambda a, b: a | b, [F.lower(x).contains(m) for m in marks])
        x = let(x, lambda y: F.when(low("bearer"), F.regexp_replace(y, BEARER, "Bearer <redacted>")).otherwise(y))
        return let(x, lambda y: F.when(low("key", "token", "secret", "password"), F.regexp_replace(y, NAMED_SECRET, "$1=<redacted>")).otherwise(y))

    return _where(let(c, secrets), ("sk-", "gh", "AKIA"), lambda x: F.regexp_replace(x, KNOWN_SECRET, "<redacted-secret>"))


def mask_long_tokens(c: Column) -> Column:
    return let(c, lambda x: F.when(x.rlike(r"[A-Za-z0-9+/=]{32}"), F.regexp_replace(x, LONG_TOKEN, "<redacted-token>")).otherwise(x))


def mask_identity(c: Column) -> Column:
    """Masks addresses, ids, home folders and absolute paths."""
    for mark, pattern, put in (
        ("@", EMAIL, "<redacted-email>"), ("-", UUID, "<id>"), ("/", HOME_POSIX, "~"), (":\\", HOME_DRIVE, "~"),
        ("/", PATH_POSIX, "<path>"), (":\\", PATH_DRIVE, "<path>"),
    ):
        c = _where(c, (mark,), lambda x, pattern=pattern, put=put: F.regexp_replace(x, pattern, put))
    return c


def squeeze(c: Column, most: int) -> Column:
    """Collapses white space, trims, and caps the length with an ellipsis."""
    one = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return let(one, lambda x: F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…"))))


def redact_text(c: Column, most: int = 600) -> Column:
    return squeeze(mask_long_tokens(mask_identity(mask_credentials(mask_url_queries(strip_fences(strip_blocks(c)))))), most)


def local_text(c: Column, most: int = 800) -> Column:
    """Like redact_text, but addresses and paths stay."""
    return squeeze(mask_long_tokens(mask_credentials(mask_url_queries(strip_fences(strip_blocks(c))))), most)


def message_body(c: Column) -> Column:
    """A message's own words: environment blocks go, other injected blocks leave a mark."""
    return strip_blocks(c, "")


def stable_id(c: Column, prefix: str, length: int = 12) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(c.cast("string"), 256), 1, length))


def project_label(path: Column) -> Column:
    """The last part of a path (drive paths have two separators); a hash where redaction hides it; unknown where there is none."""
    value = F.regexp_replace(F.trim(path), r"[\\/]+$", "")
    split = F.when(value.rlike(r"^[A-Za-z]:\\"), F.split(value, r"[\\/]")).otherwise(F.split(value, "/"))
    last = let(split, lambda parts: F.element_at(parts, -1))
    shown = lambda x: let(redact_text(x, 100), lambda y: F.when(y.startswith("<redacted-"), stable_id(x, "project", 8)).otherwise(y))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("unknown")).otherwise(let(last, shown))


def leak_errors(c: Column, privacy: str = "redacted") -> Column:
    """Names of the secret patterns that a text still shows; with redaction, absolute paths too."""
    low = lambda *marks: reduce(lambda a, b: a | b, [F.lower(c).contains(m) for m in marks])
    # what every match has is looked for first, which is cheap
    rules = [
        ("bearer", low("bearer"), BEARER), ("named_secret", low("key", "token", "secret", "password"), NAMED_SECRET),
        ("known_secret", c.contains("sk-") | c.contains("gh") | c.contains("AKIA"), KNOWN_SECRET), ("long_token", c.rlike(r"[A-Za-z0-9+/=]{32}"), LONG_TOKEN),
    ]
    if privacy == "redacted":
        rules += [("absolute_path", c.contains("/"), PATH_POSIX), ("absolute_path", c.contains(":\\"), PATH_DRIVE)]
    return F.array_distinct(F.array_compact(F.array(*[F.when(mark & c.rlike(p), F.lit(name)) for name, mark, p in rules])))
