"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text (at-signs, plus signs,
digits, address schemes, identifier cues) in one pass; a small deterministic
parser then expands each anchor to both sides and validates what it finds. Work
is linear in the length of a text, also for long runs of one character.

Base kinds, each leftmost and non-overlapping, with code-point offsets:

* email: `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`
* ip: four digit runs joined by dots, none above 255
* card: digits that single spaces or hyphens may separate, 13 to 19 of them, Luhn
* phone: `\\+[0-9][\\x20().0-9-]+[0-9]` with 9 to 15 digits

Kinds that the anchors add, by cues and schemes in any case:

* account: after a cue (iban, ssn, passport, ...), an IBAN with valid check
  digits, a nine-digit social security number, or a mixed identifier with at least 5 digits
* address: a scheme whose authority holds user data (`scheme://user:secret@host`)
* secret: after a cue (password, token, ...) and `=` or `:`, a value of 8 to 128 characters with a digit; cloud key ids

Defined cases: a null or empty text has no spans; repeated rows give repeated
rows; a null doc_id stays null; an empty table gives no rows; other columns are
not read (redaction keeps them).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platen.llm.bpe import text_column

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address", "secret")

# The characters of the base patterns.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")
CUES = ("iban", "ssn", "social security", "passport", "account", "acct", "tax id", "customer id", "member id", "licence no", "license no")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "private_key")
KEY_CUES = ("AKIA", "ASIA")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/@<>\"']++@[A-Za-z0-9.-]+(?::[0-9]+)?")
_CUE_TAIL = re.compile(r"(?:\x20(?:number|no|nr|code|is))?\.?[\x20:#=]{1,4}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IDENTIFIER = re.compile(r"(?=(?:[A-Z-]*[0-9]){5})[A-Z0-9][A-Z0-9-]{4,19}(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"[\x20]{0,2}[=:][\x20]{0,2}[\"']?")
_VALUE = re.compile(r"[^\s\"']*+")
_DIGIT = re.compile(r"[0-9]")
_KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for s in SCHEMES:
        a.add_word(s, ("address", len(s)))
    for kind, cues in (("account", CUES), ("secret", SECRET_CUES), ("key", KEY_CUES)):
        for cue in cues:
            a.add_word(cue.lower(), (kind, len(cue)))
    a.make_automaton()
    return a


def _folded(text: str) -> str:
    """The text in lower case, place by place: cues and schemes count in any case."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban_end(text: str, at: int) -> int | None:
    """End of the longest prefix with valid check digits."""
    m = _IBAN.match(text, at)
    if not m:
        return None
    for end in range(m.end(), at + 14, -1):
        code = text[at:end].replace(" ", "")
        if len(code) >= 15 and text[end - 1] != " " and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end
    return None


def find(text: str) -> list[Span]:
    """(kind, start, end) spans, by kind and start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_floor = dotted_end = spaced_end = value_end = 0
    for last, (kind, size) in _automaton().iter(_folded(text)):
        at = last - size + 1
        if kind == "digit":
            if at >= dotted_end:
                dotted_end = _DOTTED.match(text, at).end()
                if dotted_end - at >= 7:
                    start, parts = at, text[at:dotted_end].split(".")
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        end = start + sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                            found["ip"].append((start, end))
                        start = end + 1
            if at >= spaced_end:
                spaced_end = _SPACED.match(text, at).end()
                if spaced_end - at >= 13:
                    digits = text[at:spaced_end].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((at, spaced_end))
        elif kind == "email":
            local = len(text[email_floor:at]) - len(text[email_floor:at].rstrip(LOCAL))
            m = _DOMAIN.match(text, at + 1) if local else None
            if m:
                found["email"].append((at - local, m.end()))
            email_floor = m.end() if m else at + 1
        elif kind == "phone":
            m = _PHONE.match(text, at)
            if m and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append(m.span())
        elif kind == "address":
            m = _AUTHORITY.match(text, last + 1)
            if m:
                found["address"].append((at, m.end()))
        elif kind == "secret":
            m = _ASSIGNED.match(text, last + 1)
            if m and m.end() >= value_end:  # not within a value that was read already
                start, value_end = _VALUE.match(text, m.end()).span()
                if value_end - start >= 8 and _DIGIT.search(text, start, value_end):
                    found["secret"].append((start, value_end))
        elif at and text[at - 1].isalnum():
            continue
        elif kind == "key":
            m = _KEY.match(text, last + 1)
            if m and text[at : last + 1].isupper():
                found["secret"].append((at, m.end()))
        else:
            m = _CUE_TAIL.match(text, last + 1)
            if m:
                end = _iban_end(text, m.end())
                other = None if end else _SSN.match(text, m.end()) or _IDENTIFIER.match(text, m.end())
                if end or other:
                    found["account"].append((m.end(), end or other.end()))
    out = []
    for kind in KINDS:
        end = 0
        for a, b in sorted(found[kind]):
            if a >= end or kind in BASE:
                out.append((kind, a, b))
                end = b
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or each run of overlapping spans, as <KIND>; of these the first one names it."""
    out, at, end = [], 0, 0
    for a, b, kind in sorted((a, -b, k) for k, a, b in spans):
        b = -b
        if a >= end:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


_REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            counts, digests, spans = [[] for _ in BASE], [], []
            for text in batch.column(1).to_pylist():
                found = find(text)
                base = [s for s in found if s[0] in BASE]
                for k, kind in enumerate(BASE):
                    counts[k].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _REPORT.split(", ")])

    return text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, _REPORT)


def redacted(docs: DataFrame, length: str | None = "n_chars") -> DataFrame:
    """docs with every span of `text` replaced; `length`, where there is such a column, follows. Null texts stay null."""
    schema = docs.schema
    place = schema.names.index("text")
    sized = schema.names.index(length) if length in schema.names else None

    def run(batches):
        for batch in batches:
            texts = [t if t is None else redact(t, find(t)) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            if sized is not None:
                columns[sized] = pa.array([old if t is None else len(t) for t, old in zip(texts, batch.column(sized).to_pylist(), strict=True)], batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
