"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAR_WIDTH = 5.5  # points per character where no font metrics are known
# The escapes of a literal string, in the order in which they are replaced.
ESCAPES = ((r"\\\\", r"\\"), (r"\\\(", "("), (r"\\\)", ")"), (r"\\n", "\n"), (r"\\r", "\r"), (r"\\t", "\t"), (r"\\b", "\b"), (r"\\f", "\f"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind, or byte-order marks, at both ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def char_width(c: Column | str) -> Column:
    """The width of a text without metrics."""
    return F.length(col(c)) * F.lit(CHAR_WIDTH)


def literal_string(c: Column | str) -> Column:
    """The characters of a literal string token; octal escapes stay as they are."""
    token = col(c)
    inner = out = F.regexp_replace(token, r"(?s)^\((.*)\)$", "$1")
    for pattern, value in ESCAPES:
        out = F.regexp_replace(out, pattern, value)
    return F.when(token.contains("\\"), out).otherwise(inner)  # without a backslash there is nothing to replace


def literal(token: str) -> str:
    """T6 for Python: as literal_string, of a token in its brackets."""
    out = token[1:-1]
    for shown, value in (("\\\\", "\\"), ("\\(", "("), ("\\)", ")"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f")):
        out = out.replace(shown, value)
    return out


def unicode_hex(c: Column | str) -> Column:
    """Text of UTF-16 code units in hex; empty unless the digits come in fours."""
    h = F.upper(F.coalesce(col(c), F.lit("")))
    return F.when((F.length(h) > 0) & (F.length(h) % 4 == 0), F.decode(F.unhex(h), "UTF-16BE")).otherwise(F.lit(""))


def hex_of(n: Column, width: Column | int) -> Column:
    """Upper-case hex, filled up to a width and never cut."""
    h = F.hex(n)
    w = F.lit(width) if isinstance(width, int) else width
    return F.when(F.length(h) >= w, h).otherwise(F.lpad(h, w, "0"))


def index_of(text: Column | str, needle: str, start: int = 0) -> Column:
    """Zero-based position from start on, or -1."""
    return F.locate(needle, col(text), start + 1) - 1


def utf8_hex(c: Column | str) -> Column:
    """T4: the UTF-8 bytes of a text, in hex."""
    return F.hex(F.encode(col(c), "UTF-8"))


def zero_bytes(n: Column) -> Column:
    """N bytes, all zero."""
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def jpeg_data_url(content: Column | str) -> Column:
    """K4: a data URL of JPEG bytes, on one line."""
    return F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(col(content)), r"[\r\n]", ""))


def file_size(n: Column | str) -> Column:
    """Bytes as B, KB or MB, rounded to two places without trailing zeros."""
    n = F.coalesce(col(n).cast("double"), F.lit(0.0))
    step = F.when(n < 1024, 0).when(n < 1024**2, 1).otherwise(2)
    # Half up on the decimal value, as a float rounded at two places is.
    value = F.floor(n / F.pow(F.lit(1024.0), step) * 100 + 0.5) / 100
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), r"0+$", ""), r"\.$", "")
    unit = F.element_at(F.array(F.lit("B"), F.lit("KB"), F.lit("MB")), (step + 1).cast("int"))
    return F.when(n == 0, F.lit("0 B")).otherwise(F.concat(shown, F.lit(" "), unit))


def clock_time(ts: Column | str) -> Column:
    """Hours and minutes of a timestamp."""
    return F.date_format(col(ts), "HH:mm")


def missing_characters(text: Column | str, known: Column) -> Column:
    """Distinct characters of a text that an array does not hold, in order of first use."""
    return F.array_except(F.array_distinct(F.split(col(text), "")), known)
