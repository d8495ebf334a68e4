"""File checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024
MIME = "application/pdf"


def rejection(size: Column, mime: Column) -> Column:
    """why a file is refused, or null; exactly MAX_BYTES still passes."""
    return F.when(size.isNull(), "missing").when(size > MAX_BYTES, "too_large").when(~mime.eqNullSafe(MIME), "not_pdf")
