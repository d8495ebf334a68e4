"""Page geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
CANVAS_WIDTH = 850.0
CENTRE_TOLERANCE = 0.065
BACKGROUND_COVERAGE = 0.8
LINE_FACTOR = 1.2
ASCENT = 0.8
FONT_SIZE = 12.0


def or_default(c: Column, default: float) -> Column:
    """The value unless it is null or zero."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def media_box(page_object: Column) -> tuple[Column, Column]:
    """width and height; a page without a box is a letter page."""
    box = r"/MediaBox\s*\[\s*(-?[\d.]+)\s+(-?[\d.]+)\s+(-?[\d.]+)\s+(-?[\d.]+)\s*\]"
    side = lambda a, b, default: F.coalesce(number(page_object, box, b) - number(page_object, box, a), F.lit(default))
    return side(1, 3, PAGE_WIDTH), side(2, 4, PAGE_HEIGHT)


def coverage(matrix: Column, width: Column, height: Column) -> Column:
    """M1: the part of the page that an image placed by the matrix covers."""
    area = width * height
    return F.when(area == 0, F.lit(0.0)).otherwise(F.least(F.abs(matrix[0]) * F.abs(matrix[3]) / area, F.lit(1.0)))


def bottom(matrix: Column) -> Column:
    """M2: the lower edge, also of an image that is flipped."""
    return F.when(matrix[3] < 0, matrix[5] + matrix[3]).otherwise(matrix[5])


def appearance(matrix: Column) -> Column:
    """M3: where and how large an image is drawn."""
    return F.struct(matrix[4].alias("x"), bottom(matrix).alias("y"), F.abs(matrix[0]).alias("rendered_width"), F.abs(matrix[3]).alias("rendered_height"))


def element_centre(x: Column, width: Column, text: Column) -> Column:
    """M4: the horizontal middle of a text element."""
    from platen.functions.text import char_width

    return F.coalesce(x, F.lit(0.0)) + F.when(width.isNull() | (width == 0), char_width(text)).otherwise(width) / 2


def page_scale(width: Column) -> Column:
    """M6: pixels per point."""
    return F.lit(CANVAS_WIDTH) / F.coalesce(width, F.lit(PAGE_WIDTH))


def canvas_y(y: Column, height: Column, page_height: Column, scale: Column) -> Column:
    """M5: the distance from the top, in pixels."""
    return (page_height - y - height) * scale


def line_height(font_size: Column) -> Column:
    """The distance of lines."""
    return or_default(font_size, FONT_SIZE) * F.lit(LINE_FACTOR)


def wrap_limit(x: Column, scale: Column) -> Column:
    """The width that a line may take."""
    return F.lit(CANVAS_WIDTH - 40) / scale - x
