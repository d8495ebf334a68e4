"""Boxes of a page on a screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.functions.geometry import ASCENT, CANVAS_WIDTH, FONT_SIZE, PAGE_HEIGHT, canvas_y, or_default, page_scale

PAGE = ["file_id", "page_no"]


def page_frames(pages: DataFrame) -> DataFrame:
    """M6: scale and pixel size of each page."""
    scale = page_scale(F.col("width"))
    return pages.select(*PAGE, scale.alias("scale"), F.lit(CANVAS_WIDTH).alias("canvas_width"), (F.coalesce("height", F.lit(PAGE_HEIGHT)) * scale).alias("canvas_height"))


def text_boxes(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """M8: left, top and font size of text elements in pixels; the top lies an ascent above the baseline."""
    rows = elements.join(pages.select(*PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height")), PAGE)
    scale, size = page_scale(F.col("page_width")), or_default(F.col("font_size"), FONT_SIZE)
    top = canvas_y(F.col("y"), size * F.lit(ASCENT), F.coalesce("page_height", F.lit(PAGE_HEIGHT)), scale)
    return rows.select(*PAGE, "el_idx", (F.col("x") * scale).alias("left_px"), top.alias("top_px"), (size * scale).alias("font_px"))


def image_boxes(placements: DataFrame, pages: DataFrame) -> DataFrame:
    """M7: the pixel boxes of image placements (x, y, rendered_width, rendered_height)."""
    rows = placements.join(pages.select(*PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height")), PAGE)
    scale = page_scale(F.col("page_width"))
    top = canvas_y(F.col("y"), F.col("rendered_height"), F.coalesce("page_height", F.lit(PAGE_HEIGHT)), scale)
    return rows.select(*PAGE, "obj_num", (F.col("x") * scale).alias("left_px"), top.alias("top_px"), (F.col("rendered_width") * scale).alias("width_px"), (F.col("rendered_height") * scale).alias("height_px"))


def element_paragraphs(elements: DataFrame, lines: DataFrame) -> DataFrame:
    """The paragraph of each element, or `header` for one in none.

    A line belongs to the first element with its place and text; where several lines
    meet at one element the last paragraph counts.
    """
    keys = [*PAGE, "x", "y", "text"]
    firsts = elements.groupBy(*keys).agg(F.min("el_idx").alias("el_idx"))
    owned = lines.groupBy(*keys).agg(F.max("para_id").alias("para_id")).join(firsts, keys).groupBy(*PAGE, "el_idx").agg(F.max("para_id").alias("para_id"))
    joined = elements.select(*PAGE, "el_idx").join(owned, [*PAGE, "el_idx"], "left")
    return joined.select(*PAGE, "el_idx", F.coalesce(F.col("para_id").cast("string"), F.lit("header")).alias("para_id"))


def header_styled(elements: DataFrame, headers: DataFrame) -> DataFrame:
    """Whether an element's text is the text of some header of its page."""
    texts = headers.select(*PAGE, "text").distinct().withColumn("styled", F.lit(True))
    return elements.select(*PAGE, "el_idx", "text").join(texts, [*PAGE, "text"], "left").select(*PAGE, "el_idx", F.coalesce("styled", F.lit(False)).alias("is_header_style"))
