"""Edits of text elements.

Property edits and one shift are joins and aggregates. Edits that renumber
elements are a strictly ordered replay of one page's log, which is bounded by the
page, in Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.functions.geometry import CANVAS_WIDTH, FONT_SIZE, LINE_FACTOR
from platen.functions.text import CHAR_WIDTH

PAGE = ["file_id", "page_no"]


def apply_property_edits(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """Of each property the last value set counts; a toggle counts by parity.

    edits: (file_id, page_no, el_idx, seq, op, text, number, color) with op text,
    font_size, color, toggle_bold or toggle_italic.
    """
    last = lambda op, value: F.max_by(F.when(F.col("op") == op, F.col(value)), F.when(F.col("op") == op, F.col("seq")))
    odd = lambda op: F.count_if(F.col("op") == op) % 2 == 1
    sets = edits.groupBy(*PAGE, "el_idx").agg(
        last("text", "text").alias("new_text"), last("font_size", "number").alias("new_size"), last("color", "color").alias("new_color"), odd("toggle_bold").alias("flip_bold"), odd("toggle_italic").alias("flip_italic")
    )
    have = lambda c, kind: F.col(c) if c in elements.columns else F.lit(None).cast(kind)
    flip = lambda now, c: F.coalesce(now, F.lit(False)) != F.coalesce(F.col(c), F.lit(False))
    return elements.join(sets, [*PAGE, "el_idx"], "left").select(
        *PAGE, "el_idx", F.coalesce("new_text", "text").alias("text"), "x", "y", F.coalesce("new_size", "font_size").alias("font_size"), "width",
        F.coalesce("new_color", have("color", "string")).alias("color"), flip(have("is_bold", "boolean"), "flip_bold").alias("is_bold"), flip(have("is_italic", "boolean"), "flip_italic").alias("is_italic"),
    )


def shift_below(elements: DataFrame, threshold: Column, amount: Column) -> DataFrame:
    """E5: what lies below the threshold moves down by the amount."""
    return elements.withColumn("y", F.when(F.col("y") < threshold, F.col("y") - amount).otherwise(F.col("y")))


def shift_images_below(images: DataFrame, threshold: Column, amount: Column) -> DataFrame:
    """E5: an image whose first placement lies below moves, and keeps that placement alone."""
    first = F.try_element_at("appearances", F.lit(1))
    moved = F.array(F.struct(first["x"].alias("x"), (first["y"] - amount).alias("y"), first["rendered_width"].alias("rendered_width"), first["rendered_height"].alias("rendered_height")))
    return images.withColumn("appearances", F.when(first["y"] < threshold, moved).otherwise(F.col("appearances")))


class PageState:
    """Elements and caret of one page while its log is replayed."""

    def __init__(self, elements: list[dict], page_width: float = 612.0) -> None:
        self.elements, self.limit = elements, (CANVAS_WIDTH - 40) / (CANVAS_WIDTH / page_width)
        self.at, self.offset = 0, 0

    def shift(self, threshold: float, amount: float) -> None:
        for e in self.elements:
            if e["y"] is not None and e["y"] < threshold:
                e["y"] -= amount

    def insert(self, after: int, element: dict) -> None:
        self.elements.insert(after + 1, element)

    def remove(self, at: int) -> None:
        if 0 <= at < len(self.elements):
            del self.elements[at]

    def write(self, e: dict, text: str) -> None:
        e["text"], e["width"] = text, len(text) * CHAR_WIDTH

    def key(self, key: str) -> None:
        """A key at the caret."""
        if not 0 <= self.at < len(self.elements):
            return
        e = self.elements[self.at]
        text, height = e["text"], (e["font_size"] or FONT_SIZE) * LINE_FACTOR
        if key == "Backspace":
            if self.offset:
                self.write(e, text[: self.offset - 1] + text[self.offset :])
                self.offset -= 1
            elif self.at and (self.elements[self.at - 1]["y"] or 0) > (e["y"] or 0):
                before = self.elements[self.at - 1]
                self.offset = len(before["text"])
                self.write(before, before["text"] + text)
                self.remove(self.at)
                self.shift((e["y"] or 0) - 1, -height)
                self.at -= 1
        elif key == "ArrowLeft":
            if self.offset:
                self.offset -= 1
            elif self.at:
                self.at -= 1
                self.offset = len(self.elements[self.at]["text"])
        elif key == "ArrowRight":
            if self.offset < len(text):
                self.offset += 1
            elif self.at < len(self.elements) - 1:
                self.at, self.offset = self.at + 1, 0
        elif len(key) == 1:
            grown, offset = text[: self.offset] + key + text[self.offset :], self.offset + 1
            space = grown.rfind(" ")
            if len(grown) * CHAR_WIDTH > self.limit - (e["x"] or 0) and space >= 0:
                rest = {**e}
                self.write(e, grown[:space])
                self.write(rest, grown[space + 1 :])
                rest["y"] = (e["y"] or 0) - height
                self.shift((e["y"] or 0) - 1, height)
                self.insert(self.at, rest)
                self.at, self.offset = self.at + 1, offset - space - 1 if offset > space else offset
            else:
                self.write(e, grown)
                self.offset = offset

    def apply(self, edit: dict) -> None:
        op, at = edit["op"], int(edit["el_idx"]) if not pd.isna(edit["el_idx"]) else None
        if op == "key":
            self.key(edit["text"])
        elif op == "caret":
            self.at, self.offset = at, int(edit["number"] or 0)
        elif op == "insert":
            self.insert(at, {"text": edit["text"] or "", "x": edit["x"], "y": edit["y"], "font_size": edit["number"], "width": len(edit["text"] or "") * CHAR_WIDTH})
        elif op == "remove":
            self.remove(at)
        elif op == "shift":
            self.shift(edit["y"], edit["number"])
        elif at is not None and 0 <= at < len(self.elements):
            if op == "text":
                self.elements[at]["text"] = edit["text"]
            elif op == "font_size" and str(edit["text"] if edit["text"] is not None else edit["number"]).split(".")[0].lstrip("-").isdigit():
                self.elements[at]["font_size"] = float(int(float(edit["text"] if edit["text"] is not None else edit["number"])))  # E9: digits only


REPLAYED = "file_id string, page_no int, el_idx int, text string, x double, y double, font_size double, width double"


def replay(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """The elements of each page after its log, in order of seq.

    edits: (file_id, page_no, seq, op, el_idx, text, number, x, y).
    """

    def run(key, table: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        clean = lambda r: {k: None if isinstance(v, float) and pd.isna(v) else v for k, v in r.items()}
        state = PageState([clean(r) for r in table.sort_values("el_idx")[["text", "x", "y", "font_size", "width"]].to_dict("records")])
        for edit in log.sort_values("seq").to_dict("records"):
            state.apply(clean(edit))
        out = pd.DataFrame(state.elements, columns=["text", "x", "y", "font_size", "width"])
        out.insert(0, "el_idx", range(len(out)))
        out.insert(0, "page_no", key[1])
        out.insert(0, "file_id", key[0])
        return out.astype({"x": "float64", "y": "float64", "font_size": "float64", "width": "float64"})

    left = elements.select(*PAGE, "el_idx", "text", "x", "y", "font_size", "width").groupBy(*PAGE)
    log = edits.withColumnsRenamed({"file_id": "of_file", "page_no": "of_page"}).groupBy("of_file", "of_page")
    return left.cogroup(log).applyInPandas(run, REPLAYED)


def elements_at(elements: DataFrame, cursors: DataFrame) -> DataFrame:
    """The element under each cursor (file_id, page_no, el_idx)."""
    return cursors.join(elements, [*PAGE, "el_idx"])
