"""PDF files, reports and snapshots from tables (K1, K2, K5, K7)."""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.session import as_plan, attach

PAGE = ["file_id", "page_no"]


@lru_cache(maxsize=1 << 12)
def _shown(v: float) -> str:
    return f"{v:.4f}".rstrip("0").rstrip(".")


def _number(v: float) -> str:
    return _shown(v) if v else f"{v:.4f}".rstrip("0").rstrip(".")  # 0 and -0 are one key


def _literal(text: str) -> bytes:
    data = text.encode("cp1252", "replace")
    for char, escaped in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\r", b"\\r"), (b"\n", b"\\n")):
        data = data.replace(char, escaped)
    return b"(" + data + b")"


def _jpeg_size(data: bytes) -> tuple[int, int, int]:
    """Width, height and components from a JPEG's frame header."""
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height, data[at + 9]
        at += 2 + size
    return 1, 1, 3


def _png_parts(data: bytes) -> tuple[int, int, int, bytes]:
    width, height, _, kind = struct.unpack_from(">IIBB", data, 16)
    at, body = 8, b""
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        if name == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    return width, height, 1 if kind == 0 else 3, body


def _image_object(format: str, payload: bytes) -> bytes:
    if format == "jpeg":
        width, height, n = _jpeg_size(payload)
        filters = "/Filter /DCTDecode"
    else:
        width, height, n, payload = _png_parts(payload)
        filters = f"/Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors {n} /Columns {width} >>"
    space = {1: "DeviceGray", 4: "DeviceCMYK"}.get(n, "DeviceRGB")
    head = f"<< /Type /XObject /Subtype /Image /Width {width} /Height {height} /ColorSpace /{space} /BitsPerComponent 8 {filters} /Length {len(payload)} >>\nstream\n"
    return head.encode() + payload + b"\nendstream"


def write_pdf(pages: list[dict]) -> bytes:
    """K1: a file with a background, images and Helvetica text for each page, in that order.

    A page: {width, height, background: (format, payload) or None,
    images: [(format, payload, appearance or None)], texts: [{text, x, y, font_size}]}.
    """
    bodies: list[bytes] = [b"", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []

    def add(body: bytes) -> int:
        bodies.append(body)
        return len(bodies)

    for page in pages:
        lines, names = [], []

        def draw(format: str, payload: bytes, w: float, h: float, x: float, y: float, lines=lines, names=names) -> None:
            names.append((f"Im{len(names) + 1}", add(_image_object(format, payload))))
            lines += ["q", f"{_number(w)} 0 0 {_number(h)} {_number(x)} {_number(y)} cm", f"/{names[-1][0]} Do", "Q"]

        if page["background"]:
            draw(*page["background"], page["width"], page["height"], 0, 0)
        for format, payload, a in page["images"]:
            if a is not None:
                draw(format, payload, a["rendered_width"] or 100, a["rendered_height"] or 100, a["x"] or 0, a["y"] or 0)
        content = bytearray("\n".join(lines).encode() + b"\n")
        for t in page["texts"]:
            content += f"BT\n/F1 {_number(t['font_size'] or 12)} Tf\n1 0 0 1 {_number(t['x'] or 0)} {_number(t['y'] or 0)} Tm\n".encode() + b"[" + _literal(t["text"]) + b"] TJ\nET\n"
        packed = zlib.compress(content)
        stream = add(f"<< /Length {len(packed)} /Filter /FlateDecode >>\nstream\n".encode() + packed + b"\nendstream")
        images = " ".join(f"/{n} {o} 0 R" for n, o in names)
        kids.append(add(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {_number(page['width'])} {_number(page['height'])}] /Resources << /Font << /F1 3 0 R >> /XObject << {images} >> >> /Contents {stream} 0 R >>".encode()))
    bodies[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    bodies[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(bodies, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return bytes(out) + f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def edited_name(file_id: object) -> str:
    """K1: the name of a file that was written again."""
    return "edited_" + re.sub(r".*/", "", str(file_id))


def _page(r: dict) -> dict:
    """A page of export as write_pdf takes it."""
    b = r["background"]
    return {
        "width": r["width"], "height": r["height"], "background": (b["format"], b["payload"]) if b and b["payload"] is not None else None,
        "images": [(i["format"], i["payload"], i["a"]) for i in r["images"] or ()], "texts": r["texts"] or (),
    }


def export(pages: DataFrame, elements: DataFrame, backgrounds: DataFrame, page_images: DataFrame) -> DataFrame:
    """K1: (file_id, name, content) of each file with pages; a file is one group, as it is one output value."""
    attach(pages.sparkSession)
    texts = elements.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("el_idx", "text", "x", "y", "font_size"))).alias("texts"))
    back = backgrounds.select(*PAGE, F.struct("format", "payload").alias("background"))
    placed = page_images.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("obj_num", "format", "payload", F.try_element_at("appearances", F.lit(1)).alias("a")))).alias("images"))
    rows = pages.select(*PAGE, "width", "height").join(texts, PAGE, "left").join(back, PAGE, "left").join(placed, PAGE, "left")

    page = [c for c in rows.columns if c != "file_id"]
    whole = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*page))).alias("pages"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file_id = batch.column(0)[i].as_py()
                made = write_pdf([_page(r) for r in batch.column(1)[i].as_py()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([edited_name(file_id)], pa.string()), pa.array([made], pa.binary())], ["file_id", "name", "content"])

    return whole.mapInArrow(as_plan(run), "file_id string, name string, content binary")


def passthrough(files: DataFrame, pages: DataFrame) -> DataFrame:
    """K2: the files of which no page could be parsed, as they are."""
    parsed = pages.filter("error is null").select("file_id").distinct()
    return files.join(parsed, "file_id", "left_anti").select("file_id", F.concat(F.lit("original_"), F.regexp_replace("file_id", r".*/", "")).alias("name"), "content")


def report(classification: DataFrame) -> DataFrame:
    """Counts and first paragraph heights, as a console report shows them."""
    first = F.try_element_at("paragraphs", F.lit(1))
    return classification.select(*PAGE, "header_count", "text_count", "paragraph_count", F.format_string("%.1f", first["y"]).alias("first_y"), F.slice(F.transform("headers", lambda h: h["text"]), 1, 3).alias("headers"))


def save_snapshot(table: DataFrame, path: str) -> None:
    """K7: replace a stored table."""
    table.write.mode("overwrite").parquet(path)
