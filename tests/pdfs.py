"""Small PDFs, built as bytes."""

import zlib

CMAP = "1 beginbfrange\n<0020> <007E> <0020>\nendbfrange"


def code(text):
    return "<" + text.encode("utf-16-be").hex().upper() + ">"


def line(text, x, y, size=12):
    return f"/F1 {size} Tf\n1 0 0 1 {x} {y} Tm\n[{code(text)}] TJ"


def stream(data, extra="", flate=True, length=None, eol=b"\n"):
    data = data.encode() if isinstance(data, str) else data
    packed = zlib.compress(data) if flate else data
    size = length if length is not None else len(packed)
    head = f"<< /Length {size} {'/Filter /FlateDecode' if flate else ''} {extra} >>".encode()
    return head + b"\nstream" + eol + packed + b"\nendstream"


def build(objects, trailer=True, eol=b"\n"):
    """objects: (number, body) pairs in file order; 1 is the catalogue."""
    out = b"%PDF-1.4" + eol
    for n, body in objects:
        out += f"{n} 0 obj".encode() + eol + (body.encode() if isinstance(body, str) else body) + eol + b"endobj" + eol
    return out + (b"trailer" + eol + b"<< /Root 1 0 R >>" + eol if trailer else b"") + b"%%EOF"


def simple(contents, resources="/Font << /F1 3 0 R >>", box="/MediaBox [0 0 612 792]", more=(), kids=None, count=None, trailer=True, eol=b"\n"):
    """A file with one page for each content stream; pages are objects 10, 12, ..."""
    objects = [(1, "<< /Type /Catalog /Pages 2 0 R >>"), (3, "<< /Type /Font /ToUnicode 4 0 R >>"), (4, stream(CMAP))]
    numbers = []
    for i, c in enumerate(contents):
        page = 10 + 2 * i
        numbers.append(page)
        ref = c if isinstance(c, str) and c.startswith("@") else None
        objects.append((page, f"<< /Type /Page /Parent 2 0 R {box} /Resources << {resources} >> /Contents {ref[1:] if ref else f'{page + 1} 0 R'} >>"))
        if not ref:
            objects.append((page + 1, c if isinstance(c, bytes) else stream(c)))
    listed = kids or " ".join(f"{n} 0 R" for n in numbers)
    objects.append((2, f"<< /Type /Pages /Count {count or len(numbers)} /Kids [{listed}] >>"))
    return build([*objects, *more], trailer, eol)
