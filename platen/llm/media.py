"""Motion-JPEG media columns: AVI files as binary values.

`store_payloads` turns each text into an AVI of lossless intra frames, and
`read_clips` parses any motion-JPEG AVI (RIFF chunks, the idx1 index where there
is one), decodes its frames and cuts it into shots: a cut stands where the
difference of neighbouring frames' histograms exceeds the mean and a multiple of the
deviation of the differences around it. Frames are decoded one at a time.

Defined cases: a null text counts as empty and its payload is 64 zero bytes; a
text of a positive multiple of 64 bytes is not padded; repeated rows give
repeated rows; a null or broken media value gives a row with an error and no
clips; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.bpe import text_column
from platen.llm.jpeg import read_frame, write_lossless

UNIT = 64
COLUMNS = 64
ROWS = 64
FRAME_US = 40_000
BINS = 32
AROUND = 8  # differences on each side that a threshold looks at
FACTOR = 3.0
FLOOR = 0.15


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], columns: int, rows: int, comment: str = "") -> bytes:
    """An AVI with one motion-JPEG stream, its comment and its idx1 index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", FRAME_US, most * 1_000_000 // FRAME_US, 0, 0x10, len(frames), 0, 1, most, columns, rows, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, FRAME_US, 1_000_000, 0, len(frames), most, -1, 0, 0, 0, columns, rows)
    strf = struct.pack("<IiiHH4sIiiII", 40, columns, rows, 1, 24, b"MJPG", columns * rows * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment.encode() + b"\0"))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + header + info + movi + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the body of each chunk; a list has its type as name."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body, stop = at + 8, min(at + 8 + size, end)
        if name in (b"RIFF", b"LIST"):
            yield data[body : body + 4], body + 4, stop
        else:
            yield name, body, stop
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> dict:
    """Frame places (start, end), time per frame and comment of an AVI."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI")
    out = {"frame_us": FRAME_US, "comment": "", "frames": []}
    movi, index = None, None
    for name, a, b in _chunks(data, 12, len(data)):
        if name == b"hdrl":
            for inner, x, _ in _chunks(data, a, b):
                if inner == b"avih":
                    out["frame_us"] = struct.unpack_from("<I", data, x)[0] or FRAME_US
        elif name == b"INFO":
            for inner, x, y in _chunks(data, a, b):
                if inner == b"ICMT":
                    out["comment"] = data[x:y].rstrip(b"\0").decode("utf-8", "replace")
        elif name == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, x) for x in range(a, b - 15, 16)]
    if movi is None:
        raise ValueError("no movi list")
    if index:
        video = [e for e in index if e[0][2:] in (b"dc", b"db")]
        # Offsets count from the list type or, in some files, from the start of the file.
        base = movi[0] - 4 if not video or data[movi[0] - 4 + video[0][2] :][:4] == video[0][0] else 0
        out["frames"] = [(base + at + 8, base + at + 8 + size) for _, _, at, size in video]
    else:
        out["frames"] = [(x, y) for name, x, y in _chunks(data, *movi) if name[2:] in (b"dc", b"db")]
    return out


def cuts(differences: np.ndarray) -> list[int]:
    """Frames that start a shot: differences[i] lies between frames i and i + 1."""
    n = len(differences)
    if not n:
        return []
    sums = np.concatenate([[0], np.cumsum(differences)])
    squares = np.concatenate([[0], np.cumsum(differences**2)])
    at = np.arange(n)
    low, high = np.maximum(at - AROUND, 0), np.minimum(at + AROUND + 1, n)
    count = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - differences) / count
    deviation = np.sqrt(np.maximum((squares[high] - squares[low] - differences**2) / count - mean**2, 0))
    return (np.flatnonzero(differences > np.maximum(mean + FACTOR * deviation, FLOOR)) + 1).tolist()


def histogram(frame: np.ndarray) -> np.ndarray:
    return np.bincount(frame.ravel() >> 3, minlength=BINS) / max(frame.size, 1)


def shots(histograms: list[np.ndarray], frame_us: int) -> list[tuple[int, int, float, float, float]]:
    """(first frame, end frame, start second, end second, mean level) of each shot."""
    if not histograms:
        return []
    stack = np.stack(histograms)
    starts = [0, *cuts(np.abs(np.diff(stack, axis=0)).sum(axis=1) / 2)]
    levels = stack @ (np.arange(BINS) * 8 + 3.5)
    return [(a, b, a * frame_us / 1e6, b * frame_us / 1e6, float(levels[a:b].mean())) for a, b in zip(starts, [*starts[1:], len(histograms)], strict=True)]


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % UNIT if data else UNIT), len(data)


def media_of(payload: bytes, n_bytes: int) -> bytes:
    """The payload as lossless frames; their last one is filled with zeros."""
    lines = len(payload) // COLUMNS
    rows = min(lines, ROWS)
    samples = np.frombuffer(payload + b"\0" * (-len(payload) % (rows * COLUMNS)), np.uint8).reshape(-1, rows, COLUMNS)
    return write_avi([write_lossless(s) for s in samples], COLUMNS, rows, f"payload={len(payload)} text={n_bytes}")


def store_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, media) from (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for rows in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                media = [media_of(*payload_of(t)) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, media binary")


def _decoded(data: bytes) -> tuple[dict, bytes, list[np.ndarray]]:
    parsed = parse_avi(data)
    out, histograms = [], []
    for a, b in parsed["frames"]:
        frame = read_frame(data[a:b])
        histograms.append(histogram(frame))
        if parsed["comment"].startswith("payload="):
            out.append(frame.tobytes())
    return parsed, b"".join(out), histograms


def read_clips(media: DataFrame) -> DataFrame:
    """Timed clip rows (doc_id, clip, first_frame, end_frame, start_s, end_s, level, error) of (doc_id, media)."""
    schema = "doc_id long, clip int, first_frame int, end_frame int, start_s double, end_s double, level double, error string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    parsed, _, histograms = _decoded(data or b"")
                    rows += [(doc, k, *shot, None) for k, shot in enumerate(shots(histograms, parsed["frame_us"]))]
                except (ValueError, KeyError, IndexError, StopIteration, struct.error) as e:
                    rows.append((doc, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, schema)


def payload_digests(media: DataFrame) -> DataFrame:
    """One row per stored payload, from the media bytes alone."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parsed, samples, histograms = _decoded(data)
                sizes = dict(p.split("=") for p in parsed["comment"].split())
                payload = samples[: int(sizes["payload"])]
                clips = shots(histograms, parsed["frame_us"])
                feature = f"frames={len(histograms)};" + ",".join(f"{s:.2f}-{e:.2f}:{level:.3f}" for _, _, s, e, level in clips)
                rows.append((doc, int(sizes["text"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(run, schema)
