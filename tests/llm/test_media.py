"""AVI and JPEG: exact round trips, general decoders, shots."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from platen.llm import jpeg, media


def baseline(samples, q=1, restart=0):
    """A baseline frame of one component, coded bit by bit with tables of fixed lengths."""
    rows, columns = samples.shape
    bits, before, scans = "", 0, []
    codes = {s: format(i, "08b") for i, s in enumerate([(r << 4) | s for r in range(16) for s in range(12)][:255])}
    value = lambda v, s: "" if not s else format(v if v > 0 else v + (1 << s) - 1, f"0{s}b")
    unit = 0
    for y in range(0, rows, 8):
        for x in range(0, columns, 8):
            if restart and unit and unit % restart == 0:
                scans.append(bits)
                bits, before = "", 0
            c = np.rint(jpeg._COSINE.T @ (samples[y : y + 8, x : x + 8].astype(float) - 128) @ jpeg._COSINE / q).astype(int).ravel()[jpeg._ZIGZAG]
            d = int(c[0]) - before
            before = int(c[0])
            s = abs(d).bit_length()
            bits += format(s, "04b") + value(d, s)
            run = 0
            for v in map(int, c[1:]):
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits += codes[0xF0]
                    run -= 16
                s = abs(v).bit_length()
                bits += codes[(run << 4) | s] + value(v, s)
                run = 0
            if run:
                bits += codes[0]
            unit += 1
    scans.append(bits)
    data = b""
    for i, b in enumerate(scans):
        b += "1" * (-len(b) % 8)
        data += int(b, 2).to_bytes(len(b) // 8, "big").replace(b"\xff", b"\xff\0") + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(scans) else b"")
    dc = jpeg._segment(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)))
    ac = jpeg._segment(0xC4, b"\x10" + bytes([0] * 7 + [len(codes)] + [0] * 8) + bytes(codes))
    frame = jpeg._segment(0xC0, struct.pack(">BHHB3B", 8, rows, columns, 1, 1, 0x11, 0))
    interval = jpeg._segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + bytes([q] * 64)) + dc + ac + interval + frame + jpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


def test_lossless_frames_by_both_decoders():
    raw = np.random.default_rng(0).integers(0, 256, (5, 64)).astype(np.uint8)
    frame = jpeg.write_lossless(raw)
    assert (jpeg.read_frame(frame) == raw).all()
    coded = frame[frame.index(b"\xff\xda") + 10 : -2].replace(b"\xff\0", b"\xff")
    assert (jpeg._lossless([coded], jpeg._codes(jpeg.FIXED_BITS, jpeg.FIXED_VALUES), 5, 64, 1, 0) == raw).all()


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_baseline_frames(restart):
    y, x = np.mgrid[0:20, 0:30]
    raw = (128 + 60 * np.sin(x / 5) + 40 * np.cos(y / 3)).astype(np.uint8)
    padded = np.pad(raw, ((0, 4), (0, 2)), mode="edge")
    frame = baseline(padded, 1, restart)
    assert np.abs(jpeg.read_frame(frame).astype(int) - padded).max() <= 1


def test_broken_frames_say_so():
    for bad in (b"", b"\xff\xd8", b"\xff\xd8\xff\xd9", jpeg.write_lossless(np.zeros((1, 64), np.uint8)).replace(b"\xff\xc3", b"\xff\xc2", 1)):
        with pytest.raises((ValueError, struct.error)):
            jpeg.read_frame(bad)


def test_avi_with_and_without_index():
    frames = [jpeg.write_lossless(np.full((2, 64), v, np.uint8)) for v in (1, 2, 3)]
    data = media.write_avi(frames, 64, 2, "note")
    parsed = media.parse_avi(data)
    assert [data[a:b] for a, b in parsed["frames"]] == frames and parsed["comment"] == "note" and parsed["frame_us"] == 40_000
    plain = data[: data.index(b"idx1")]
    assert [plain[a:b] for a, b in media.parse_avi(plain)["frames"]] == frames


def test_shots():
    dark, light = np.zeros(media.BINS), np.zeros(media.BINS)
    dark[2] = light[30] = 1.0
    found = media.shots([dark] * 10 + [light] * 5 + [dark] * 10, 40_000)
    assert [s[:2] for s in found] == [(0, 10), (10, 15), (15, 25)] and found[1][2:4] == (0.4, 0.6)
    assert media.shots([], 1) == [] and media.cuts(np.zeros(30)) == []


def test_payloads_round_trip(spark):
    texts = [None, "", "a", "x" * 64, "é" * 33, "y" * 4096, "z" * 5000, "\x00\xff" * 9000]
    docs = spark.createDataFrame([*enumerate(texts), (2, "a"), (None, "n")], "doc_id long, text string").withColumn("media", F.lit("clash"))
    stored = media.store_payloads(docs)
    got = media.payload_digests(stored).collect()
    for r in got:
        data = ("n" if r.doc_id is None else texts[r.doc_id] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > r.payload_bytes
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (0, 1)}) == 1 and len(got) == 10
    clips = media.read_clips(stored).filter("doc_id = 7").collect()
    assert clips[0].start_s == 0 and clips[-1].end_frame == 7 and all(c.error is None for c in clips)
    broken = spark.createDataFrame([(1, bytearray(b"RIFF")), (2, None)], "doc_id long, media binary")
    assert all(r.error and r.clip is None for r in media.read_clips(broken).collect())
    assert media.payload_digests(media.store_payloads(docs.filter(F.lit(False)))).count() == 0
