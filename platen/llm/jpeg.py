"""Intra frames of motion-JPEG: a lossless writer, and a reader of lossless and baseline frames.

The writer makes one-component lossless frames (SOF3, predictor 1). Its Huffman
table gives category s a code of 9 - s bits, so with the s extra bits every
difference takes 9 bits; 511 of the 512 words are used and the all-ones word is
left free, as the format asks. Frames of that table are coded and decoded by
array operations; other lossless tables and baseline frames (SOF0, SOF1, with
subsampling and restart intervals) are decoded symbol by symbol.
"""

from __future__ import annotations

import struct

import numpy as np

FIXED_BITS = bytes([1] * 9 + [0] * 7)
FIXED_VALUES = bytes(range(8, -1, -1))


def _fixed_words() -> tuple[np.ndarray, np.ndarray]:
    words, back = np.zeros(511, np.uint16), np.zeros(512, np.int32)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << s) - 1
        words[d + 255] = ((1 << (8 - s)) - 1) << (s + 1) | extra
        back[words[d + 255]] = d
    return words, back


_WORDS, _DIFFERENCES = _fixed_words()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLE = _segment(0xC4, b"\0" + FIXED_BITS + FIXED_VALUES)
_SCAN = _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def write_lossless(samples: np.ndarray) -> bytes:
    """A frame from 8-bit samples (rows, columns); their number is a multiple of 8."""
    rows, columns = samples.shape
    wide = samples.astype(np.int16)
    diff = np.empty((rows, columns), np.int16)
    diff[:, 1:] = wide[:, 1:] - wide[:, :-1]
    diff[0, 0] = wide[0, 0] - 128
    diff[1:, 0] = wide[1:, 0] - wide[:-1, 0]
    words = _WORDS[diff.ravel() + 255].reshape(-1, 8).astype(np.uint32)
    packed = np.empty((len(words), 9), np.uint8)
    packed[:, 0] = words[:, 0] >> 1
    for k in range(1, 8):
        packed[:, k] = (words[:, k - 1] << (8 - k)) | (words[:, k] >> (k + 1))
    packed[:, 8] = words[:, 7]
    frame = _segment(0xC3, struct.pack(">BHHB3B", 8, rows, columns, 1, 1, 0x11, 0))
    return b"\xff\xd8" + _TABLE + frame + _SCAN + packed.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def _read_fixed(data: bytes, rows: int, columns: int) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8, rows * columns * 9 // 8).reshape(-1, 9).astype(np.uint16)
    words = np.empty((len(packed), 8), np.uint16)
    for k in range(8):
        words[:, k] = ((packed[:, k] << (k + 1)) | (packed[:, k + 1] >> (7 - k))) & 511
    diff = _DIFFERENCES[words].reshape(rows, columns)
    diff[0, 0] += 128
    diff[:, 0] = np.cumsum(diff[:, 0])
    return np.cumsum(diff, axis=1).astype(np.uint8)


class _Bits:
    """Bits of entropy-coded data without stuffing."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.have = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.have < n:
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.have += 8
        self.have -= n
        out = self.held >> self.have
        self.held &= (1 << self.have) - 1
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = (code << 1) | self.take(1)
            if (found := table.get((length, code))) is not None:
                return found
        raise ValueError("broken Huffman code")

    def signed(self, size: int) -> int:
        if size == 16:
            return 32768
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _codes(bits: bytes, values: bytes) -> dict[tuple[int, int], int]:
    table, code, at = {}, 0, 0
    for length, count in enumerate(bits, 1):
        for _ in range(count):
            table[length, code] = values[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _zigzag() -> list[int]:
    cells = sorted(((x + y, x if (x + y) % 2 else y, y * 8 + x) for y in range(8) for x in range(8)), key=lambda c: c[:2])
    # Even diagonals run upwards, odd ones downwards.
    out = []
    for d in range(15):
        line = [c[2] for c in cells if c[0] == d]
        line.sort(key=lambda p: p // 8, reverse=d % 2 == 0)
        out += line
    return out


_ZIGZAG = _zigzag()
_k = np.arange(8)
_COSINE = np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16) * np.where(_k == 0, np.sqrt(0.125), 0.5)


def _baseline(scans: list[bytes], comps: list[dict], rows: int, columns: int, restart: int) -> np.ndarray:
    """The first component (luma) of a baseline frame."""
    most_h, most_v = max(c["h"] for c in comps), max(c["v"] for c in comps)
    alone = len(comps) == 1
    if alone:
        most_h, most_v, comps[0]["h"], comps[0]["v"] = 1, 1, 1, 1
    across, down = -(-columns // (8 * most_h)), -(-rows // (8 * most_v))
    luma = comps[0]
    plane = np.zeros((down * luma["v"] * 8, across * luma["h"] * 8))
    before = [0] * len(comps)
    pieces, bits = iter(scans), None
    for unit in range(across * down):
        if bits is None or (restart and unit % restart == 0):
            bits, before = _Bits(next(pieces)), [0] * len(comps)
        for i, c in enumerate(comps):
            for v in range(c["v"]):
                for h in range(c["h"]):
                    block = [0] * 64
                    before[i] += bits.signed(bits.symbol(c["dc"]))
                    block[0] = before[i] * c["q"][0]
                    k = 1
                    while k < 64:
                        rs = bits.symbol(c["ac"])
                        if not rs & 15:
                            if rs != 0xF0:
                                break
                            k += 16
                            continue
                        k += rs >> 4
                        block[_ZIGZAG[k]] = bits.signed(rs & 15) * c["q"][k]
                        k += 1
                    if not i:
                        y, x = (unit // across * c["v"] + v) * 8, (unit % across * c["h"] + h) * 8
                        plane[y : y + 8, x : x + 8] = _COSINE @ np.array(block, float).reshape(8, 8) @ _COSINE.T + 128
    return np.clip(np.rint(plane[:rows, :columns]), 0, 255).astype(np.uint8)


def _lossless(scans: list[bytes], table: dict, rows: int, columns: int, predictor: int, restart: int) -> np.ndarray:
    out = np.zeros((rows, columns), np.int64)
    pieces, bits = iter(scans), None
    for y in range(rows):
        fresh = bits is None or (restart and (y * columns) % restart == 0)
        if fresh:
            bits = _Bits(next(pieces))
        for x in range(columns):
            left, up, corner = (out[y, x - 1] if x else 0), (out[y - 1, x] if y else 0), (out[y - 1, x - 1] if x and y else 0)
            if fresh:
                guess = left if x else 128
            elif not x:
                guess = up
            else:
                guess = (0, left, up, corner, left + up - corner, left + ((up - corner) >> 1), up + ((left - corner) >> 1), (left + up) // 2)[predictor]
            out[y, x] = (guess + bits.signed(bits.symbol(table))) & 0xFFFF
    return out.astype(np.uint8)


def read_frame(data: bytes) -> np.ndarray:
    """Samples (rows, columns) of a one-component lossless frame, or the luma of a baseline frame."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, tables, quants, restart, frame = 2, {}, {}, 0, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                bits = body[1:17]
                n = sum(bits)
                tables[body[0]] = (bits, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = struct.unpack(">64H" if wide else ">64B", body[1 : 129 if wide else 65])
                body = body[129 if wide else 65 :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            precision, rows, columns, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("only 8-bit samples")
            frame = marker
            comps = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "tq": body[8 + 3 * i]} for i in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("progressive and arithmetic frames are no intra frames of motion-JPEG")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan before its frame")
            for i in range(body[0]):
                c = next(c for c in comps if c["id"] == body[1 + 2 * i])
                c["td"], c["ta"] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            end = data.rfind(b"\xff\xd9")
            coded = data[at : end if end >= at else len(data)]
            if frame == 0xC3:
                if len(comps) > 1:
                    raise ValueError("one component is expected in a lossless frame")
                predictor = body[1 + 2 * body[0]]
                if tables[comps[0]["td"]] == (FIXED_BITS, FIXED_VALUES) and predictor == 1 and not restart:
                    return _read_fixed(coded.replace(b"\xff\0", b"\xff"), rows, columns)
            scans, last, k = [], 0, 0
            while (k := coded.find(b"\xff", k)) >= 0 and k + 1 < len(coded):
                if 0xD0 <= coded[k + 1] <= 0xD7:
                    scans.append(coded[last:k])
                    last = k + 2
                k += 2
            scans = [s.replace(b"\xff\0", b"\xff") for s in (*scans, coded[last:])]
            if frame == 0xC3:
                return _lossless(scans, _codes(*tables[comps[0]["td"]]), rows, columns, predictor, restart)
            for c in comps:
                c["q"] = quants[c["tq"]]
                c["dc"], c["ac"] = _codes(*tables[c["td"]]), _codes(*tables[16 + c["ta"]])
            return _baseline(scans, comps, rows, columns, restart)
    raise ValueError("no scan")
