"""Word shingles of whole texts.

Words are maximal runs without the bytes 0x20 and 0x09 to 0x0D, after A-Z is
lower-cased. A set holds the distinct runs of `size` words; a text with fewer
words has its whole sequence as its one shingle; a text without words has none.

Signatures and set sizes use 64-bit hashes: a word's is BLAKE2b, so no family of words
collides by its form. Links and equal texts are decided on the words themselves
(`common`) and on 128 bits of BLAKE2b over them (`sequence_key`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

from platen.llm.held import claim

BLOCK = 1 << 20  # bytes that are words at a time
TABLE_WORDS = 300_000  # word hashes that a worker keeps
_BASE = np.uint64(0xA0761D6478BD642F)
_MIX = np.uint64(0xE7037ED1A0B428DB)
_LANES = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_GAPS = b" \t\n\r\x0b\x0c"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    """Hashes of words; when it is full it starts again, which costs time only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_WORDS:
            self.clear()
        known = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = known
        return known


_hashes = _Hashes()


def _blocks(text: str | None) -> Iterator[list[bytes]]:
    """Words, of about BLOCK bytes at a time."""
    data, at = (text or "").encode(), 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and data[end] not in _GAPS:
            end += 1
        yield data[at:end].lower().split()
        at = end


def words_of(text: str | None) -> list[bytes]:
    return [w for block in _blocks(text) for w in block]


def hashes_of(text: str | None) -> np.ndarray:
    """Word hashes, in order."""
    claim("shingles", _hashes.clear)
    parts = [np.fromiter(map(_hashes.__getitem__, block), np.uint64, len(block)) for block in _blocks(text)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts])


def sequence_key(text: str | None) -> tuple[int, int]:
    """Two signed 64-bit halves of a digest of the words in order."""
    digest = hashlib.blake2b(digest_size=16)
    for block in _blocks(text):
        if block:
            digest.update(b" ".join(block) + b" ")
    a, b = np.frombuffer(digest.digest(), "<i8").tolist()
    return a, b


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(n, size)
    total = np.full(n - k + 1, k * int(_MIX) % (1 << 64), np.uint64)
    for j in range(k):
        total += words[j : n - k + 1 + j] * _LANES[j]
    return np.unique(mix(total))


def sets_of(texts: Iterable[str | None], size: int) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_set(hashes_of(text), size)


def _numbered(ids: np.ndarray, k: int, words: int) -> np.ndarray:
    """A number for each run of k ids, equal for equal runs."""
    runs = len(ids) - k + 1
    out, top = ids[:runs], words
    for j in range(1, k):
        if top > (1 << 62) // words:
            out = np.unique(out, return_inverse=True)[1]
            top = len(out)
        out, top = out * words + ids[j : j + runs], top * words
    return out


def common(x: list[bytes], y: list[bytes], size: int) -> tuple[int, int, int]:
    """Sizes of the two shingle sets and of their intersection, counted on the words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in chain(x, y)), np.int64, len(x) + len(y))
    k, other = min(len(x), size), min(len(y), size)
    if k != other or not k:  # no run of one text is as long as one of the other
        sizes = (len(np.unique(_numbered(part, n, len(number)))) if n else 0 for part, n in ((ids[: len(x)], k), (ids[len(x) :], other)))
        return *sizes, 0
    # Numbered together; the runs over the border between the texts are left out.
    codes = _numbered(ids, k, len(number))
    a, b = np.unique(codes[: len(x) - k + 1]), np.unique(codes[len(x) :])
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))
