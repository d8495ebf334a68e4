"""Byte-level BPE through a distinct-word table.

The pre-tokeniser of a byte-level BPE cuts a text into words and merges never
cross a word, so equal words always get equal ids. Documents are numbered in chunks of
about DICTIONARY_CHARS characters, each within the task that reads it. `dictionaries` splits all
texts, sorts the distinct words of all chunks together in Spark, encodes each distinct word once
with the tokenizers library and hands every chunk its words with their ids, as files in
the shared folder. The tasks that read the documents again join the ids back by position, from
their chunk's dictionary. Decoding goes the same way: the distinct ids of a chunk are
joined with the id-to-piece table, and pieces are put in place by position. A word
that its chunk's dictionary lacks (a plan that deals rows differently the second time)
is encoded on the spot, so results never depend on the numbering.

A `WordCodec` by itself keeps a bounded table of the words that a task has met. The split and
the positional join are array operations; words that share a look-up key are
compared, and the library only ever sees distinct words.

Split rules (those of the library's byte-level pre-tokeniser):

* runs of letters, of digits, of white space and of other characters;
* one U+0020 in front of a run that isn't white space belongs to that run;
* of a longer white-space run that a word follows, the last character stands
  apart from the others;
* an apostrophe that starts a word takes s, t, m, d, re, ve or ll with it.

The class of a code point is asked from the library itself the first time it is
seen, so its Unicode version counts, not Python's.

Nulls count as empty texts; an empty text has no ids. Added tokens that stand in
a text (such as an end-of-text marker) get their own id, as in the library.
Long texts are cut at places that always separate words, so memory is bounded
by CHUNK characters plus the longest run without white space. The word table is
bounded as well: when it is full it starts again, which costs time only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.held import claim
from platen.session import shared_folder

CHUNK = 1 << 20  # characters that are split at once
TABLE_WORDS = 300_000  # distinct words that a task's own table holds, about 80 MB
LONG_WORD = 48  # longer words have no place in that table
DICTIONARY_CHARS = 16 << 20  # bytes of text that share a dictionary
PACKED_ROWS = 250_000  # rows that a task groups by chunk before it hands them on

_LETTER, _DIGIT, _OTHER, _SPACE, _UNKNOWN = range(5)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


class WordCodec:
    """Encodes texts as the tokenizers library does, each distinct word once."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS, chunk: int = CHUNK) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.table_words, self.chunk = table_words, chunk
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.added_re = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.powers = _Powers()
        self.model = self.library.model
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.lost = 0
        self.pool, self.used = np.empty(1 << 16, np.int32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _class_of(self, char: str) -> int:
        for kind, side in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!")):
            if len(self.library.pre_tokenizer.pre_tokenize_str(side + char + side)) == 1:
                return kind
        return _SPACE

    def word_starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words start. first marks where a part starts; words don't cross parts."""
        kinds = self.classes[points]
        if (kinds == _UNKNOWN).any():
            for p in np.unique(points[kinds == _UNKNOWN]).tolist():
                self.classes[p] = self._class_of(chr(p))
            kinds = self.classes[points]
        n = len(points)
        runs = first.copy()
        runs[1:] |= kinds[1:] != kinds[:-1]
        starts = runs.copy()
        # White space in front of a word of the same part.
        ahead = np.flatnonzero(runs[1:] & (kinds[1:] != _SPACE) & (kinds[:-1] == _SPACE) & ~first[1:]) + 1
        starts[ahead - 1] = True
        starts[ahead[points[ahead - 1] == 32]] = False
        # Contractions.
        marks = np.flatnonzero((points == 39) & runs & starts)
        marks = marks[marks + 1 < n]
        marks = marks[(kinds[marks + 1] == _LETTER) & ~first[marks + 1]]
        if len(marks):
            one = points[marks + 1]
            two = np.where((marks + 2 < n) & ~first[np.minimum(marks + 2, n - 1)], points[np.minimum(marks + 2, n - 1)], 0)
            short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
            long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            starts[marks[short | long] + 1] = False
            for ends in (marks[short] + 2, marks[long] + 3):
                starts[ends[ends < n]] = True
        return np.flatnonzero(starts)

    def _keys(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.powers.upto(len(points) + 1)
        sums = np.empty(len(points) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words as the split gives them."""
        merge, letters = self.model.tokenize, self.letters
        return [[t.id for t in merge(w.encode().decode("latin-1").translate(letters))] for w in words]

    def _add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        slot, total = len(self.slots) + self.lost, len(ids)
        if slot + len(words) > len(self.at):
            room = max(2 * len(self.at), slot + len(words))
            self.at, self.size = np.resize(self.at, room), np.resize(self.size, room)
        if self.used + total > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool) + total)
        self.slots.update(zip(words, range(slot, slot + len(words)), strict=True))
        self.size[slot : slot + len(words)] = sizes
        self.at[slot : slot + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + total] = ids
        self.used += total

    def load(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Start again with a dictionary: distinct words, their numbers of ids, and all ids in a row."""
        self._reset()
        self._add(words, sizes, ids)

    def _distinct(self, whole: str, points: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The distinct words, and for each word its number among them."""
        ends = np.append(starts[1:], len(points))
        _, where, back = np.unique(self._keys(points, starts, ends), return_index=True, return_inverse=True)
        lo, hi = starts[where].tolist(), ends[where].tolist()
        words = [whole[a:b] for a, b in zip(lo, hi, strict=True)]
        # Keys may collide: every word is compared with the one that its key stands for.
        sizes, first = ends - starts, where[back]
        other = np.arange(len(points)) + np.repeat(starts[first] - starts, sizes)
        differ = points[np.minimum(other, len(points) - 1)] != points
        odd = np.flatnonzero((sizes != sizes[first]) | np.logical_or.reduceat(differ, starts)).tolist()
        if odd:
            number = {w: k for k, w in enumerate(words)}
            for i in odd:
                w = whole[starts[i] : ends[i]]
                back[i] = number.setdefault(w, len(number))
            words = list(number)
        return words, back

    def distinct_words(self, texts: Iterable[str | None]) -> set[str]:
        """All words of texts."""
        out: set[str] = set()
        group: list[str] = []
        held = 0

        def add() -> None:
            if held:
                whole = "".join(group)
                points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
                first = np.zeros(len(points), bool)
                first[np.cumsum([0, *map(len, group)])[:-1]] = True
                out.update(self._distinct(whole, points, self.word_starts(points, first))[0])

        for text in texts:
            for piece in self._cuts(text or ""):
                if isinstance(piece, str):
                    group.append(piece)
                    held += len(piece)
                    if held >= self.chunk:
                        add()
                        group, held = [], 0
        add()
        return out

    def encode_parts(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each part; parts are encoded apart from one another."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        edges = np.concatenate([[0], np.cumsum(lengths)])
        if not edges[-1]:
            return [np.empty(0, np.int32)] * len(parts)
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        first[edges[:-1][lengths > 0]] = True
        starts = self.word_starts(points, first)
        words, back = self._distinct(whole, points, starts)
        if len(self.slots) + self.lost + len(words) > max(self.table_words, 2 * len(words)):
            self._reset()
        new = [w for w in words if w not in self.slots]
        if new:
            coded = self.encode_words(new)
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            self._add(new, sizes, np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum())))
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        sizes, at = self.size[slots][back], self.at[slots][back]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(at - offsets[:-1], sizes) + np.arange(offsets[-1])]
        for w in new:
            if len(w) > LONG_WORD:  # its slot stays unused until the table starts again
                del self.slots[w]
                self.lost += 1
        bounds = offsets[np.searchsorted(starts, edges)]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _cuts(self, text: str) -> Iterator[str | int]:
        """Pieces of at most about a chunk, and the ids of added tokens between them."""
        at = 0
        for m in self.added_re.finditer(text) if self.added_re else ():
            yield from self._segments(text, at, m.start())
            yield self.added[m[0]]
            at = m.end()
        yield from self._segments(text, at, len(text))

    def _segments(self, text: str, at: int, end: int) -> Iterator[str]:
        while end - at > self.chunk:
            m = re.compile(r"(?<=\S)\s").search(text, at + self.chunk, end)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        if end > at:
            yield text[at:end]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        parts: list[str] = []
        docs: list[list[int | None]] = []  # of each text: an added id, or None for the next part
        chars = 0
        for text in texts:
            plan: list[int | None] = []
            if text and len(text) <= self.chunk and not (self.added_re and self.added_re.search(text)):
                plan.append(None)
                parts.append(text)
                chars += len(text)
            else:
                for piece in self._cuts(text or ""):
                    if isinstance(piece, int):
                        plan.append(piece)
                    else:
                        plan.append(None)
                        parts.append(piece)
                        chars += len(piece)
            docs.append(plan)
            if chars >= self.chunk:
                yield from self._done(parts, docs)
                parts, docs, chars = [], [], 0
        yield from self._done(parts, docs)

    def _done(self, parts: list[str], docs: list[list[int | None]]) -> Iterator[np.ndarray]:
        groups, held = [], 0
        group: list[str] = []
        for p in parts:  # a long text has several parts: one chunk at a time
            if group and held + len(p) > 2 * self.chunk:
                groups.append(group)
                group, held = [], 0
            group.append(p)
            held += len(p)
        groups.append(group)
        coded = (ids for g in groups for ids in self.encode_parts(g))
        for plan in docs:
            if plan == [None]:
                yield next(coded)
            elif not plan:
                yield np.empty(0, np.int32)
            else:
                yield np.concatenate([next(coded) if x is None else np.array([x], np.int32) for x in plan])


@lru_cache(maxsize=2)
def _codec(path: str) -> WordCodec:
    return WordCodec(path)


def _let_go() -> None:
    _codec.cache_clear()
    pieces.cache_clear()


def codec(path: str) -> WordCodec:
    """The codec of a Python worker; its word table lasts over tasks, until another operator's tables take its place."""
    claim("codec", _let_go)
    return _codec(path)


_BYTE_OF: dict[str, int] = {}


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    if not _BYTE_OF:
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        _BYTE_OF.update({chr(b): b for b in plain})
        _BYTE_OF.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return _BYTE_OF


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table as bytes; its size is that of the vocabulary."""
    library = codec(path).library
    letters = byte_alphabet()
    table = [b""] * library.get_vocab_size(with_added_tokens=True)
    for token, i in library.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return table


def decode(ids: np.ndarray, table: list[bytes] | dict[int, bytes]) -> str:
    """Text of ids: the pieces are joined by id; broken UTF-8 is replaced."""
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def few_rows(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python strings at a time."""
    return (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))


def text_column(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def _numbered(batches: Iterable[pa.RecordBatch], column: int, chars: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the batches with the number of their chunk."""
    chunk, held = (TaskContext.get().partitionId() << 24) + 1, 0
    for rows in few_rows(batches):
        if held >= chars:
            chunk, held = chunk + 1, 0
        yield chunk, rows
        held += rows.column(column).nbytes


def _by_chunk(rows: DataFrame, name: str) -> str:
    """Write rows with a column chunk, one folder for each chunk; return the path."""
    path = shared_folder(rows.sparkSession, name)
    rows.repartition("chunk").write.partitionBy("chunk").option("compression", "zstd").parquet(path)
    return path


def _of_chunk(path: str, chunk: int, columns: list[str]) -> pa.Table | None:
    """The rows of a chunk, read by the task that needs them."""
    if path.startswith("file:"):
        path = path[5:].replace("//", "/", 1) if path.startswith("file://") else path[5:]
    fs, root = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/chunk={chunk}", allow_not_found=True))
    tables = []
    for info in found:
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                tables.append(pq.ParquetFile(f).read(columns))
    return pa.concat_tables(tables).combine_chunks() if tables else None


def packed(words: list[str], ids: list[list[int]]) -> bytes:
    """Words with their ids as one value, compressed where that pays."""
    coded = [w.encode() for w in words]
    sizes = [np.fromiter(map(len, x), np.uint32, len(x)) for x in (coded, ids)]
    flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[1].sum()))
    # Bytes of one rank stand together: most of them are zero.
    planes = [x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in (*sizes, flat)]
    plain = np.array([len(words), len(flat)], np.uint32).tobytes() + b"".join(planes) + b"".join(coded)
    small = zstandard.ZstdCompressor(level=3).compress(plain) if len(plain) > 200 else plain
    return b"1" + small if len(small) < len(plain) else b"0" + plain


def unpacked(value: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, their numbers of ids and all ids of a packed value."""
    data = zstandard.ZstdDecompressor().decompress(value[1:]) if value[:1] == b"1" else value[1:]
    n, total = np.frombuffer(data, np.uint32, 2).tolist()
    at, parts = 8, []
    for k in (n, n, total):
        parts.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * k, at).reshape(4, k).T).view(np.uint32).ravel())
        at += 4 * k
    offsets = np.concatenate([[0], np.cumsum(parts[0])]).astype(np.int32)
    words = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data[at:])).to_pylist()
    return words, parts[1].astype(np.int64), parts[2].astype(np.int32)


def coded_words(path: str, rows: int = PACKED_ROWS):
    """An Arrow function from (chunk, word), sorted by word, to (chunk, packed): each distinct word is encoded once.

    The words that some rows hold for one chunk travel as one packed value.
    """

    def run(batches):
        last, ids, held = None, [], 0
        of_chunk: dict[int, tuple[list, list]] = {}

        def flush():
            for chunks in (list(of_chunk)[k : k + 256] for k in range(0, len(of_chunk), 256)):
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([packed(*of_chunk[c]) for c in chunks], pa.binary())], ["chunk", "packed"])
            of_chunk.clear()

        for batch in batches:
            words, chosen, new = batch.column(1).to_pylist(), [], []
            for w in words:
                if w != last:
                    new.append(w)
                    last = w
                chosen.append(len(new))  # 0: the last word of the batch before
            coded = [ids, *codec(path).encode_words(new)]
            ids = coded[-1]
            for c, w, k in zip(batch.column(0).to_pylist(), words, chosen, strict=True):
                if c not in of_chunk:
                    of_chunk[c] = ([], [])
                of_chunk[c][0].append(w)
                of_chunk[c][1].append(coded[k])
            held += len(words)
            if held >= rows:
                yield from flush()
                held = 0
        yield from flush()

    return run


def dictionaries(texts: DataFrame, path: str, chars: int = DICTIONARY_CHARS) -> str:
    """Store (chunk, packed) of texts (text): the distinct words of each chunk with their ids, each distinct word of all encoded once."""

    def split(batches):
        held, words = None, set()
        for chunk, rows in _numbered(batches, 0, chars):
            if chunk != held and words:
                yield from _words_of(held, words)
                words = set()
            held = chunk
            words |= codec(path).distinct_words(rows.column(0).to_pylist())
        yield from _words_of(held, words)

    # A word stands once for each chunk, so even the most frequent one is no hot key, and all its rows are neighbours.
    words = text_column(texts.select("text")).mapInArrow(split, "chunk long, word string").repartition("word").sortWithinPartitions("word")
    return _by_chunk(words.mapInArrow(coded_words(path), "chunk long, packed binary"), "dictionaries")


def _words_of(chunk: int | None, words: set[str]) -> Iterator[pa.RecordBatch]:
    listed = list(words)
    for k in range(0, len(listed), 50_000):
        part = listed[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(part), pa.int64()), pa.array(part, pa.string())], ["chunk", "word"])


def piece_tables(ids: DataFrame, path: str) -> str:
    """Store (chunk, id, piece) for the distinct ids of each chunk of ids (chunk, id), by a join with the id-to-piece table."""
    table = pieces(path)
    # Its size is that of the vocabulary, so it is broadcast.
    rows = ids.sparkSession.createDataFrame(pa.table({"id": pa.array(range(len(table)), pa.int32()), "piece": pa.array(table, pa.binary())}))
    return _by_chunk(ids.distinct().join(F.broadcast(rows), "id").select("chunk", "id", "piece"), "pieces")


class _Loaded:
    """The dictionary and the pieces of the chunk that a task reads."""

    def __init__(self, path: str, words: str | None, parts: str | None) -> None:
        self.path, self.words, self.parts, self.chunk = path, words, parts, None
        self.codec = WordCodec(path) if words else None

    def at(self, chunk: int) -> _Loaded:
        if chunk != self.chunk:
            self.chunk, self.piece = chunk, _Pieces(self.path)
            if self.words and (table := _of_chunk(self.words, chunk, ["packed"])):
                words, sizes, ids = zip(*map(unpacked, table.column("packed").to_pylist()), strict=True)
                del table
                words = list(chain.from_iterable(words))
                self.codec.table_words = TABLE_WORDS + len(words)
                self.codec.load(words, np.concatenate(sizes), np.concatenate(ids))
            if self.parts and (table := _of_chunk(self.parts, chunk, ["id", "piece"])):
                self.piece.update(zip(table.column("id").to_pylist(), table.column("piece").to_pylist(), strict=True))
        return self


class _Pieces(dict):
    """Pieces by id; one that no dictionary word holds (an added token) comes from the vocabulary."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __missing__(self, i: int) -> bytes:
        piece = self[i] = pieces(self.path)[i]
        return piece


def _documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return text_column(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", chars: int = DICTIONARY_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) of every document; null and empty texts have no ids."""
    texts = _documents(docs, doc_id, text)
    words = dictionaries(texts.select("text"), path, chars)

    def run(batches):
        loaded = _Loaded(path, words, None)
        for chunk, rows in _numbered(batches, 1, chars):
            ids = list(loaded.at(chunk).codec.encode(rows.column(1).to_pylist()))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    return texts.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str, chars: int = DICTIONARY_CHARS) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), through the join of each chunk's ids with their pieces; null ids give an empty text."""
    rows = coded.select("doc_id", F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def listed(batches):
        for chunk, part in _numbered(batches, 1, chars):
            found = pc.unique(part.column(1).flatten())
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(found), pa.int64()), found], ["chunk", "id"])

    parts = piece_tables(rows.mapInArrow(listed, "chunk long, id int"), path)

    def run(batches):
        loaded = _Loaded(path, None, parts)
        for chunk, part in _numbered(batches, 1, chars):
            table = loaded.at(chunk).piece
            texts = [decode(np.asarray(x, np.int64), table) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, chars: int = DICTIONARY_CHARS) -> DataFrame:
    """One row per document: number of ids, and digests of the ids and of the text decoded from them.

    Equals encode_documents followed by decode_documents without moving ids
    between Python and the JVM. Repeated rows give repeated rows; a null doc_id
    stays null.
    """
    texts = _documents(docs)
    words = dictionaries(texts.select("text"), path, chars)
    known = texts.sparkSession.read.schema("packed binary, chunk long").parquet(words).select("chunk", "packed")

    def listed(batches):
        # A chunk's rows are one file, so they follow one another: each of its ids is handed on once.
        held, seen = None, np.empty(0, np.int32)
        for batch in batches:
            for chunk, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != held:
                    yield of_chunk(held, seen)
                    held, seen = chunk, np.empty(0, np.int32)
                seen = np.union1d(seen, unpacked(value)[2])
        yield of_chunk(held, seen)

    def of_chunk(chunk, ids):
        return pa.RecordBatch.from_arrays([pa.array([chunk] * len(ids), pa.int64()), pa.array(ids, pa.int32())], ["chunk", "id"])

    parts = piece_tables(known.mapInArrow(listed, "chunk long, id int"), path)

    def run(batches):
        loaded = _Loaded(path, words, parts)
        for chunk, rows in _numbered(batches, 1, chars):
            n, of_ids, of_text = [], [], []
            for ids in loaded.at(chunk).codec.encode(rows.column(1).to_pylist()):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(decode(ids, loaded.piece).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
