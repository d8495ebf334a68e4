"""Encoding, packing and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platen.llm import bpe, packing, token_output
from platen.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  \n\n x", "don't we'll 's''s a 's", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|>", "é漢 ½٠ ​x", "word " * 3000, "!" * 200 + " " + "y" * 200]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "x"), (None, "null id", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_random_texts(library):
    rnd = random.Random(2)
    alphabet = "ab'sStTreveLlLdm12 ½  \n\t\r 　é漢!?'.,_-̀٠³​\U0001f600"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(4000)] + ODD
    for chunk, table in ((1 << 20, 10_000), (40, 60)):
        coded = bpe.WordCodec(tokenizer_path(), table, chunk).encode(texts)
        assert all(a.tolist() == ids_of(library, t) for a, t in zip(coded, texts, strict=True))


def test_words_of_one_key_are_told_apart(monkeypatch, library):
    monkeypatch.setattr(bpe.WordCodec, "_keys", lambda self, points, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = ["a bb ccc dd a bbb é bb", *ODD]
    assert [x.tolist() for x in bpe.WordCodec(tokenizer_path()).encode(texts)] == [ids_of(library, t) for t in texts]


def test_each_distinct_word_is_encoded_once(monkeypatch, library):
    seen = []
    encode = bpe.WordCodec.encode_words
    monkeypatch.setattr(bpe.WordCodec, "encode_words", lambda self, words: seen.extend(words) or encode(self, words))
    words = sorted([" the"] * 5 + [" a"] * 3 + ["é", "x" * 500, "x" * 500])
    batches = [pa.RecordBatch.from_pydict({"chunk": [j % 3 for j in range(k, k + len(part))], "word": part}) for k in range(0, len(words), 2) if (part := words[k : k + 2])]
    got = {}
    for b in bpe.coded_words(tokenizer_path(), rows=4)(iter(batches)):
        for r in b.to_pylist():
            listed, sizes, ids = bpe.unpacked(r["packed"])
            for w, n, end in zip(listed, sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
                got.setdefault(w, []).append(r["chunk"])
                assert ids[end - n : end].tolist() == ids_of(library, w)
    want = {}
    for k, w in enumerate(words):
        want.setdefault(w, []).append(k % 3)
    assert {w: sorted(c) for w, c in got.items()} == {w: sorted(c) for w, c in want.items()} and seen == sorted(set(words))


@pytest.fixture
def two_rows_a_batch(spark):
    """Small batches, so that a task's rows lie in several chunks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("chars", [1 << 24, 1])
def test_round_trip(spark, docs, library, two_rows_a_batch, chars):
    docs = docs.coalesce(2)
    got = bpe.round_trip_digests(docs, tokenizer_path(), chars).collect()
    want = []
    for r in docs.collect():
        ids = ids_of(library, r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.round_trip_digests(docs.filter(F.lit(False)), tokenizer_path()).count() == 0


def test_decode_gives_the_texts_back(spark, docs, two_rows_a_batch):
    back = bpe.decode_documents(bpe.encode_documents(docs, tokenizer_path(), chars=1), tokenizer_path(), chars=1).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())


def test_words_without_a_dictionary_are_encoded_all_the_same(library, tmp_path):
    loaded = bpe._Loaded(tokenizer_path(), f"file://{tmp_path}/none", f"{tmp_path}/none").at(7)
    assert [x.tolist() for x in loaded.codec.encode(ODD)] == [ids_of(library, t) for t in ODD]
    assert bpe.decode(np.array(ids_of(library, ODD[6])), loaded.piece) == ODD[6]


def test_texts_of_several_megabytes(spark, library):
    rnd = random.Random(4)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))) for _ in range(700_000))
    rows = spark.createDataFrame([(1, long), (2, "x" * 300_000), (3, "a")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.round_trip_digests(rows, tokenizer_path()).collect()}
    ids = ids_of(library, long)
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[2].decoded_sha256 == hashlib.sha256(b"x" * 300_000).hexdigest()
    check_pieces(packing.pack_documents(rows, tokenizer_path()).filter("doc_id <> 2").collect(), {1: [*ids, 0], 3: [*ids_of(library, "a"), 0]}, strict=False)


def check_pieces(rows, expected, window=1024, strict=True):
    """Every id lies in one piece; sequences have no gap and are full but for powers of two and few others."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(expected)
    for doc, pieces in by_doc.items():
        at, ids = 0, expected[doc]
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values() if strict else ():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / (window * len(by_sequence))


def test_packing(spark, library):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    expected = {r.doc_id: [*ids_of(library, r.text), 0] for r in table.collect()}
    rows = packing.pack_documents(table, tokenizer_path()).collect()
    assert check_pieces(rows, expected) == 0


def test_packing_odd_rows(spark, docs, library):
    unique = docs.dropDuplicates(["doc_id"])
    expected = {r.doc_id: [*ids_of(library, r.text), 0] for r in unique.collect()}
    check_pieces(packing.pack_documents(unique.repartition(3), tokenizer_path()).collect(), expected)
    assert packing.pack_documents(docs, tokenizer_path()).filter("doc_id = 3").agg(F.sum("length")).first()[0] == 2 * len(expected[3])
    assert packing.pack_documents(docs.filter(F.lit(False)), tokenizer_path()).count() == 0


def test_sum_of_squares_places_as_brute_force():
    rnd = random.Random(7)
    packer, counts = packing.SumOfSquares(16), [0] * 17
    for _ in range(3000):
        size = rnd.randrange(1, 16)
        options = []
        for level in range(17 - size):
            if level and not counts[level]:
                continue
            after = counts.copy()
            after[level] -= level > 0
            if level + size < 16:
                after[level + size] += 1
            options.append((sum(c * c for c in after[1:16]), -(level + size), after))
        counts = min(options, key=lambda o: o[:2])[2]
        packer.place((0, 0, np.zeros(size, np.uint32), size))
        assert packer.counts[1:16].astype(int).tolist() == counts[1:16]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, library, tmp_path, encoding):
    path = str(tmp_path / encoding)
    token_output.write_tokens(docs, tokenizer_path(), path, end_id=2, encoding=encoding)
    got = sorted(token_output.token_digests(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    for g, r in zip(got, rows, strict=True):
        ids = [*ids_of(library, r.text), 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), crc(ids))
        at += len(ids)
    assert token_output.read_tokens(spark, path, [6]).first().ids == [*ids_of(library, ODD[6]), 2]
    assert token_output.read_index(spark, path).agg(F.sum("n_tokens")).first()[0] == at
    import glob

    import pyarrow.parquet as pq

    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    columns = [m.row_group(0).column(m.num_columns - 1) for m in files if m.num_row_groups]
    assert all(c.has_offset_index for c in columns)
    assert all(("DELTA_BINARY_PACKED" in c.encodings) == (encoding == "delta") for c in columns)
    plan = token_output.read_index(spark, path)._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split(">")[0]


def test_empty_token_file(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    token_output.write_tokens(docs.filter(F.lit(False)), tokenizer_path(), path)
    assert token_output.token_digests(spark, path).count() == 0
    with pytest.raises(ValueError):
        token_output.write_tokens(docs, tokenizer_path(), path, encoding="plain")


def test_rest_of_a_task_needs_no_padding():
    """Three documents of 300, 300 and 437 ids: one window and powers of two."""
    sequences = list(packing.pack((k, np.zeros(n, np.uint32)) for k, n in enumerate((300, 300, 437))))
    sizes = [sum(len(p[2]) for p in s) for s in sequences]
    assert sizes == [1024, 8, 4, 1]
