"""Near-duplicate groups against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platen.llm import neardup, queries, shingles as shingling
from platen.llm.shingles import common, sets_of, words_of

SF = "/root/testdata/sf0.001"


def shingles(text, size):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    k = min(size, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows, size=4, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in combinations(sorted(sets), 2):
        if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
            parent[max(find(x), find(y))] = min(find(x), find(y))
    return {i: (len(sets[i]), find(i)) for i in sets}


def planted(n=160, seed=3):
    """Chains of near copies, exact copies, short texts and strangers."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randrange(20, 90))]
        for _ in range(10):
            out.append(" ".join(base))
            if rnd.random() < 0.8:
                base = [*base]
                base[rnd.randrange(len(base))] = rnd.choice(words)
    out += ["", None, "  \n\t", "One", "one", "one two", "ONE  two", "one two three four", "é É", "x" * 5000] * 2
    rnd.shuffle(out)
    return list(enumerate(out))


def test_planted_groups_match_brute_force(spark):
    rows = planted()
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_of_large_buckets_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rows = planted(seed=5)
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_documents_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = neardup.near_duplicate_groups(docs, 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


@pytest.mark.parametrize("sf_dir", [SF, SF.replace("0.001", "0.01")])
def test_query_equals_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    got = queries.queries()["op6_minhash_neardup"](spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.oracle_sql()["op6_minhash_neardup"]).fetchall())


def test_odd_rows_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, t) for i, t in planted(seed=9)] + [(None, "one two three four"), (7, None)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(neardup.ORACLE).fetchall()))


def test_odd_rows(spark):
    schema = "doc_id long, text string, node long, bucket long, component string"
    rows = [(1, "a b c d e f", 9, 9, "x"), (1, "a b c d e f", 9, 9, "x"), (None, "a b c d e f", 1, 1, None), (2, "a b c d e f", None, None, None), (3, None, 1, 1, "y")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicate_groups(docs, 4).collect())
    assert got == [("1", 3, 1, True), ("1", 3, 1, True), ("2", 3, 1, False), ("3", 0, 3, True), ("None", 3, None, True)]
    kept = neardup.without_near_duplicates(docs, 4)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    empty = docs.filter(F.lit(False))
    assert neardup.near_duplicate_groups(empty, 4).count() == 0
    assert neardup.without_near_duplicates(empty, 4).count() == 0


@pytest.mark.parametrize("size", [1, 4, 5])
def test_shingle_hashes_count_like_tuples(size):
    texts = [t for _, t in planted()] + ["a b c", "A b\x0bc\x1fd e"]
    assert [len(s) for s in sets_of(texts, size)] == [len(shingles(t, size)) for t in texts]


def test_components_of_chains_and_loops(spark):
    from platen.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7), (60, 61), (61, 62), (62, 60)]
    found, _ = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 60: 60, 61: 60, 62: 60}
    assert connected_components(spark.createDataFrame([], "a long, b long"))[0].count() == 0


def test_every_pair_of_a_bucket_is_tried_once():
    """Pairs at a similarity of about 0.8 in buckets led by a stranger: round 2 alone can find them."""
    rnd = random.Random(8)
    texts = []
    for _ in range(2500):
        words = [str(rnd.getrandbits(40)) for _ in range(60)]
        texts += [" ".join(words), " ".join([*words[:54], *(str(rnd.getrandbits(40)) for _ in range(6))])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["node", "text"])
    sets = pa.Table.from_batches(neardup._signed(1)([batch])).drop_columns(["text"])
    keys = [neardup.band_keys(neardup.signature(s)) for s in sets_of(texts, 1)]
    zeros = pa.array([0, 0], pa.int32())
    try_bucket = neardup._candidates(80)
    met = 0
    for i in range(0, len(texts), 2):
        shared = np.flatnonzero(keys[i] == keys[i + 1]).tolist()
        rows = sets.slice(i, 2).append_column("component", pa.array([i, i + 1], pa.int64())).append_column("block", zeros)
        found = [try_bucket([pa.scalar(v) for v in (0, band, 0, 0)], rows).to_pylist() for band in shared]
        met += bool(shared)
        assert sum(found, []) == ([{"a": i, "b": i + 1}] if shared else []), i
    assert met > 2400


def test_words_that_collide_in_polynomials_stay_apart(spark):
    """A Thue-Morse word and its complement collide in every polynomial hash modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    got = neardup.near_duplicate_groups(spark.createDataFrame([(1, word), (2, other), (3, word.upper())], "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}


def test_rows_of_one_doc_id_are_judged_by_their_own_text(spark):
    base = [f"w{i}" for i in range(60)]
    near, other = " ".join([*base[:59], "x"]), " ".join(f"v{i}" for i in range(30))
    rows = [(1, " ".join(base), "a"), (5, near, "b"), (5, other, "c"), (9, other, "d"), (1, "all of its own", "e"), (7, " ".join(base), "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicate_groups(docs, 4).collect())
    assert got == [(1, 1, True), (1, 1, True), (5, 1, False), (5, 5, True), (7, 1, False), (9, 5, False)]
    assert sorted(r.source for r in neardup.without_near_duplicates(docs, 4).collect()) == ["a", "c", "e"]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_common_shingles_like_tuples(size):
    texts = ["", "a", "a b", "a b c", "b a b a b a", "a b c d e f a b c d e f", "f e d c b a", "a b c d x f a b c d e f g"]
    for x in texts:
        for y in texts:
            one, two = shingles(x, size), shingles(y, size)
            assert common(words_of(x), words_of(y), size) == (len(one), len(two), len(one & two)), (x, y)


def test_texts_beyond_a_block(monkeypatch):
    monkeypatch.setattr(shingling, "BLOCK", 7)
    texts = [t for _, t in planted(seed=4)] + ["x" * 50 + " y" * 20]
    assert [len(s) for s in sets_of(texts, 4)] == [len(shingles(t, 4)) for t in texts]
    assert shingling.sequence_key("A  b c d e f g h i") == shingling.sequence_key("a b c d e f g h i") != shingling.sequence_key("a b c d e f g h i j")
    long = " ".join(f"w{i % 7919}" for i in range(400_000))
    monkeypatch.undo()
    assert [len(s) for s in sets_of([long], 4)] == [len(shingles(long, 4))]


def test_a_worker_keeps_the_tables_of_one_operator_at_a_time():
    from platen.llm import bpe, held, shingles
    from platen.llm.queries import tokenizer_path

    ids = [x.tolist() for x in bpe.codec(tokenizer_path()).encode(["some words"])]
    hashes = shingles.hashes_of("some words").tolist()
    assert shingles._hashes and not bpe._codec.cache_info().currsize
    assert [x.tolist() for x in bpe.codec(tokenizer_path()).encode(["some words"])] == ids
    assert bpe._codec.cache_info().currsize == 1 and not shingles._hashes
    assert shingles.hashes_of("some words").tolist() == hashes
    held.claim("toxicity")
    assert not shingles._hashes and not bpe._codec.cache_info().currsize
