"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

One permutation scatters the shingles of a document over 2**20 slots; a second
one, read at a window that starts at each slot, gives all signature coordinates:
coordinate k is the least value of the second permutation shifted by k. Equal
sets collapse to their smallest doc_id first. Bands of the signature put the
remaining sets into buckets, and a bucket's pairs are tried in two rounds:

1. every set against the least one of its bucket;
2. in buckets whose sets are still in more than one component, all pairs over different
   components whose signatures, LONG coordinates for these sets, agree enough, in
   blocks of about BLOCK sets. A pair is only tried in the first band whose bucket it shares.

Each link is confirmed on the words of both texts (100 * intersection >= percent * union).
Pairs that round 2 leaves out are connected already, so components lose nothing.
At a similarity of 0.8 banding misses a pair with a probability below 7e-5 and
the signature test of round 2 one below 6e-5; both vanish quickly above.

Texts of one word sequence (128 bits of BLAKE2b over it) are one class, whatever their
doc_ids. Joins with a class, bucket or leader that many rows share are salted, so a hot one
is dealt over tables.SALTS tasks.

Defined cases: null, empty and blank texts have empty sets and link with
nothing; a null doc_id links with nothing and stands alone (component null, kept);
each row is judged by its own set, so rows that share a doc_id may lie in
different components; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.bpe import few_rows, text_column
from platen.llm.components import connected_components, contracted
from platen.llm.shingles import common, hashes_of, mix, sequence_key, shingle_set, words_of
from platen.llm.tables import dropped, salted, small, spread, stored

SLOTS = 1 << 20
BANDS = 32
ROWS = 6
WIDTH = BANDS * ROWS
LONG = 1024
BLOCK = 2048
ROUGH, FINE = 0.12, 0.05  # below the threshold: least agreement of the first WIDTH and of all LONG coordinates
SKETCH = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"


@lru_cache(maxsize=1)
def _order() -> np.ndarray:
    """The second permutation, continued round the circle."""
    order = np.random.default_rng(20).permutation(SLOTS).astype(np.int32)
    return np.concatenate([order, order[:LONG]])


def signature(shingles: np.ndarray, width: int = WIDTH) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(_order(), width)
    slots = (mix(shingles) & np.uint64(SLOTS - 1)).astype(np.int64)
    sign = np.full(width, SLOTS, np.int32)
    step = 1024 * WIDTH // width
    for at in range(0, len(slots), step):
        np.minimum(sign, windows[slots[at : at + step]].min(axis=0), out=sign)
    return sign


_BAND_SALT = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def band_keys(sign: np.ndarray) -> np.ndarray:
    keys = _BAND_SALT.copy()
    for column in sign.reshape(BANDS, ROWS).T:
        keys = mix(keys ^ column.astype(np.uint64))
    return keys.view(np.int64)


def _sketch(size: int):
    def run(batches):
        for batch in few_rows(batches):
            n, a, b, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(hashes_of(text), size)
                key = sequence_key(text)
                n.append(len(s))
                a.append(key[0])
                b.append(key[1])
                bands.append(band_keys(signature(s)) if len(s) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*bands, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), keys], ["doc_id", "n_shingles", "key_a", "key_b", "bands"])

    return run


def _keyed(batches):
    """(doc_id, text) with the halves of the sequence key."""
    for batch in few_rows(batches):
        keys = [sequence_key(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(2))], ["doc_id", "text", "key_a", "key_b"])


def _signed(size: int):
    def run(batches):
        for batch in few_rows(batches):
            n, signs, bands = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(hashes_of(text), size)
                sign = signature(s, LONG)
                n.append(len(s))
                signs.append((sign & 255).astype(np.uint8).tobytes())
                bands.append(band_keys(sign[:WIDTH]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(signs, pa.binary()), pa.array(bands, pa.binary()), batch.column(1)], ["node", "n_shingles", "sign", "keys", "text"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> tuple[DataFrame, str]:
    """The pairs (a, b) whose texts are similar enough, stored. Many pairs may share an a: its text goes once to each salt."""

    def run(batches):
        last, words = None, []
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, words = a, words_of(x.as_py())
                one, two, both = common(words, words_of(y.as_py()), size)
                keep.append(both > 0 and 100 * both >= percent * (one + two - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Sizes alone rule out many pairs before any text moves.
    size_a, size_b = (sets.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}")) for c in "ab")
    sized = salted(pairs, "b").join(spread(size_a), ["a", "_salt"]).join(size_b, "b")
    near, near_path = stored(sized.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "_salt"), "near")
    left = near.select("a", "_salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("text").alias("of_a")), "a")
    right = sets.select(F.col("node").alias("b"), F.col("text").alias("of_b"))
    found = stored(near.join(right, "b").join(left, ["a", "_salt"]).select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long"), "confirmed")
    dropped(pairs.sparkSession, near_path)
    return found


def _candidates(percent: int):
    """Pairs of a block of a bucket that lie in different components and may be similar."""
    rough, fine = (percent / 100 - ROUGH) * WIDTH, (percent / 100 - FINE) * LONG

    def run(key, table):
        band, left, right = (key[i].as_py() for i in (1, 2, 3))
        node, comp, n, block = (table.column(c).to_numpy() for c in ("node", "component", "n_shingles", "block"))
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint8).reshape(-1, LONG)
        first = np.ascontiguousarray(sign[:, :WIDTH])
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)
        found_a, found_b = [], []
        for i in np.flatnonzero(block == left).tolist():
            others = np.flatnonzero((block == right) & (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            if left == right:
                others = others[others > i]
            others = others[(first[others] == first[i]).sum(axis=1) >= rough]
            others = others[(sign[others] == sign[i]).sum(axis=1) >= fine]
            if len(others):
                # By the keys that make the buckets: eight bits of the coordinates may agree where the bucket differs.
                others = others[(keys[others] == keys[i]).argmax(axis=1) == band]
                found_a.append(np.minimum(node[i], node[others]))
                found_b.append(np.maximum(node[i], node[others]))
        empty = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate([empty, *found_a]), "b": np.concatenate([empty, *found_b])})

    return run


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, component, component_id) of every row of docs (doc_id, text).

    component names the component itself: two may share the doc_id that is their component_id.
    """
    spark = docs.sparkSession
    texts = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sketches, sketch_path = stored(texts.mapInArrow(_sketch(shingle), SKETCH).withColumn("row", F.monotonically_increasing_id()), "sketches")

    # Equal sequences collapse to one row, the node of their class.
    usable = F.expr("n_shingles > 0 and doc_id is not null")
    best = sketches.filter(usable).groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("rows"))
    copies = best.filter("rows > 1").select("key_a", "key_b", F.col("best.row").alias("node"), F.col("best.doc_id").alias("least"))
    of_class = salted(sketches, "row").join(spread(copies), ["key_a", "key_b", "_salt"], "left")
    node = F.when(usable, F.coalesce("node", "row"))
    placed, placed_path = stored(
        of_class.select("doc_id", "n_shingles", "key_a", "key_b", node.alias("node"), F.when(usable, F.coalesce("least", "doc_id")).alias("least"), F.when(node == F.col("row"), F.col("bands")).alias("bands")),
        "classes",
    )
    dropped(spark, sketch_path)

    nodes = placed.filter("bands is not null")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("members")).filter("members > 1")
    met, met_path = stored(salted(buckets, "node").join(spread(shared), ["bucket", "_salt"]).drop("_salt"), "buckets")

    wanted, wanted_path = stored(nodes.select("node", "doc_id", "key_a", "key_b").join(met.select("node").distinct(), "node", "left_semi"), "wanted")
    involved = texts.join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(_keyed, "doc_id long, text string, key_a long, key_b long")
    one_each = involved.dropDuplicates(["doc_id", "key_a", "key_b"]).join(wanted, ["doc_id", "key_a", "key_b"]).select("node", "text")
    sets, set_path = stored(one_each.mapInArrow(_signed(shingle), "node long, n_shingles long, sign binary, keys binary, text string"), "sets")

    stars = met.filter("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links, link_path = _confirmed(stars, sets, shingle, percent)
    # One contraction is enough here: it only tells which pairs are connected already.
    first, first_path = contracted(links)

    labels = first.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    joined = met.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = joined.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    open_rows = (
        salted(joined, "node")
        .join(spread(split), ["bucket", "_salt"])
        .withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(sets.select("node", "n_shingles", "sign", "keys"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "band", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", "component", "n_shingles", "sign", "keys")
    )
    pairs = open_rows.groupBy("bucket", "band", "left", "right").applyInArrow(_candidates(percent), "a long, b long")
    more, more_path = _confirmed(pairs, sets, shingle, percent)
    linked, linked_path = connected_components(first.union(more))

    # A component's id is the least doc_id of its classes, not their least node.
    least = linked.join(nodes.select("node", "least"), "node")
    whole = least.groupBy("component").agg(F.min("least").alias("component_id"))
    final, _ = stored(salted(linked, "node").join(spread(whole), ["component", "_salt"]).select("node", "component", "component_id"), "components")
    dropped(spark, met_path, wanted_path, set_path, link_path, first_path, more_path, linked_path)
    found = salted(placed.drop("bands").withColumn("row", F.monotonically_increasing_id()), "row").join(spread(final), ["node", "_salt"], "left")
    return found.select("doc_id", "n_shingles", "key_a", "key_b", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "least", "doc_id").alias("component_id"))


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text)."""
    kept = F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    return _grouped(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id.

    Rows are told apart by doc_id and word sequence: of rows that repeat both the least by its JSON form
    stays; a row that shares its doc_id with another text goes only for its own text's sake. Of
    several texts under a group's smallest doc_id the one with the least sequence key stays. Texts without
    words and rows without a doc_id are nobody's copies: they stay, each row of them.
    """
    groups, groups_path = stored(_grouped(docs, shingle, percent).filter("n_shingles > 0 and doc_id is not null"), "groups")
    rows = groups.groupBy("doc_id", "key_a", "key_b", "component", "component_id").agg(F.count("*").alias("rows"))
    # Several texts of one component under one doc_id are rare; only they need a choice.
    texts = rows.filter("doc_id = component_id").groupBy("component").agg(F.count("*").alias("texts"), F.min(F.struct("key_a", "key_b")).alias("first")).filter("texts > 1").select("component", "first")
    judged = salted(rows, "doc_id").join(spread(texts), ["component", "_salt"], "left")
    judged = judged.withColumn("kept", (F.col("doc_id") == F.col("component_id")) & (F.col("first").isNull() | (F.struct("key_a", "key_b") == F.col("first"))))
    # The rows that go, and those that stand more than once: few beside the others.
    special, _ = stored(judged.filter("not kept or rows > 1").select("doc_id", "key_a", "key_b", "kept"), "not-kept")
    dropped(docs.sparkSession, groups_path)

    names = [f"_{i}" for i in range(len(docs.columns))]
    place = docs.columns.index("text")
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))

    def keyed(batches):
        for batch in few_rows(batches):
            keys = [sequence_key(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([k[i] for k in keys], pa.int64()) for i in range(2))], [*names, "key_a", "key_b"])

    marked = docs.toDF(*names).mapInArrow(keyed, f"{schema}, key_a long, key_b long").withColumn("doc_id", F.col(names[docs.columns.index("doc_id")]).cast("long"))
    on = ["doc_id", "key_a", "key_b"]
    single = marked.join(small(special.drop("kept")), on, "left_anti").select(*names).toDF(*docs.columns)
    repeated = special.filter("kept").drop("kept")
    if repeated.isEmpty():
        return single
    again = marked.join(small(repeated), on, "left_semi").groupBy(*on).agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("_least")).select("_least.*").toDF(*docs.columns)
    return single.unionByName(again)


#: The groups of near_duplicate_groups(documents, 4, 80): every pair that shares a shingle is counted.
ORACLE = """
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
words AS (SELECT r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
runs AS (
  SELECT r, n, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o) AS g
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
shingles AS (SELECT DISTINCT r, g FROM runs WHERE i <= greatest(n - 3, 1)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
usable AS (SELECT r, g FROM shingles SEMI JOIN (SELECT r FROM texts WHERE doc_id IS NOT NULL) USING (r)),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM usable a JOIN usable b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT r AS a, r AS b FROM texts UNION SELECT reached.a, edges.b FROM reached JOIN edges ON edges.a = reached.b),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reached JOIN texts ON texts.r = reached.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id IS NULL OR component_id = doc_id AS kept
FROM texts JOIN least USING (r) LEFT JOIN sizes USING (r)
"""
