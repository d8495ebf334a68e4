"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platen.llm import ann


def brute(rows, k=10, every=100):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in usable])
    x = np.array([v for _, v in usable])
    out = {}
    for i, v in usable:
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            best = {}
            for j, s in zip(ids.tolist(), d.tolist(), strict=True):
                if j != i:
                    best[j] = min(s, best.get(j, np.inf))
            out[i] = sorted((s, j) for j, s in best.items())[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def recall(got, want):
    hits = sum(len({j for _, j in got.get(q, [])} & {j for _, j in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    got = found(ann.nearest(table))
    assert recall(got, want) >= 0.95
    assert all(abs(s - dict((j, t) for t, j in want[q])[i]) < 1e-12 for q in want for s, i in got[q] if i in dict((j, t) for t, j in want[q]))


def test_recall_over_blocks_and_a_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 512)
    monkeypatch.setattr(ann, "RERANK", 24)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x[:1000] = x[0] + rng.normal(scale=0.01, size=(1000, 16))
    x[1000:1400] = x[1000]  # equal vectors
    order = rng.permutation(3000)
    rows = [(int(i), [float(v) for v in np.float32(x[i])]) for i in order]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = found(ann.nearest(table)), brute(rows)
    assert recall(got, want) >= 0.95
    assert [j for _, j in got[1200]] == [j for _, j in want[1200]] == [*range(1000, 1010)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, nan, 0.0]), (5, [inf, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (8, [0.0, 1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (100, [0.0, 2.0, 0.0]), (200, [0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = found(ann.nearest(table))
    assert set(got) == {0, 100}
    assert [j for _, j in got[0]] == [1, 9, 8, 100] and got[0][0][0] == 0.0 and got[0][2][0] == pytest.approx(2**0.5)
    for empty in (table.filter(F.lit(False)), table.filter("vec_id = 2"), table.filter("vec_id = 3")):
        assert ann.nearest(empty).count() == 0
    assert found(ann.nearest(table.filter("vec_id = 0"))) == {}


def test_parallel_residuals_weigh_more():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    q = ann.Quantiser(x)
    padded = q._padded(x)
    plain = q._nearest(padded.reshape(-1, q.spaces, 2))
    u = q._direction(padded)
    along = lambda codes: float((q._parallel(padded, u, codes).sum(axis=1) ** 2).mean())
    assert along(q._descend(padded, plain.copy(), 2)) < 0.5 * along(plain)
    codes = q.encode(x[:50])
    exact = np.array([[(q.books[m, c] @ q._padded(x[:1])[0].reshape(-1, 2)[m]) for m, c in enumerate(np.stack([row & 15, row >> 4], axis=1).ravel())] for row in codes]).sum(axis=1)
    scanned = np.array([sum(t[b] for t, b in zip(q.tables(x[0]), row, strict=True)) for row in codes])
    assert np.allclose(exact, scanned, atol=1e-4)


def test_doubles_are_measured_as_they_are(spark):
    """Vectors that differ beyond a float's digits or range."""
    rows = [(100 * i, [1.0 + i * 1e-12, 2.0, 1e60 if i > 5 else 0.0]) for i in range(8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(ann.nearest(table)), brute(rows)
    assert {q: [j for _, j in w] for q, w in got.items()} == {q: [j for _, j in w] for q, w in want.items()}
    assert got[0][0] == (want[0][0][0], 100) and 0 < got[0][0][0] < 2e-12
