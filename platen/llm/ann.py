"""Nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

Euclidean nearness is an inner product: -|q - x|^2 / 2 = q.x - |x|^2 / 2 + const. Vectors are
centred and quantised in two-dimensional subspaces with 16 centroids each. The
quantiser minimises an anisotropic loss that weighs the part of a residual
parallel to its vector ETA times the rest, both in the codebooks (fitted on a
bounded sample of at most about SAMPLE rows) and in the codes (coordinate
descent); every row is indexed. A scan reads two four-bit codes as one byte and
adds one table entry for each; the RERANK best of a block of BLOCK rows are
measured exactly in double precision. A task keeps the k best of its blocks for
each query, so what it gives back doesn't depend on its rows. Queries are read
in chunks of at most about CHUNK rows, a fixed bound; each chunk is one scan.

Equal vectors of a block are one candidate that stands for its smallest ids, so
a common vector can't crowd others out.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do those of another length than most of the sample; repeated
rows of one id and vector count once, and of one id with several vectors the
nearest counts; a query never finds its own id; with fewer than k candidates all
are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.llm.tables import stored

SAMPLE = 10_000
CHUNK = 20_000
BLOCK = 4096
RERANK = 96
SLACK = 0.03  # of the mean squared norm: rows that score so little worse than the last of these are measured as well
CENTROIDS = 16
THRESHOLD = 0.2  # the score threshold of the loss, as a cosine


class Quantiser:
    """Codebooks (subspace, centroid, dimension) of an anisotropic product quantiser."""

    def __init__(self, sample: np.ndarray, rounds: int = 4, seed: int = 4) -> None:
        self.dim = sample.shape[1]
        self.width = self.dim + self.dim % 2
        self.spaces = self.width // 2 + (self.width // 2) % 2  # an even number of subspaces: two codes make a byte
        self.width = 2 * self.spaces
        self.centre = sample.mean(axis=0)
        self.eta = max((self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2), 1.0)
        x = self._padded(sample)
        parts = x.reshape(-1, self.spaces, 2)
        rng = np.random.default_rng(seed)
        self.books = np.empty((self.spaces, CENTROIDS, 2))
        for m in range(self.spaces):
            self.books[m] = parts[rng.choice(len(parts), CENTROIDS, replace=len(parts) < CENTROIDS), m] + rng.normal(0, 1e-9, (CENTROIDS, 2))
        codes = self._nearest(parts)
        for _ in range(8):  # plain k-means to start from
            for m in range(self.spaces):
                n = np.bincount(codes[:, m], minlength=CENTROIDS)
                for j in range(2):
                    sums = np.bincount(codes[:, m], parts[:, m, j], CENTROIDS)
                    self.books[m, :, j] = np.where(n > 0, sums / np.maximum(n, 1), self.books[m, :, j])
            codes = self._nearest(parts)
        for _ in range(rounds):
            codes = self._descend(x, codes, 1)
            self._refit(x, codes)

    def _padded(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        out[:, : self.dim] = vectors - self.centre
        return out

    def _nearest(self, parts: np.ndarray) -> np.ndarray:
        codes = np.empty(parts.shape[:2], np.int64)
        for m in range(self.spaces):
            codes[:, m] = ((parts[:, m, None, :] - self.books[m][None]) ** 2).sum(axis=2).argmin(axis=1)
        return codes

    def _direction(self, x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / np.where(norm > 0, norm, 1)).reshape(-1, self.spaces, 2)

    def _parallel(self, x: np.ndarray, u: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The parallel residual in each subspace."""
        r = x.reshape(-1, self.spaces, 2) - self.books[np.arange(self.spaces), codes]
        return (r * u).sum(axis=2)

    def _descend(self, x: np.ndarray, codes: np.ndarray, sweeps: int) -> np.ndarray:
        u = self._direction(x)
        parallel = self._parallel(x, u, codes)
        total = parallel.sum(axis=1)
        parts = x.reshape(-1, self.spaces, 2)
        rows = np.arange(len(x))
        for _ in range(sweeps):
            for m in range(self.spaces):
                r = parts[:, m, None, :] - self.books[m][None]
                along = (r * u[:, m, None, :]).sum(axis=2)
                other = total - parallel[:, m]
                best = ((r**2).sum(axis=2) + (self.eta - 1) * (other[:, None] + along) ** 2).argmin(axis=1)
                codes[:, m] = best
                parallel[:, m] = along[rows, best]
                total = other + parallel[:, m]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        u = self._direction(x)
        parts = x.reshape(-1, self.spaces, 2)
        for m in range(self.spaces):
            parallel = self._parallel(x, u, codes)
            other = parallel.sum(axis=1) - parallel[:, m]
            um = u[:, m]
            weight = np.eye(2)[None] + (self.eta - 1) * um[:, :, None] * um[:, None, :]
            right = (weight @ parts[:, m, :, None])[:, :, 0] + (self.eta - 1) * um * other[:, None]
            for k in range(CENTROIDS):
                mine = codes[:, m] == k
                if mine.sum() > 2:
                    self.books[m, k] = np.linalg.solve(weight[mine].sum(axis=0) + 1e-9 * np.eye(2), right[mine].sum(axis=0))

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Packed codes, two to a byte."""
        x = self._padded(vectors)
        codes = self._descend(x, self._nearest(x.reshape(-1, self.spaces, 2)), 2)
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of a code and each value of it, the part of the inner product."""
        single = (self.books @ self._padded(query[None])[0].reshape(self.spaces, 2, 1))[:, :, 0]
        return (single[1::2, :, None] + single[0::2, None, :]).reshape(self.spaces // 2, 256).astype(np.float32)


def scan(quantiser: Quantiser, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int, rerank: int = RERANK):
    """For each query the (id, distance) pairs of its k nearest rows of a block, reranked exactly."""
    order = np.argsort(ids, kind="stable")
    ids, vectors, codes = ids[order], vectors[order], codes[order]
    _, first, back = np.unique(vectors.view(f"V{vectors.dtype.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
    back = back.ravel()
    single = len(first) == len(ids)
    members = None if single else np.split(np.argsort(back, kind="stable"), np.cumsum(np.bincount(back))[:-1])
    half = ((vectors[first] - quantiser.centre) ** 2).sum(axis=1).astype(np.float32) / 2
    slack = SLACK * 2 * float(half.mean())
    columns = np.ascontiguousarray(codes[first].T)
    wide = vectors[first].astype(np.float64)
    for q, own in zip(queries, query_ids.tolist(), strict=True):
        tables = quantiser.tables(q)
        score = -half
        for table, column in zip(tables, columns, strict=True):
            score = score + table[column]
        # In a dense cluster codes tell little apart: all that scores about as well is measured.
        near = np.flatnonzero(score >= np.partition(score, -rerank)[-rerank] - slack) if len(score) > rerank else np.arange(len(score))
        distance = np.sqrt(((wide[near] - q) ** 2).sum(axis=1))
        if single:
            found, at = ids[first[near]], distance
        else:
            # The smallest ids of each vector: k of them and one more for the query's own.
            groups = [np.unique(ids[members[g]])[: k + 1] for g in near.tolist()]
            found, at = np.concatenate(groups), np.repeat(distance, [len(g) for g in groups])
        keep = found != own
        found, at = found[keep], at[keep]
        best = np.lexsort((found, at))[: 2 * k]
        yield found[best], at[best]


def _merge(found: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, at))
    found, at = found[order], at[order]
    _, first = np.unique(found, return_index=True)
    first = np.sort(first)[:k]
    return found[first], at[first]


def usable(vectors: DataFrame, length: int) -> DataFrame:
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) == length) & fine & F.exists(e, lambda v: v != 0))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id `every` divides, its k nearest of all rows."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    # Distances are exact on the vectors as they are: only what is no float is widened.
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    lengths = rows.filter("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None or lengths.n < 1:
        return spark.createDataFrame([], schema)
    dim = lengths.n
    rows = usable(rows, dim)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    picked = rows if total <= SAMPLE else rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(SAMPLE / total * (1 << 30)))
    # At most about SAMPLE vectors: the documented bound of the fit. Sorted, so the fit doesn't depend on tasks.
    sample = np.array(sorted(tuple(r.embedding) for r in picked.select("embedding").limit(2 * SAMPLE).collect()))
    quantiser = spark.sparkContext.broadcast(Quantiser(sample))

    def index(batches):
        for batch in batches:
            for part in (batch.slice(a, BLOCK) for a in range(0, batch.num_rows, BLOCK)):
                x = part.column(1).flatten().to_numpy().reshape(-1, dim)
                codes = quantiser.value.encode(x.astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "embedding", "codes"])

    indexed, _ = stored(rows.mapInArrow(index, f"vec_id long, embedding {kind}, codes binary"), "index")
    asked = indexed.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding").distinct()
    chunks = max(1, math.ceil(asked.count() / CHUNK))
    found = None
    for c in range(chunks):
        chunk = asked.filter(F.pmod(F.hash("vec_id"), F.lit(chunks)) == c).collect() if chunks > 1 else asked.collect()
        if not chunk:
            continue
        chunk.sort(key=lambda r: (r.vec_id, r.embedding))
        queries = spark.sparkContext.broadcast((np.array([r.vec_id for r in chunk]), np.array([r.embedding for r in chunk], np.float64)))
        part = indexed.mapInArrow(_scanner(quantiser, queries, dim, k), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scanner(quantiser, queries, dim: int, k: int):
    def run(batches):
        query_ids, asked = queries.value
        held: list = [None] * len(query_ids)

        def take(ids, x, codes):
            for i, (found, at) in enumerate(scan(quantiser.value, asked, query_ids, ids, x, codes, k)):
                if held[i] is not None:
                    found, at = np.concatenate([held[i][0], found]), np.concatenate([held[i][1], at])
                held[i] = _merge(found, at, k)

        waiting: list = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < BLOCK:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
            for at in range(0, table.num_rows, BLOCK):
                take(*_arrays(table.slice(at, BLOCK), dim))
        if waiting:
            table = pa.Table.from_batches(waiting).combine_chunks()
            for at in range(0, table.num_rows, BLOCK):
                take(*_arrays(table.slice(at, BLOCK), dim))
        full = [(q, f, a) for q, h in zip(query_ids.tolist(), held, strict=True) if h is not None for f, a in [h]]
        if full:
            ids = np.concatenate([np.full(len(f), q) for q, f, _ in full]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([f for _, f, _ in full])), pa.array(np.concatenate([a for _, _, a in full]))], ["query_id", "vec_id", "score"])

    return run


def _arrays(table: pa.Table, dim: int):
    table = table.combine_chunks()
    ids = table.column("vec_id").to_numpy()
    x = np.ascontiguousarray(table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
    return ids, x, codes
