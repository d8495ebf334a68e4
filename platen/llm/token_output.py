"""Token ids as Parquet list columns.

Documents are range-partitioned by doc_id, so the files are in ascending order,
and each task writes its ids with the running offset of each document inside
its part. Row groups and pages have fixed sizes; the writer adds column and
offset indexes, so a reader that wants some documents, or their sizes only, reads those
pages and no ids. Ids use a dictionary per row group (`encoding="dictionary"`)
or DELTA_BINARY_PACKED (`encoding="delta"`, format version 2).

Defined cases: null and empty texts hold the end id alone; rows of one doc_id
stand next to each other in the order of a hash of their text; null doc_ids come
first; an empty table gives an empty file set; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platen.llm.bpe import codec, text_column

FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, encoding: str = "dictionary") -> None:
    """Write the ids of docs (doc_id, text) to Parquet files in ascending doc_id order."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding}")

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            # Ids go to the JVM in small batches: their lists take more room than the texts.
            for rows in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                ids = [np.append(x, end_id) for x in codec(tokenizer).encode(rows.column(1).to_pylist())]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.concatenate(ids).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(at + offsets[:-1]), pa.array(sizes), lists], ["doc_id", "part", "local_start", "n_tokens", "ids"])
                at += int(offsets[-1])

    ordered = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    (
        ordered.mapInArrow(run, FILE_SCHEMA)
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true" if encoding == "dictionary" else "false")
        .option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2")
        .option("parquet.column.index.enabled", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every document from the metadata columns alone."""
    return _with_start(spark.read.parquet(path).select("doc_id", "part", "local_start", "n_tokens"), spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids), all or selected; a selection is pushed down to row groups and pages."""
    rows = spark.read.parquet(path).select("doc_id", "ids")
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def _with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    # One row for each part, that is for each write task, whatever the number of documents.
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("local_start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start, n_tokens and the crc32 of its ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            sizes = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), sizes, pa.array(crcs, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path).select("doc_id", "part", "local_start", "ids")
    return _with_start(rows.mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"), spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
