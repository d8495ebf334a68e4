"""Files that arrive in a folder, as a stream of extracted pages (an extension: a batch engine's tables, kept up to date)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from platen.plans.document import extract


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, pattern: str = "*.pdf") -> StreamingQuery:
    """Append text elements and errors of new files below `path` to tables below `out`, then stop when none is left."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path).selectExpr("path as file_id", "length", "content")

    def batch(rows, number: int) -> None:
        found = extract(rows)
        found.text_elements.write.mode("overwrite").parquet(f"{out}/text_elements/batch={number}")
        found.errors.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
