"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.session import shared_folder


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written and read again: its lineage is cut, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a one-column table of ids that may be broadcast, about 16 MB.
BROADCAST_ROWS = 1_000_000


def small(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of ids, to be broadcast if a count shows that it is small; else it is joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids


#: Tasks over which the rows of one hot key are dealt in a join.
SALTS = 16


def salted(rows: DataFrame, column: str) -> DataFrame:
    """rows with a column _salt that follows from another one; to be joined with spread(few) on the key and _salt."""
    return rows.withColumn("_salt", F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int"))


def spread(few: DataFrame) -> DataFrame:
    """Each row of few, which has at most one row of a key, once for each salt."""
    return few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
