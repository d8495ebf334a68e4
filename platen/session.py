"""Session helpers shared by every part of the package."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed (local mode, shared homes)."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (PACKAGE_ROOT, known) if p)
    return spark


def as_plan(function):
    """A function for mapInArrow without annotations, which Spark would read."""
    return lambda batches: function(batches)


def local_session(cpus: int | str = "*", app: str = "platen", shuffle: int = 8) -> SparkSession:
    """A session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return attach(spark)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where the cluster names none, the context's checkpoint folder takes its place, and on a
    single machine (local mode) the warehouse. Elsewhere a missing folder is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base and context._jsc.sc().getCheckpointDir().isDefined():
        base = context._jsc.sc().getCheckpointDir().get()
    if not base and context.master.startswith("local"):
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/platen-{name}-{uuid.uuid4().hex}"


def written(df, name: str):
    """df, written to the shared folder and read again: computed once, its lineage cut."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
