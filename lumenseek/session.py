"""Session helpers: defaults for new sessions and scale-sensitive choices."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Confs that matter on a cluster and are harmless on a laptop.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Chunk text makes rows wide; a smaller Arrow batch bounds worker memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.python.worker.reuse": "true",
    # Recording the call site of every Column expression dominates the time it
    # takes to build the larger plans here.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "lumenseek", master: str | None = None,
                  **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset, a local session uses a temporary
    folder of its machine; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lumenseek-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work at least one partition per core.

    A big table already arrives in many splits and is returned unchanged, so
    no shuffle is added at scale; a single small file is spread out. Meant for
    scans: asking a plan with shuffles for its partitions would run them.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def deal(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out evenly, for row work that costs far more than a shuffle of its rows.

    A Parquet file is read in as many splits as its size asks for, but a row
    group goes to one of them whole, so a scan may have a partition per core
    and all its rows in one. The number of partitions cannot tell; ``spread``
    leaves such a scan as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores if splits < cores else max(splits, 4 * cores))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_lumenseek_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="lumenseek-"), "lumenseek.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._lumenseek_shipped = True


def cached_steps(build):
    """Remember the Columns a builder makes, per driver JVM and arguments.

    Columns only name their inputs, so one set serves every DataFrame with
    those columns. Building the larger ones takes about a second of driver
    time, which a stream would otherwise spend on every batch.
    """
    known: dict = {}

    @functools.wraps(build)
    def lookup(*args):
        gateway = SparkContext._gateway
        if known.get("gateway") is not gateway:
            known.clear()
            known["gateway"] = gateway
        if args not in known:
            known[args] = build(*args)
        return known[args]

    return lookup


def apply_steps(df: DataFrame, steps) -> DataFrame:
    for name, column in steps:
        df = df.withColumn(name, column)
    return df
