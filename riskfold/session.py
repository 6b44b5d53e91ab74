"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that are safe on a laptop and on a large cluster: AQE re-plans
# joins and shuffle sizes from runtime statistics, splits skewed join
# partitions, and coalesces tiny post-shuffle partitions.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "riskfold", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one.

    On a cluster the session already exists (spark-submit) and its settings
    win; only unset keys receive the defaults above.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``; it is read from the
    session.  A local session without one gets a private folder; on any other
    master a missing setting is an error, as a folder of the driver's machine
    would not be seen by the executors.
    """
    context = spark.sparkContext
    path = (context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
            or context.getCheckpointDir())
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="riskfold-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    context.setCheckpointDir(path)
    return path


def cut_lineage(df, compression: str = "snappy"):
    """The rows of ``df`` written once as a Parquet table in the shared checkpoint
    folder, and the scan of it: a lost executor costs a re-read, as with a
    checkpoint, but wide tables are stored by column and compressed, and a plan
    reads the columns it needs."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by_key(df, key: str):
    """As :func:`cut_lineage`, with the rows dealt into as many buckets as a shuffle has
    partitions, so that later joins on ``key`` scan this side and never move it.  The
    catalog entry lives as long as the session; the files lie in the shared folder."""
    spark = df.sparkSession
    name = f"riskfold_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{spark.sparkContext.applicationId}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of the application, once (what
    ``--py-files`` does), for operators whose tasks run Python."""
    context = spark.sparkContext
    if getattr(context, "_riskfold_shipped", None) != context.applicationId:
        package = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))
        context._riskfold_shipped = context.applicationId
