"""Helpers shared by the operators: staged tables, hot-key joins, word patterns.

Conventions every operator follows:

* Operators select the columns they name; extra columns never take part, and
  internal columns carry the prefix ``__llm_`` so that they cannot clash.
* A null text is an empty text.  A null id sorts after every other id.
* Rows that repeat an id are rows of their own; ties are broken by a row number
  that is fixed when the compact row facts are staged.
* Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` (the
  folder that driver and executors share), one sub-folder per application.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.session import checkpoint_dir

#: ASCII white space of the word definition, as characters and as a class.
WHITE_CHARS = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: A key is hot when it holds at least this share of the rows: at most 1000 keys can be.
HOT_PARTS = 1000


def stage_folder(spark: SparkSession) -> str:
    """This application's folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the scan
    of it: a lost executor costs a re-read, never a recomputation."""
    path = f"{stage_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete everything this application staged (call when its results are written)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of the application, once (what
    ``--py-files`` does), for operators whose tasks run Python."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", None) != context.applicationId:
        package = Path(__file__).resolve().parents[1]
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(made)
        context._llm_shipped = context.applicationId


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs (an empty text has none)."""
    return F.size(F.array_remove(F.split(text, WHITE_CLASS + "+"), ""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with one ``groups`` row per ``key``; ``n`` is the number
    of rows a group has, ``total`` that of all rows.

    Groups that hold at least 1/``HOT_PARTS`` of the rows are broadcast: by
    arithmetic there are at most ``HOT_PARTS`` of them.  The rest go through an
    ordinary equi-join in which no key holds more than that share.
    """
    hot = groups.where(F.col(n) * F.lit(HOT_PARTS) >= F.lit(total))
    cold = groups.where(F.col(n) * F.lit(HOT_PARTS) < F.lit(total))
    on_hot = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return on_hot.unionByName(rest.join(cold, key))


def prefix_sums(rows: DataFrame, group: str | None, order: list[str], value: str) -> DataFrame:
    """Adds ``__llm_before``: the sum of ``value`` over the rows of the same
    ``group`` (of all rows where it is None) that come earlier in ``order``.

    Rows are range-partitioned by (group, order) and frozen in a staged table;
    sums are taken inside each range and the totals of earlier ranges added.  No
    task sees more than its range, however large a group is."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("__llm_g", F.col(group) if group else F.lit(0))
    ranged = stage(keyed.repartitionByRange(parts, "__llm_g", *order).withColumn("__llm_part", F.spark_partition_id()),
                   "ranged")
    inside = Window.partitionBy("__llm_part", "__llm_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("__llm_h").orderBy("__llm_p").rowsBetween(Window.unboundedPreceding, -1)
    # at most (ranges + groups) rows, as the ranges are contiguous
    totals = (ranged.groupBy(F.col("__llm_g").alias("__llm_h"), F.col("__llm_part").alias("__llm_p"))
              .agg(F.sum(value).alias("__llm_total"))
              .select("__llm_h", "__llm_p", F.coalesce(F.sum("__llm_total").over(earlier), F.lit(0)).alias("__llm_offset")))
    counted = ranged.withColumn("__llm_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = counted.join(totals, F.col("__llm_g").eqNullSafe(F.col("__llm_h"))
                          & (F.col("__llm_part") == F.col("__llm_p")))
    return joined.withColumn("__llm_before", (F.col("__llm_inside") + F.col("__llm_offset")).cast("long")).drop(
        "__llm_inside", "__llm_offset", "__llm_g", "__llm_h", "__llm_p", "__llm_part")
