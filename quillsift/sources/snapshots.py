"""Parquet snapshots of keyed tables, and tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, path: str) -> DataFrame:
    """Reads a snapshot; nothing but footers is read until a query asks for columns."""
    return spark.read.parquet(path)


def create(df: DataFrame, path: str) -> DataFrame:
    """Writes a new snapshot; fails if there is one."""
    df.write.mode("errorifexists").parquet(path)
    return load(df.sparkSession, path)


def optimize(df: DataFrame, path: str, key: str = "key", files: int | None = None) -> DataFrame:
    """Rewrites a table in key order, so that row groups are pruned by their statistics."""
    dealt = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.mode("errorifexists").parquet(path)
    return load(df.sparkSession, path)


def append(df: DataFrame, other: DataFrame) -> DataFrame:
    """Both tables' rows, without copying either."""
    return df.unionByName(other)


#: Of applications on one machine that set no shared folder: their own.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's tables, within the one that driver and executors share (``spark.checkpoint.dir``).

    Where none is set, an application on one machine has a temporary folder, which goes when the driver ends; on a cluster
    it is an error, as executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    application = spark.sparkContext.applicationId
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="quillsift-")
            atexit.register(shutil.rmtree, _LOCAL[application], ignore_errors=True)
        folder = f"file://{_LOCAL[application]}"
    return f"{folder.rstrip('/')}/quillsift/{application}"


#: Has Spark delete a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again.

    This cuts the lineage, computes the rows once however often they are read, and outlives lost executors. The shuffle
    files that the rows came through go once the table is there.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._quillsift_path = path
    return table


def _delete(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that no later result reads."""
    for table in tables:
        _delete(table.sparkSession, table._quillsift_path.rsplit("/", 1)[0])


def clean(spark: SparkSession) -> bool:
    """Deletes this application's tables in the shared folder; results that were not written yet can't be read then."""
    return _delete(spark, shared_folder(spark))


def ranged(df: DataFrame, key: str, name: str = "ranged") -> DataFrame:
    """The table dealt into ranges of ``key``, numbered in order in ``__range``; the numbers are fixed by writing it."""
    return materialize(df.repartitionByRange(key).withColumn("__range", F.spark_partition_id()), name)
