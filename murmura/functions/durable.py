"""Cutting lineage through reliable storage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the checkpoint folder set.

    Where neither is set, as in a plain local session, a folder beside the warehouse is used,
    which a cluster shares as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table written once.

    A lost executor costs reading a file again, not the rounds before; the optimizer sees the
    true size, so it broadcasts only what is small.
    """
    spark = df.sparkSession
    path = new_path(spark, "table")
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._murmura_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "_murmura_path", None)
        if path is not None:
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def folder_names(spark: SparkSession, path: str, finished: bool = False) -> list[str]:
    """Names below a folder, none where it is missing; ``finished`` asks for tables written to their end."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [status.getPath() for status in files.listStatus(folder)]
    return [p.getName() for p in found if not finished or files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
