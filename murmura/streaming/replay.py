"""Replaying a finite ordered table as a stream of count-sized micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_replay(batches: DataFrame, path: str, per_file: int = 1) -> int:
    """Write a file for every ``per_file`` batches, numbered from 1, and date the files in batch order; returns their number.

    A file stream takes files by date, so the dates are the order of the replay. One job writes
    all files; only their dates are set one by one. A stream lists and remembers all its files, so batches that a trigger
    takes together go into one.
    """
    number = F.floor((F.col("batch_id") - 1) / F.lit(per_file)).cast("bigint") + 1 if per_file > 1 else F.col("batch_id")
    batches.withColumn("__b", number).repartition("__b").write.partitionBy("__b").parquet(path)
    spark = batches.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("__b=")]
    start = fs.getFileStatus(root).getModificationTime() - 1000 * (len(folders) + 1)
    for folder in folders:
        number = int(folder.getName()[len("__b="):])
        for status in fs.listStatus(folder):
            fs.setTimes(status.getPath(), start + 1000 * number, -1)
    return len(folders)


def read_replay(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 1) -> DataFrame:
    """Stream of the batches in order, ``per_trigger`` files of them in a micro-batch.

    The stream ends after the last batch when started with the ``availableNow`` trigger; a new
    checkpoint starts it from the first batch again.
    """
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
        .option("recursiveFileLookup", True).parquet(path)
    )
