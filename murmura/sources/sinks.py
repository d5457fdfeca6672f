"""Append-only result tables: metrics, batch statistics, batch metadata.

A batch is written to a folder of its own (model, batch), so writing it again replaces it and
a retried job leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.operators.clusters import average_density
from murmura.operators.history import latest_per


def append_batches(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Write rows under ``partitions``; partitions that are already there are replaced."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions).parquet(path)
    )


def append_metrics(metrics: DataFrame, path: str) -> None:
    append_batches(metrics, path, ["model_name", "batch_id"])


def read_metrics(spark: SparkSession, path: str, model_name: str | None = None) -> DataFrame:
    """Stored metrics; one model is a partition filter."""
    stored = spark.read.parquet(path)
    return stored if model_name is None else stored.where(F.col("model_name") == model_name)


def latest_metrics(metrics: DataFrame, model_name: str | None = None, time: str = "ts") -> DataFrame:
    """Last record of one model, or of each model."""
    chosen = metrics if model_name is None else metrics.where(F.col("model_name") == model_name)
    return latest_per(chosen, ["model_name"], [time, "batch_id"])


def batch_statistics(metrics: DataFrame, clusters: DataFrame | None = None, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """The statistics record of every batch.

    With ``clusters`` (rows per batch with status and density) the active clusters are counted
    and their mean density is reported; without, the metrics' cluster count stands in and the
    density is NULL.
    """
    keys = list(keys)
    base = metrics.select(
        F.lit("clustering_batch").alias("event"), "model_name", *keys, "n_samples", "noise_ratio",
        "number_of_clusters", *(["ts"] if "ts" in metrics.columns else []),
    )
    if clusters is None:
        return base.withColumnRenamed("number_of_clusters", "active_clusters").withColumn(
            "avg_density", F.lit(None).cast("double")
        )
    active = clusters.where(F.col("status") == "active")
    per_batch = active.groupBy(*keys).agg(F.count(F.lit(1)).alias("active_clusters")).join(
        average_density(active, keys), keys
    )
    return base.drop("number_of_clusters").join(per_batch, keys, "left").withColumn(
        "active_clusters", F.coalesce("active_clusters", F.lit(0))
    )


def batch_metadata(points: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    return points.groupBy(*keys).agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n_samples"))
