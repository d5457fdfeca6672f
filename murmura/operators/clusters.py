"""Cluster rows: summaries, densities, names, splitting by status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_summary(
    clusters: DataFrame, keys: Sequence[str] = (), noise: DataFrame | None = None
) -> DataFrame:
    """Clusters, points, mean density and noise share per group.

    ``noise`` gives ``noise_points`` per group, counted as 0 where missing.
    """
    keys = list(keys)
    totals = clusters.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_points"),
        F.coalesce(F.avg("density"), F.lit(0.0)).alias("avg_density"),
    )
    if noise is None:
        totals = totals.withColumn("noise_points", F.lit(0))
    elif keys:
        totals = totals.join(noise, keys, "full")
    else:
        # both sides are one row
        totals = totals.withColumn("__one", F.lit(1)).join(
            noise.agg(F.sum("noise_points").alias("noise_points")).withColumn("__one", F.lit(1)), "__one"
        ).drop("__one")
    lost = F.coalesce("noise_points", F.lit(0))
    points = F.coalesce("total_points", F.lit(0))
    return totals.select(
        *keys,
        F.coalesce("total_clusters", F.lit(0)).alias("total_clusters"),
        points.alias("total_points"),
        F.coalesce("avg_density", F.lit(0.0)).alias("avg_density"),
        F.coalesce(F.try_divide(lost.cast("double"), (points + lost).cast("double")), F.lit(0.0)).alias("noise_ratio"),
    )


def average_density(clusters: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean density of the active clusters, NULL without any."""
    return clusters.groupBy(*keys).agg(
        F.avg(F.when(F.col("status") == "active", F.col("density"))).alias("avg_density")
    )


def with_status(clusters: DataFrame, status: str) -> DataFrame:
    return clusters.where(F.col("status") == status)
