"""Per-batch quality: counts, noise, sizes, centroids, purity and the metrics record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.ordering import ordered_index
from murmura.operators.silhouette import silhouette
from murmura.operators.validate import require_model_name
from murmura.schema import NOISE


def clustered_label() -> Column:
    """The label, NULL for noise."""
    return F.when(F.col("label") != NOISE, F.col("label"))


def _label_counts(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points per (keys, label): the one wide aggregate that counts and sizes build on.

    Counting distinct labels over these few rows needs no shuffle of the points by label,
    and a batch that holds most rows is already folded on the map side.
    """
    return points.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("cnt"))


def cluster_count(points: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    return _label_counts(points, keys).groupBy(*keys).agg(
        F.count(clustered_label()).alias("number_of_clusters")
    )


def noise_ratio(points: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    return points.groupBy(*keys).agg(_noise_share().alias("noise_ratio"))


def _noise_share() -> Column:
    return F.coalesce(F.avg((F.col("label") == NOISE).cast("double")), F.lit(0.0))


def cluster_sizes(points: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Smallest, mean and largest cluster of each group; NULL where all is noise."""
    size = F.when(F.col("label") != NOISE, F.col("cnt"))
    return _label_counts(points, keys).groupBy(*keys).agg(
        F.min(size).cast("double").alias("min_size"),
        F.avg(size).alias("mean_size"),
        F.max(size).cast("double").alias("max_size"),
    )


def centroids(points: DataFrame, keys: Sequence[str] = ("batch_id",), dims: int | None = None) -> DataFrame:
    """(keys, label, centroid, n) without noise.

    With a known ``dims`` the coordinates are averaged side by side in one aggregate; else
    they are laid out as rows first.
    """
    kept = points.where(F.col("label") != NOISE)
    if dims is not None:
        means = [F.avg(F.get("features", F.lit(i))) for i in range(dims)]
        return kept.groupBy(*keys, "label").agg(
            F.array(*means).alias("centroid"), F.count(F.lit(1)).alias("n")
        )
    return (
        kept.select(*keys, "label", F.posexplode("features").alias("dim", "v"))
        .groupBy(*keys, "label", "dim")
        .agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
        .groupBy(*keys, "label")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]
            ).alias("centroid"),
            F.max("n").alias("n"),
        )
    )


def batch_metrics(
    points: DataFrame,
    model_name: str,
    keys: Sequence[str] = ("batch_id",),
    batches: DataFrame | None = None,
    group_bound: int | None = None,
    noise: str = "exclude",
) -> DataFrame:
    """One metrics record per batch: samples, clusters, noise share, silhouette, latest ``ts`` of points that have one.

    ``batches`` lists batches that must appear even without points.
    """
    require_model_name(model_name)
    keys = list(keys)
    has_ts = "ts" in points.columns
    latest = [F.max("ts").alias("ts")] if has_ts else []
    per_label = points.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("cnt"), *latest)
    noisy = F.sum(F.when(F.col("label") == NOISE, F.col("cnt")).otherwise(0))
    counts = per_label.groupBy(*keys).agg(
        F.sum("cnt").alias("n_samples"),
        F.count(clustered_label()).alias("number_of_clusters"),
        (noisy / F.sum("cnt")).alias("noise_ratio"),
        *latest,
    )
    scores = silhouette(points, keys, noise=noise, group_bound=group_bound)
    record = counts.join(scores, keys, "left")
    if batches is not None:
        record = batches.select(*keys).distinct().join(record, keys, "left")
    return record.select(
        *keys,
        F.lit(model_name).alias("model_name"),
        F.coalesce("n_samples", F.lit(0)).cast("bigint").alias("n_samples"),
        F.coalesce("number_of_clusters", F.lit(0)).cast("bigint").alias("number_of_clusters"),
        F.coalesce("noise_ratio", F.lit(0.0)).alias("noise_ratio"),
        "silhouette_score",
        *(["ts"] if has_ts else []),
    )


def unique_batch_id(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch id of each group when all its non-null ids agree, else NULL."""
    low, high = F.min("batch_id"), F.max("batch_id")
    return points.groupBy(*keys).agg(F.when(low == high, low).alias("batch_id"))


def purity(points: DataFrame, keys: Sequence[str] = ("batch_id",), truth: str = "truth") -> DataFrame:
    """Share of clustered points that carry the most frequent true label of their cluster."""
    pairs = points.where(F.col("label") != NOISE).groupBy(*keys, "label", truth).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    best = pairs.groupBy(*keys, "label").agg(F.max("cnt").alias("best"), F.sum("cnt").alias("n"))
    return best.groupBy(*keys).agg((F.sum("best") / F.sum("n")).alias("purity"))


def points_by_label(points: DataFrame, keys: Sequence[str] = ("batch_id",), part_rows: int = 4096) -> DataFrame:
    """Points of each label as arrays ordered by pt_id (unique in the group), noise under its own label.

    A label of a group is laid out in parts of ``part_rows`` points, numbered from 0 in the order of
    pt_id, so that no array grows with the cluster and the parts read one after the other are the whole.
    """
    keys = list(keys)
    if part_rows <= 0:
        raise ValueError(f"a part needs at least one row, got {part_rows}")
    numbered = ordered_index(points, ["pt_id"], [*keys, "label"], "__rn")
    return (
        numbered.withColumn("part", F.floor((F.col("__rn") - 1) / F.lit(part_rows)).cast("bigint"))
        .groupBy(*keys, "label", "part")
        .agg(F.sort_array(F.collect_list(F.struct("pt_id", "features"))).alias("points"))
    )


def count_stability(counts: DataFrame, keys: Sequence[str] = (), warmup: int = 3) -> DataFrame:
    """Per key: median of the cluster counts after the warm-up and the largest deviation from it."""
    keys = list(keys)
    steady = counts.where(F.col("batch_id") > warmup)
    # Counts are small integers, so the median is taken over their histogram.
    hist = steady.groupBy(*keys, "number_of_clusters").agg(F.count(F.lit(1)).alias("freq"))
    return hist.groupBy(*keys).agg(
        F.percentile("number_of_clusters", 0.5, F.col("freq")).alias("median_count"),
        F.min("number_of_clusters").alias("lowest"),
        F.max("number_of_clusters").alias("highest"),
        (F.sum(F.col("number_of_clusters") * F.col("freq")) / F.sum("freq")).alias("mean_count"),
    ).withColumn(
        "max_deviation",
        F.greatest(F.col("highest") - F.col("median_count"), F.col("median_count") - F.col("lowest")),
    ).drop("lowest", "highest")
