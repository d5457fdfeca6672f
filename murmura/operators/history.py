"""Bounded histories, latest records, trajectories and timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


ID_SLICES = 64


def last_n(df: DataFrame, n: int, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The ``n`` last rows of each key by ``order_by`` (unique within the key).

    Ranked first inside random slices of the key, so no task sorts a whole hot key and at
    most ``n`` rows per slice reach the final ranking.
    """
    if n <= 0:
        raise ValueError(f"cannot keep the last {n} rows, ask for one or more")
    newest = [F.col(c).desc() for c in order_by]
    slices = 64
    slot = F.pmod(F.xxhash64(*order_by), F.lit(slices))
    local = Window.partitionBy(*keys, "__slot").orderBy(*newest)
    final = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*newest)
    return (
        df.withColumn("__slot", slot)
        .withColumn("__rn", F.row_number().over(local)).where(F.col("__rn") <= n)
        .withColumn("__rn", F.row_number().over(final)).where(F.col("__rn") <= n)
        .drop("__slot", "__rn")
    )


def recent_logs(logs: DataFrame, limit: int = 200, order_by: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Newest first; a limit below 1 gives nothing."""
    return logs.orderBy(*[F.col(c).desc() for c in order_by]).limit(max(0, limit))


def latest_per(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last record of each key as whole row; one partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order_by)).alias("__last")
    ).select(*keys, "__last.*")


def last_centroids(snapshots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Where each cluster was last seen."""
    return snapshots.groupBy(*keys, "cluster_id").agg(
        F.max_by("centroid", "step").alias("centroid"), F.max("step").alias("step")
    )


def trajectories(snapshots: DataFrame, keys: Sequence[str] = (), steps: DataFrame | None = None) -> DataFrame:
    """Every (step, cluster) cell from a cluster's stream, NULL centroid where it is missing.

    The grid is the output: steps times ids of the same stream.
    """
    keys = list(keys)
    present = snapshots.select(*keys, "step").distinct() if steps is None else steps.select(*keys, "step")
    ids = snapshots.select(*keys, "cluster_id").distinct()
    # Ids are dealt to slices and every step visits each of them, so a stream with most ids or steps is spread out.
    sliced = ids.withColumn("__slice", F.pmod(F.xxhash64("cluster_id"), F.lit(ID_SLICES)).cast("int"))
    visits = present.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(ID_SLICES - 1))))
    cells = visits.join(sliced, [*keys, "__slice"]).select(*keys, "step", "cluster_id")
    return cells.join(snapshots.select(*keys, "step", "cluster_id", "centroid"), [*keys, "step", "cluster_id"], "left")


def timeline(logs: DataFrame, series: str, index: str = "idx") -> DataFrame:
    """(x, value) of one log metric: x is the timestamp, else the batch id, else the row index."""

    def filled(column: str) -> Column:
        # empty text and zero ids count as missing
        value = F.col(column).cast("string")
        return F.when((value != "") & (value != "0"), value)

    return logs.where(F.col(series).isNotNull()).select(
        F.coalesce(filled("timestamp"), filled("batch_id"), F.col(index).cast("string")).alias("x"),
        F.col(series).alias("value"),
    )


def centroid_fallback(model: DataFrame, computed: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """The model's centroids for the groups it has any, those computed from points for the rest."""
    covered = model.select(*keys).distinct()
    spare = computed.join(covered, list(keys), "left_anti")
    return model.withColumn("origin", F.lit("model")).unionByName(spare.withColumn("origin", F.lit("points")))


def id_changes(snapshots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sorted id sets of a step and what changed against the step before."""
    sets = snapshots.groupBy(*keys, "step").agg(F.array_sort(F.collect_set("cluster_id")).alias("ids"))
    before = sets.select(*keys, (F.col("step") + 1).alias("step"), F.col("ids").alias("prev"))
    none = F.array().cast("array<bigint>")
    prev = F.coalesce("prev", none)
    return sets.join(before, [*keys, "step"], "left").select(
        *keys, "step", "ids",
        F.array_except("ids", prev).alias("appeared"),
        F.array_except(prev, F.col("ids")).alias("disappeared"),
        F.array_intersect("ids", prev).alias("stable"),
    )


def model_compare(metrics: DataFrame, models: Sequence[str], drift: DataFrame | None = None) -> DataFrame:
    """One row per batch with the metrics of each model side by side, and the drift if given."""
    wide = metrics.groupBy("batch_id").agg(*[
        F.max(F.when(F.col("model_name") == m, F.col(c))).alias(f"{m}_{c}")
        for m in models
        for c in ("n_samples", "number_of_clusters", "noise_ratio", "silhouette_score")
    ])
    if drift is None:
        return wide
    return wide.join(drift.select("batch_id", F.col("mean_drift_distance").alias("drift_magnitude")), "batch_id", "left")
