"""Record rules: split rows into valid ones and a quarantine, or fail the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.vector import v_is_finite
from murmura.schema import CLUSTER_STATUSES


def _reasons(rules: dict[str, Column]) -> Column:
    """Names of the broken rules; a rule that evaluates to NULL is broken."""
    flags = [
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]
    return F.array_compact(F.array(*flags))


def cluster_rules() -> dict[str, Column]:
    return {
        "centroid_length": F.size("centroid") == 2,
        "size_negative": F.col("size") >= 0,
        "density_negative": F.col("density") >= 0,
        "status_unknown": F.coalesce(F.col("status"), F.lit("active")).isin(*CLUSTER_STATUSES),
        "size_below_points": F.coalesce(F.size("points"), F.lit(0)) <= F.greatest(F.col("size"), F.lit(0)),
    }


def point_rules() -> dict[str, Column]:
    return {"weight_not_positive": F.col("weight") > 0}


def summary_rules() -> dict[str, Column]:
    return {
        "noise_ratio_range": F.col("noise_ratio").between(0, 1),
        "total_clusters_negative": F.col("total_clusters") >= 0,
        "total_points_negative": F.col("total_points") >= 0,
        "avg_density_negative": F.col("avg_density") >= 0,
    }


def check_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reason``, the list of broken rules (empty = valid)."""
    return df.withColumn("reason", _reasons(rules))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = check_rows(df, rules)
    valid = checked.where(F.size("reason") == 0).drop("reason")
    return valid, checked.where(F.size("reason") > 0)


def require_valid(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows unchanged; the job fails at the first broken rule."""
    checked = check_rows(df, rules)
    # The guard sits in a filter on the rows themselves, so column pruning cannot drop it.
    passed = F.when(F.size("reason") == 0, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("invalid record: "), F.array_join("reason", ", "))).cast("boolean")
    )
    return checked.where(passed).drop("reason")


def centroid_rules() -> dict[str, Column]:
    return {"not_finite": v_is_finite(F.col("centroid")) & (F.size("centroid") > 0)}


def sane_centroids(centroids: DataFrame, strict: bool = True) -> DataFrame:
    """Centroids with bigint ids and finite coordinates; strict mode fails on others, else they are left out."""
    if strict:
        typed = centroids.withColumn("cluster_id", F.col("cluster_id").cast("bigint"))
        guard = F.when(v_is_finite(F.col("centroid")), F.lit(True)).otherwise(
            F.raise_error(F.concat(
                F.lit("Centroid for cluster "), F.col("cluster_id").cast("string"),
                F.lit(" contains NaN/inf"),
            )).cast("boolean")
        )
        return typed.where(guard)
    typed = centroids.withColumn("cluster_id", F.col("cluster_id").try_cast("bigint"))
    return split_valid(typed.where("cluster_id IS NOT NULL"), centroid_rules())[0]


def require_model_name(model_name: str) -> None:
    if not model_name:
        raise ValueError("a model needs a model_name that is not empty")


def feature_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: rows, smallest and largest vector length, rows without a label, verdict."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min(F.size("features")).cast("bigint").alias("min_dims"),
        F.max(F.size("features")).cast("bigint").alias("max_dims"),
        F.count_if(F.col("label").isNull()).alias("unlabelled"),
    ).withColumn("ok", (F.col("min_dims") == F.col("max_dims")) & (F.col("unlabelled") == 0))
