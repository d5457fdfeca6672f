"""Mean silhouette per group, exact Euclidean.

For every point the mean distance to its own cluster and to each other cluster is needed.
Small clusters are packed whole into target blocks, so their means are finished inside the
task and only the smallest leaves it; a cluster bigger than a block is split, and only its
per-part sums travel. Rows shuffled per point: one per target block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.operators.blocks import BLOCK_ROWS, dealt, hashed_block
from murmura.operators.kernels import matrix, pairwise
from murmura.schema import NOISE

NOISE_MODES = ("exclude", "as_cluster")


def silhouette(
    points: DataFrame,
    keys: Sequence[str] = ("batch_id",),
    noise: str = "exclude",
    group_bound: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(keys, silhouette_score); NULL below two clusters or when no cluster has two points.

    ``points`` has keys, pt_id, label, features. ``group_bound`` is a known limit on the
    points of one group.
    """
    scores = silhouette_samples(points, keys, noise, group_bound, block_rows)
    return mean_silhouette(scores, keys)


def mean_score() -> Column:
    """Aggregate over the samples of a group."""
    clustered = F.when(F.col("label") != NOISE, F.col("label"))
    usable = (F.min(clustered) < F.max(clustered)) & (F.max("own_cnt") > 1)
    return F.when(usable, F.avg("silhouette")).alias("silhouette_score")


def mean_silhouette(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(mean_score())


def silhouette_samples(
    points: DataFrame,
    keys: Sequence[str] = ("batch_id",),
    noise: str = "exclude",
    group_bound: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(keys, pt_id, label, own_cnt, silhouette) for every scored point."""
    if noise not in NOISE_MODES:
        raise ValueError(f"noise must be one of {NOISE_MODES}, got {noise}")
    keys = list(keys)
    scored = points.select(*keys, "pt_id", "label", "features")
    if noise == "exclude":
        scored = scored.where(F.col("label") != NOISE)

    types = {f.name: f.dataType for f in scored.schema.fields}
    out = T.StructType([
        *[T.StructField(k, types[k]) for k in keys],
        T.StructField("pt_id", types["pt_id"]),
        T.StructField("label", types["label"]),
        T.StructField("own_sum", T.DoubleType()),
        T.StructField("own_cnt", T.LongType()),
        T.StructField("near", T.DoubleType()),
        T.StructField("split_label", types["label"]),
        T.StructField("split_sum", T.DoubleType()),
        T.StructField("split_cnt", T.LongType()),
    ])
    names = [f.name for f in out.fields]

    if group_bound is not None and group_bound <= block_rows:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return _distance_sums(pdf, pdf, False, keys, names)

        merged = dealt(scored, keys).groupBy(*keys).applyInPandas(whole, out)
    else:

        def part(pdf: pd.DataFrame) -> pd.DataFrame:
            asked, targets = pdf[~pdf["is_target"]], pdf[pdf["is_target"]]
            if asked.empty or targets.empty:
                return pd.DataFrame(columns=names)
            return _distance_sums(asked, targets, bool(pdf["split"].iloc[0]), keys, names)

        spread = _spread(scored, keys, block_rows)
        sums = dealt(spread, [*keys, "block", "target"]).groupBy(*keys, "block", "target").applyInPandas(part, out)
        merged = _merge(sums, keys)

    own = F.col("own_sum") / (F.col("own_cnt") - 1)
    top = F.greatest(own, F.col("near"))
    score = F.when((F.col("own_cnt") > 1) & (top > 0), (F.col("near") - own) / top).otherwise(0.0)
    return merged.select(
        *keys, "pt_id", "label", "own_cnt",
        F.when(F.col("near").isNotNull(), score).alias("silhouette"),
    )


def _spread(scored: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    sizes = scored.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("size"))
    totals = sizes.groupBy(*keys).agg(
        F.ceil(F.sum("size") / F.lit(block_rows)).cast("bigint").alias("blocks")
    )
    plan = sizes.join(totals, keys).select(
        *keys, "label", "blocks",
        (F.col("size") > block_rows).alias("split"),
        F.ceil(F.col("size") / F.lit(block_rows)).cast("bigint").alias("parts"),
    )
    packed = F.concat(F.lit("p"), hashed_block("label", "blocks").cast("string"))
    pieces = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1),
        lambda i: F.concat_ws("/", F.lit("s"), F.col("label").cast("string"), i.cast("string")),
    )
    target_list = plan.select(
        *keys, "split", F.explode(F.when(F.col("split"), pieces).otherwise(F.array(packed))).alias("target")
    ).distinct()

    sized = scored.join(plan, [*keys, "label"])
    asked = (
        sized.withColumn("block", hashed_block("pt_id", "blocks"))
        .drop("split", "parts", "blocks")
        .join(target_list, keys)
        .withColumn("is_target", F.lit(False))
    )
    home = F.when(
        F.col("split"),
        F.concat_ws("/", F.lit("s"), F.col("label").cast("string"),
                    F.pmod(F.xxhash64("pt_id"), F.col("parts")).cast("string")),
    ).otherwise(packed)
    targets = (
        sized.withColumn("target", home)
        .withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        .drop("parts", "blocks")
        .withColumn("is_target", F.lit(True))
    )
    return asked.unionByName(targets)


def _distance_sums(asked, targets, split: bool, keys: list[str], names: list[str]) -> pd.DataFrame:
    targets = targets.sort_values(["label", "pt_id"], kind="stable")
    labels = targets["label"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    counts = np.diff(np.r_[cuts, len(labels)])
    sums = np.add.reduceat(pairwise(matrix(asked["features"]), matrix(targets["features"])), cuts, axis=1)

    mine = asked["label"].to_numpy()
    spot = np.searchsorted(labels[cuts], mine).clip(0, len(cuts) - 1)
    here = labels[cuts][spot] == mine
    row = np.arange(len(mine))
    out = asked[[*keys, "pt_id", "label"]].copy()
    out["own_sum"] = np.where(here, sums[row, spot], 0.0)
    out["own_cnt"] = np.where(here, counts[spot], 0)
    if split:
        out["near"] = np.nan
        out["split_label"] = pd.array(np.where(here, 0, labels[0]), dtype="Int64").copy()
        out.loc[here, "split_label"] = pd.NA
        out["split_sum"] = np.where(here, np.nan, sums[:, 0])
        out["split_cnt"] = pd.array(np.where(here, 0, counts[0]), dtype="Int64")
    else:
        means = sums / counts
        means[row[here], spot[here]] = np.inf
        near = means.min(axis=1)
        out["near"] = np.where(np.isfinite(near), near, np.nan)
        out["split_label"] = pd.array([pd.NA] * len(out), dtype="Int64")
        out["split_sum"] = np.nan
        out["split_cnt"] = pd.array([pd.NA] * len(out), dtype="Int64")
    return out[names]


def _merge(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Per point: own distances added up, nearest other cluster over all target blocks."""
    point = [*keys, "pt_id"]
    per_label = (
        sums.repartition(*point)
        .groupBy(*point, "label", "split_label")
        .agg(
            F.sum("own_sum").alias("own_sum"),
            F.sum("own_cnt").alias("own_cnt"),
            F.min("near").alias("near"),
            (F.sum("split_sum") / F.sum("split_cnt")).alias("split_mean"),
        )
    )
    return per_label.groupBy(*point, "label").agg(
        F.sum("own_sum").alias("own_sum"),
        F.sum("own_cnt").alias("own_cnt"),
        F.least(F.min("near"), F.min("split_mean")).alias("near"),
    )


def silhouette_squared(points: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Silhouette with squared Euclidean distances, in linear time.

    Not equal to ``silhouette``; offered for groups whose pair work is out of reach. The mean
    squared distance of a point to a cluster follows from the cluster's size, mean and mean
    squared norm, so only cluster statistics are joined to the points. Coordinates are taken from the
    mean of the group, as squares of large ones would swallow the differences.
    """
    keys = list(keys)
    kept = points.where(F.col("label") != NOISE).select(*keys, "pt_id", "label", "features")
    middle = (
        kept.select(*keys, F.posexplode("features").alias("dim", "v"))
        .groupBy(*keys, "dim").agg(F.avg("v").alias("mean"))
        .groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("middle"))
    )
    scored = kept.join(middle, keys).withColumn(
        "features", F.zip_with("features", "middle", lambda v, m: v - m)).drop("middle")
    coordinates = scored.select(*keys, "label", F.posexplode("features").alias("dim", "v"))
    stats = (
        coordinates.groupBy(*keys, "label", "dim")
        .agg(F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("v")).alias("square"), F.count("v").alias("n"))
        .groupBy(*keys, "label")
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("mean"),
            F.sum("square").alias("square"),
            F.max("n").alias("n"),
        )
    )
    per_group = stats.groupBy(*keys).agg(F.collect_list(F.struct("label", "mean", "square", "n")).alias("stats"))

    def mean_sq(s):
        norm2 = F.aggregate("features", F.lit(0.0), lambda acc, v: acc + v * v)
        dot = F.aggregate(F.zip_with("features", s["mean"], lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
        return norm2 - 2 * dot + s["square"]

    joined = scored.join(per_group, keys).withColumns({
        "mine": F.get(F.filter("stats", lambda s: s["label"] == F.col("label")), 0),
        "others": F.filter("stats", lambda s: s["label"] != F.col("label")),
    })
    own = mean_sq(F.col("mine")) * F.col("mine.n") / (F.col("mine.n") - 1)
    near = F.array_min(F.transform("others", mean_sq))
    scores = joined.select(
        *keys, "pt_id", "label", F.col("mine.n").alias("own_cnt"),
        F.when(F.col("mine.n") > 1, own).alias("own"), near.alias("near"),
    )
    top = F.greatest("own", "near")
    return mean_silhouette(
        scores.withColumn("silhouette", F.when((F.col("own_cnt") > 1) & (top > 0), (F.col("near") - F.col("own")) / top).otherwise(0.0)),
        keys,
    )
