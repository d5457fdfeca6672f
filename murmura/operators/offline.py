"""Offline hierarchical density clustering of batches.

Stages: distance to the k-th neighbour, mutual reachability, minimum spanning tree, merging
along the tree. The all-against-all stages run on pairs of bounded blocks and return at most
a few values per point. The tree of a batch has one edge fewer than points; it is folded
lightest edge first, keeping only sums per component, so a tree too big for one task is folded
one range of edges after the other, with the components of a range in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.operators.blocks import BLOCK_ROWS, dealt, one_against_all, unordered_pairs
from murmura.operators.box_tree import box_tree
from murmura.operators.boxes import low_dimensional, nearest_points
from murmura.operators.components import components, spanning_forest
from murmura.operators.hierarchy import label_forest, tree_labels
from murmura.operators.kernels import METRICS, core_of, matrix, pairwise, spanning_edges
from murmura.operators.quality import batch_metrics, cluster_sizes
from murmura.schema import NOISE

SELECTION_METHODS = ("eom", "leaf")
#: Blocks of a group from which on spanning trees go through trees of boxes.
TREE_BLOCKS = 32


def check_params(
    min_cluster_size: int = 5,
    min_samples: int | None = None,
    metric: str = "euclidean",
    cluster_selection_method: str = "eom",
    history_size: int = 50,
    random_state: int | None = None,
) -> None:
    """Raise ``ValueError`` for settings no batch could be clustered with."""
    rules = (
        ("min_cluster_size", min_cluster_size, min_cluster_size >= 2, "at least 2"),
        ("min_samples", min_samples, min_samples is None or min_samples >= 1, "at least 1"),
        ("metric", metric, metric in METRICS, f"one of {METRICS}"),
        ("cluster_selection_method", cluster_selection_method, cluster_selection_method in SELECTION_METHODS,
         f"one of {SELECTION_METHODS}"),
        ("history_size", history_size, history_size >= 1, "at least 1"),
        ("random_state", random_state, random_state is None or random_state >= 0, "not negative"),
    )
    for name, value, fine, asked in rules:
        if not fine:
            raise ValueError(f"{name} = {value!r}: it has to be {asked}")


def _schema(df: DataFrame, keys: list[str], **columns: T.DataType | str) -> T.StructType:
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = [T.StructField(k, types[k]) for k in keys]
    for name, kind in columns.items():
        fields.append(T.StructField(name, types[kind] if isinstance(kind, str) else kind))
    return T.StructType(fields)


def _fits(group_bound: int | None, block_rows: int) -> bool:
    return group_bound is not None and group_bound <= block_rows


def neighbours(
    points: DataFrame,
    keys: Sequence[str] = ("batch_id",),
    k: int = 5,
    metric: str = "euclidean",
    group_bound: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(keys, pt_id, neighbour, distance, rank): the k nearest others, ties by id.

    Points of up to three dimensions are searched through trees of boxes, others by pairs of blocks.
    """
    keys = list(keys)
    rows = points.select(*keys, "pt_id", "features")
    number = T.DoubleType()
    out = _schema(rows, keys, pt_id="pt_id", neighbour="pt_id", distance=number, rank=T.LongType())
    names = out.fieldNames()

    def nearest(asked: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        targets = targets.sort_values("pt_id", kind="stable")
        dist = pairwise(matrix(asked["features"]), matrix(targets["features"]), metric)
        ids = targets["pt_id"].to_numpy()
        dist[asked["pt_id"].to_numpy()[:, None] == ids[None, :]] = np.inf
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(dist, order, axis=1)
        width = order.shape[1]
        frame = asked.loc[asked.index.repeat(width), [*keys, "pt_id"]].reset_index(drop=True)
        frame["neighbour"], frame["distance"] = ids[order].ravel(), found.ravel()
        frame["rank"] = np.tile(np.arange(1, width + 1), len(asked))
        return frame[np.isfinite(frame["distance"])][names]

    if _fits(group_bound, block_rows):
        return dealt(rows, keys).groupBy(*keys).applyInPandas(lambda pdf: nearest(pdf, pdf), out)

    dims = low_dimensional(rows, metric)
    if dims is not None:
        return nearest_points(rows, keys, k, metric, dims)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, targets = pdf[~pdf["is_target"]], pdf[pdf["is_target"]]
        return pd.DataFrame(columns=names) if asked.empty or targets.empty else nearest(asked, targets)

    spread = one_against_all(rows, keys, block_rows)
    local = dealt(spread, [*keys, "block", "other"]).groupBy(*keys, "block", "other").applyInPandas(part, out)
    best = local.groupBy(*keys, "pt_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("__best")
    )
    return best.select(*keys, "pt_id", F.posexplode("__best").alias("rank", "__b")).select(
        *keys, "pt_id", "__b.neighbour", "__b.distance", (F.col("rank") + 1).cast("bigint").alias("rank")
    )


def core_distances(
    points: DataFrame,
    keys: Sequence[str] = ("batch_id",),
    k: int = 5,
    metric: str = "euclidean",
    group_bound: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(keys, pt_id, core): distance to the k-th other point, or the farthest of fewer; 0 if alone."""
    keys = list(keys)
    rows = points.select(*keys, "pt_id", "features")
    out = _schema(rows, keys, pt_id="pt_id", core=T.DoubleType())
    if _fits(group_bound, block_rows):

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            dist = pairwise(matrix(pdf["features"]), matrix(pdf["features"]), metric)
            np.fill_diagonal(dist, 0.0)
            return pdf[[*keys, "pt_id"]].assign(core=core_of(dist, k))

        return dealt(rows, keys).groupBy(*keys).applyInPandas(whole, out)
    near = neighbours(rows, keys, k, metric, None, block_rows)
    core = near.groupBy(*keys, "pt_id").agg(F.max("distance").alias("core"))
    return rows.select(*keys, "pt_id").join(core, [*keys, "pt_id"], "left").withColumn(
        "core", F.coalesce("core", F.lit(0.0))
    )


def mutual_reachability(
    points: DataFrame,
    keys: Sequence[str] = ("batch_id",),
    k: int = 5,
    metric: str = "euclidean",
    group_bound: int | None = None,
) -> DataFrame:
    """(keys, a, b, w), a < b: mutual reachability of every point with its k nearest others.

    w is the largest of the distance and both core distances. The spanning tree over all pairs
    is ``mst_edges``, which never lays the pairs out.
    """
    keys = list(keys)
    near = neighbours(points, keys, k, metric, group_bound)
    core = near.groupBy(*keys, "pt_id").agg(F.max("distance").alias("core"))
    other = core.select(*keys, F.col("pt_id").alias("neighbour"), F.col("core").alias("other_core"))
    return (
        near.join(core, [*keys, "pt_id"]).join(other, [*keys, "neighbour"])
        .select(
            *keys, F.least("pt_id", "neighbour").alias("a"), F.greatest("pt_id", "neighbour").alias("b"),
            F.greatest("distance", "core", "other_core").alias("w"),
        )
        .distinct()
    )


def mst_edges(
    points: DataFrame,
    keys: Sequence[str] = ("batch_id",),
    k: int = 5,
    metric: str = "euclidean",
    group_bound: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(keys, a, b, w): minimum spanning tree of mutual reachability; plain distance for k = 0.

    A group of several blocks: each pair of blocks gives the tree of its own points, and the
    tree of the union of those trees is the tree of the group. Where a group has more than ``TREE_BLOCKS``
    blocks of points of up to three dimensions, edges are looked for through trees of boxes; the tree is the same.
    """
    keys = list(keys)
    rows = points.select(*keys, "pt_id", "features")
    out = _schema(rows, keys, a="pt_id", b="pt_id", w=T.DoubleType())

    def tree(pdf: pd.DataFrame, core: np.ndarray | None) -> pd.DataFrame:
        ids, weights = _reach(pdf, metric, k, core)
        a, b, w = spanning_edges(ids, weights)
        frame = pd.DataFrame({"a": a, "b": b, "w": w})
        for name in keys:
            frame[name] = pdf[name].iloc[0]
        return frame[out.fieldNames()]

    if _fits(group_bound, block_rows):
        return dealt(rows, keys).groupBy(*keys).applyInPandas(lambda pdf: tree(pdf.sort_values("pt_id"), None), out)

    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    dims = low_dimensional(rows, metric) if largest > TREE_BLOCKS * block_rows else None
    if dims is not None:
        return box_tree(rows, keys, k, metric, dims)
    if k > 0:
        core = core_distances(rows, keys, k, metric, None, block_rows)
        rows = rows.join(core, [*keys, "pt_id"])
    else:
        rows = rows.withColumn("core", F.lit(0.0))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pt_id")
        return tree(pdf, pdf["core"].to_numpy())

    pairs = unordered_pairs(rows, keys, block_rows)
    local = dealt(pairs, [*keys, "block", "other"]).groupBy(*keys, "block", "other").applyInPandas(part, out).distinct()
    return spanning_forest(local, keys)


def _reach(pdf: pd.DataFrame, metric: str, k: int, core: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mutual reachability of the points of one block, sorted by id."""
    features = matrix(pdf["features"])
    dist = pairwise(features, features, metric)
    np.fill_diagonal(dist, 0.0)
    if core is None:
        core = core_of(dist, k) if k > 0 else np.zeros(len(dist))
    return pdf["pt_id"].to_numpy(), np.maximum(dist, np.maximum(core[:, None], core[None, :]))


def density_cut(
    points: DataFrame,
    eps: float,
    keys: Sequence[str] = ("batch_id",),
    k: int = 5,
    metric: str = "euclidean",
    group_bound: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(keys, pt_id, component): flat cut of the hierarchy at ``eps``; noise has no component.

    Points with their core distance within ``eps`` belong to the component of the tree edges
    up to ``eps``, named by its smallest point.
    """
    keys = list(keys)
    edges = mst_edges(points, keys, k, metric, group_bound, block_rows).where(F.col("w") <= eps)
    core = core_distances(points, keys, k, metric, group_bound, block_rows)
    nodes = points.select(*keys, F.col("pt_id").alias("node"))
    found = components(nodes, edges, keys, group_bound if _fits(group_bound, block_rows) else None)
    return found.withColumnRenamed("node", "pt_id").join(core, [*keys, "pt_id"]).select(
        *keys, "pt_id", F.when(F.col("core") <= eps, F.col("component")).alias("component")
    )


def offline_cluster(
    points: DataFrame,
    keys: Sequence[str] = ("batch_id",),
    min_cluster_size: int = 5,
    min_samples: int | None = None,
    metric: str = "euclidean",
    cluster_selection_method: str = "eom",
    random_state: int | None = None,
    group_bound: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(keys, pt_id, label) for every point; -1 is noise, clusters count from 0 by smallest member.

    Equal weights are ordered by point ids, so ``random_state`` changes nothing.
    """
    check_params(min_cluster_size, min_samples, metric, cluster_selection_method, random_state=random_state)
    keys = list(keys)
    k = min_samples or min_cluster_size
    rows = points.select(*keys, "pt_id", "features")
    out = _schema(rows, keys, pt_id="pt_id", label=T.LongType())

    if _fits(group_bound, block_rows):

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pt_id")
            ids, weights = _reach(pdf, metric, k, None)
            a, b, w = spanning_edges(ids, weights)
            order = np.lexsort((b, a, w))
            tree = list(zip(a[order].tolist(), b[order].tolist(), w[order].tolist(), strict=True))
            labels = tree_labels(ids.tolist(), tree, min_cluster_size, cluster_selection_method)
            return pdf[[*keys, "pt_id"]].assign(label=labels)

        return dealt(rows, keys).groupBy(*keys).applyInPandas(whole, out)

    edges = mst_edges(rows, keys, k, metric, None, block_rows)
    return label_forest(rows, edges, keys, min_cluster_size, cluster_selection_method)


def offline_result(
    points: DataFrame,
    labels: DataFrame,
    keys: Sequence[str] = ("batch_id",),
    model_name: str = "offline",
    batches: DataFrame | None = None,
    group_bound: int | None = None,
) -> DataFrame:
    """Metrics record and cluster size summary of every clustered batch."""
    keys = list(keys)
    labelled = points.drop("label").join(labels, [*keys, "pt_id"])
    metrics = batch_metrics(labelled, model_name, keys, batches, group_bound)
    return metrics.join(cluster_sizes(labelled, keys), keys, "left")

