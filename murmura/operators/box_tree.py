"""Minimum spanning trees of many points in few dimensions, through trees of boxes.

In every round each component takes its lightest edge to another one, as in ``spanning_forest``, but edges are found
when they are needed. Nodes of the tree of boxes meet nodes of the same level and go down together. A pair stays while
its boxes are near enough to hold an edge as light as the lightest one known for a component below; a node wholly in one
component skips all others wholly in it. So far components meet in few leaves, and points inside of one in none.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from murmura.functions.durable import cut_lineage, release
from murmura.operators import boxes
from murmura.operators.boxes import along_curve, apart, axes, boxed, listed, nearest_points, over, segments
from murmura.operators.components import star_rounds
from murmura.operators.kernels import pairwise

#: Leaves whose points are compared in one call.
TOGETHER = 4
#: Distances of boxes and of points may differ in their last digits.
SLACK = 1 + 1e-9


def box_tree(points: DataFrame, keys: Sequence[str], k: int, metric: str, dims: int) -> DataFrame:
    """(keys, a, b, w): the tree of mutual reachability under the order (w, a, b); plain distance for k = 0.

    ``points`` is (keys, pt_id, features), features of ``dims`` coordinates.
    """
    names = list(keys) or [boxes._ALL]
    flat = points.select(*[*keys, *([] if keys else [F.lit(0).alias(boxes._ALL)])], "pt_id", "features")
    near = cut_lineage(nearest_points(flat, names, max(k, 1), metric, dims))
    core = near.groupBy(*names, "pt_id").agg(F.max("distance").alias("core"))
    placed = segments(along_curve(flat, names, dims).select(
        *names, "pt_id", "__rn", *[(x + F.lit(0.0)).alias(f"x{i}") for i, x in enumerate(axes(dims))]), names, dims)
    known = F.coalesce("core", F.lit(0.0)) if k > 0 else F.lit(0.0)
    asking = cut_lineage(placed.drop("__s").join(core, [*names, "pt_id"], "left").withColumns({"core": known, "c": F.col("pt_id")}))
    live = cut_lineage(_known_edges(asking, near, names, dims, metric).withColumns({"ca": F.col("a"), "cb": F.col("b")}))
    release(near)
    depth, most = 1, asking.agg(F.max("node")).first()[0] or 0
    while most >= boxes.FAN:
        depth, most = depth + 1, most // boxes.FAN
    # Points at one place have equal edges to all others, so the smallest id goes first. The first round joins a place up, by its two smallest ids at most.
    spot = Window.partitionBy(*names, *[f"x{i}" for i in range(dims)]).orderBy("pt_id")
    targets = cut_lineage(asking.withColumn("__copy", F.row_number().over(spot)).where("__copy <= 2"))
    chosen: DataFrame | None = None
    edge = F.struct("w", "a", "b")
    while live.limit(1).count():
        ends = live.select(*names, F.col("ca").alias("c"), edge.alias("e"), F.col("cb").alias("other")).unionByName(
            live.select(*names, F.col("cb").alias("c"), edge.alias("e"), F.col("ca").alias("other")))
        best = cut_lineage(ends.groupBy(*names, "c").agg(F.min(F.struct("e", "other")).alias("m")))
        found = _lightest(asking, targets, best, names, dims, metric, depth)
        offered = best.select(*names, "c", "m").unionByName(found.select(*names, "c", F.struct(edge.alias("e"), "other").alias("m")))
        picks = cut_lineage(offered.groupBy(*names, "c").agg(F.min("m").alias("m")).select(
            *names, "c", "m.e.*", F.col("m.other").alias("other")))
        taken = picks.select(*names, "a", "b", "w").distinct()
        chosen = taken if chosen is None else chosen.unionByName(taken)
        renamed = cut_lineage(star_rounds(picks.select(*names, F.col("c").alias("a"), F.col("other").alias("b")), names))
        spent = [best, live, targets, asking]
        for side in ("ca", "cb"):
            live = _renamed(live, renamed, names, side)
        pair = [F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")]
        live = cut_lineage(
            live.where("ca <> cb").select(*names, *pair, edge.alias("e"))
            .groupBy(*names, "ca", "cb").agg(F.min("e").alias("e")).select(*names, "e.a", "e.b", "e.w", "ca", "cb"))
        asking = targets = cut_lineage(_renamed(targets.where("__copy = 1"), renamed, names, "c"))
        release(*spent, renamed)
    kind = {f.name: f.dataType for f in points.schema.fields}
    if chosen is None:
        return points.select(
            *keys, F.col("pt_id").alias("a"), F.col("pt_id").alias("b"), F.lit(0.0).cast(T.DoubleType()).alias("w")).limit(0)
    return chosen.select(*keys, *[F.col(c).cast(kind["pt_id"]) for c in ("a", "b")], "w")


def _renamed(rows: DataFrame, names_of: DataFrame, names: list[str], column: str) -> DataFrame:
    fresh = names_of.select(*names, F.col("node").alias(column), F.col("component").alias("__new"))
    return rows.join(fresh, [*names, column], "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def _known_edges(points: DataFrame, near: DataFrame, names: list[str], dims: int, metric: str) -> DataFrame:
    """(names, a, b, w): edges to the nearest points, and along the curve, which connects all points of a group."""
    gaps = [F.abs(F.col(f"x{i}") - F.col(f"y{i}")) for i in range(dims)]
    if metric == "euclidean":
        length = F.sqrt(reduce(lambda a, b: a + b, [g * g for g in gaps]))
    else:
        length = reduce(lambda a, b: a + b, gaps) if metric == "manhattan" else F.greatest(*gaps, F.lit(0.0))
    ends = [F.least("pt_id", "neighbour").alias("a"), F.greatest("pt_id", "neighbour").alias("b")]
    following = points.select(
        *names, (F.col("__rn") - 1).alias("__rn"), F.col("pt_id").alias("neighbour"), F.col("core").alias("other_core"),
        *[F.col(f"x{i}").alias(f"y{i}") for i in range(dims)])
    along = points.join(following, [*names, "__rn"]).select(*names, *ends, F.greatest(length, "core", "other_core").alias("w"))
    cores = points.select(*names, "pt_id", "core")
    others = points.select(*names, F.col("pt_id").alias("neighbour"), F.col("core").alias("other_core"))
    close = near.join(cores, [*names, "pt_id"]).join(others, [*names, "neighbour"]).select(
        *names, *ends, F.greatest("distance", "core", "other_core").alias("w"))
    return along.unionByName(close).distinct()


def _levels(rows: DataFrame, names: list[str], dims: int, depth: int, *bound: Column) -> list[DataFrame]:
    """Written node tables: boxes, and the least and largest component and core distance below."""
    ranges = [f(of).alias(out) for f, of, out in (
        (F.min, "c", "cmin"), (F.max, "c", "cmax"), (F.min, "core", "kmin"), (F.max, "core", "kmax"))]
    upward = [f(c).alias(c) for f, c in ((F.min, "cmin"), (F.max, "cmax"), (F.min, "kmin"), (F.max, "kmax"))]
    levels = [cut_lineage(boxed(rows, [*names, "node"], dims, *ranges, *bound))]
    while len(levels) < depth:
        levels.append(cut_lineage(over(levels[-1], names, dims, *upward, *bound)))
    return levels


def _below(node: str) -> Column:
    return F.explode(F.sequence(F.col(node) * boxes.FAN, F.col(node) * boxes.FAN + (boxes.FAN - 1)))


def _meeting(
    asked: list[DataFrame], searched: list[DataFrame], names: list[str], dims: int, metric: str
) -> DataFrame:
    """(names, x, y): leaves x of ``asked`` that may have their lightest outgoing edges to leaves y of ``searched``."""
    near, far = apart(dims, metric)
    alone, one = F.col("xmin") == F.col("xmax"), F.col("cmin") == F.col("cmax")
    pairs: DataFrame | None = None
    spent: DataFrame | None = None
    for depth in range(len(asked) - 1, -1, -1):
        new = {"node": "x", "cmin": "xmin", "cmax": "xmax", "kmin": "xlow", "kmax": "xhigh", "bound": "own", "n": "xn"}
        left = asked[depth].withColumnsRenamed(new | {f"{s}{i}": f"q{s}{i}" for i in range(dims) for s in "lh"})
        right = searched[depth].withColumnRenamed("node", "y")
        if pairs is None:
            # At most FAN nodes of a group on each side.
            met = left.withColumn("limit", F.col("own")).join(right, names)
        else:
            down = pairs.select(*names, "y", "limit", _below("x").alias("x")).join(left, [*names, "x"])
            met = down.withColumn("limit", F.least("limit", "own")).withColumn("y", _below("y")).join(right, [*names, "y"])
        # Whatever component a point below x has, a node of several holds a point of another.
        leaving = ~one | alone
        met = met.where(~(alone & one & (F.col("xmin") == F.col("cmin")))).select(
            *names, "x", "y", "limit", F.when(alone, F.col("xmin")).alias("whole"), F.greatest(near, "xlow", "kmin").alias("least"),
            F.when(leaving, F.greatest(far, "xhigh", "kmax")).alias("most"))
        met = cut_lineage(met.where(F.col("least") <= F.col("limit") * SLACK))
        if spent is not None:
            release(spent)
        spent = met
        reach = met.groupBy(*names, "x").agg(F.least(F.min("limit"), F.min("most")).alias("limit"), F.first("whole").alias("whole"))
        joint = reach.where("whole is not null").groupBy(*names, "whole").agg(F.min("limit").alias("joint"))
        limits = reach.join(joint, [*names, "whole"], "left").select(*names, "x", F.least("limit", "joint").alias("limit"))
        pairs = met.drop("limit").join(limits, [*names, "x"]).where(F.col("least") <= F.col("limit") * SLACK).select(
            *names, "x", "y", "limit")
    return pairs.select(*names, "x", "y")


def _lightest(
    asking: DataFrame, targets: DataFrame, best: DataFrame, names: list[str], dims: int, metric: str, depth: int
) -> DataFrame:
    """(names, c, a, b, w, other): the lightest edge from points of c in a leaf to another component, at least where it beats ``best``."""
    known = best.select(*names, "c", F.col("m.e.w").alias("bound"))
    asked = cut_lineage(asking.join(known, [*names, "c"]).where(F.col("core") <= F.col("bound")))
    pairs = _meeting(
        _levels(asked, names, dims, depth, F.max("bound").alias("bound")), _levels(targets, names, dims, depth), names, dims, metric)
    block = lambda c: F.floor(F.col(c) / F.lit(TOGETHER)).alias("__q")
    leaves = listed(targets, [*names, "node"], dims, "pt_id", "core", "c")
    found = pairs.select(*names, block("x"), F.col("y").alias("node")).distinct().join(leaves, [*names, "node"])
    lists = listed(asked.withColumn("__q", block("node")), [*names, "__q"], dims, "pt_id", "core", "c")
    kind = {f.name: f.dataType for f in asked.schema.fields}
    point = kind["pt_id"]
    out = T.StructType([
        *[T.StructField(n, kind[n]) for n in names], *[T.StructField(n, point) for n in ("c", "a", "b")],
        T.StructField("w", T.DoubleType()), T.StructField("other", point)])

    def lightest(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, at, (core, own) = boxes._points(left, dims, ("core", "c"))
        others, there, (far_core, far_own) = boxes._points(right, dims, ("core", "c"))
        mine, theirs = ids.to_numpy(zero_copy_only=False), others.to_numpy(zero_copy_only=False)
        # Targets by id: of equal weights the first one has the smallest (a, b).
        order = np.argsort(theirs, kind="stable")
        theirs, there, far_core, far_own = theirs[order], there[order], far_core[order], far_own[order]
        weight, target = np.full(len(mine), np.inf), np.zeros(len(mine), np.int64)
        for first in range(0, len(theirs), boxes.AT_ONCE):
            part = slice(first, first + boxes.AT_ONCE)
            reach = np.maximum(pairwise(at, there[part], metric), np.maximum(core[:, None], far_core[None, part]))
            reach[own[:, None] == far_own[None, part]] = np.inf
            column = reach.argmin(axis=1)
            value = reach[np.arange(len(mine)), column]
            nearer = value < weight
            weight[nearer], target[nearer] = value[nearer], column[nearer] + first
        row = np.flatnonzero(np.isfinite(weight))
        a, b, w, c, d = mine[row], theirs[target[row]], weight[row], own[row], far_own[target[row]]
        a, b = np.where(a < b, a, b), np.where(a < b, b, a)
        ranks = [np.unique(v, return_inverse=True)[1] for v in (b, a, w, c)]
        order = np.lexsort(ranks)
        order = order[np.flatnonzero(np.diff(ranks[3][order], prepend=-1))]
        of = pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type)
        held = [pa.array(v[order].tolist() if of else v[order], ids.type) for v in (c, a, b, d)]
        key = [pa.repeat(left[n][0], len(order)) if len(order) else left[n].slice(0, 0) for n in names]
        return pa.table([*key, *held[:3], pa.array(w[order], pa.float64()), held[3]], names=out.fieldNames())

    return lists.groupBy(*names, "__q").cogroup(found.groupBy(*names, "__q")).applyInArrow(lightest, out)
