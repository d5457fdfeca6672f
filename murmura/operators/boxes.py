"""Searching all points of a group in few dimensions through packed trees of boxes.

Points are ordered along a space-filling curve and cut into leaves of equal size, so no density makes one
too full; ``FAN`` neighbouring nodes make a node of the next level. A block of points that asks goes down
from the top with the nodes it may still need: boxes say how far the points below are at least and
at most, the nearest of them that hold enough points bound the answer, and nodes that begin beyond it go. What is left at
the leaves holds the answer whatever the data, and is a small multiple of the points that ask.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from murmura.functions.durable import cut_lineage, release
from murmura.functions.ordering import ordered_index
from murmura.operators.kernels import pairwise

LEAF = 64
#: Points that go down the tree together, and points compared with leaves together, a multiple of it.
BLOCK = 16
ASKED = 256
FAN = 16
MOST_DIMS = 3
METRICS = ("euclidean", "manhattan", "chebyshev")
CUTS = 1024
#: A step this far above the mean logarithm of steps ends a block.
FAR = 4.0
#: Points compared with a block at a time.
AT_ONCE = 1 << 13
_ALL = "__all"


def low_dimensional(points: DataFrame, metric: str) -> int | None:
    """The dimensions of ``points`` if boxes serve them and their metric, else None."""
    if metric not in METRICS:
        return None
    least, most = points.agg(F.min(F.size("features")), F.max(F.size("features"))).first()
    return most if most is not None and least == most and 1 <= most <= MOST_DIMS else None


def axes(dims: int) -> list[Column]:
    return [F.get("features", F.lit(i)).cast("double") for i in range(dims)]


def _place(x: Column, cuts: Column) -> Column:
    """Where ``x`` lies among ascending ``cuts``, as a share of 1; linear between two of them."""
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(cuts, mid) <= x)
        return F.struct(
            F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(CUTS.bit_length() + 1))
    at = F.greatest(F.aggregate(steps, start, halve, lambda s: s["lo"]) - 1, F.lit(0))
    low, high = F.get(cuts, at), F.coalesce(F.get(cuts, at + 1), F.element_at(cuts, -1))
    inside = F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x / 2 - low / 2) / (high / 2 - low / 2)))).otherwise(F.lit(0.0))
    return (at + inside) / F.size(cuts)


def along_curve(points: DataFrame, keys: Sequence[str], dims: int, order: Sequence[str] = ("pt_id",)) -> DataFrame:
    """``points`` with ``__rn``, their 1-based place along a curve through the cells of a grid, by ``order`` inside of a cell.

    The grid has CUTS quantiles of each coordinate and equal steps between two of them, so cells are fine where points are dense. Quantiles
    may be rough: they shape the leaves, never what is found.
    """
    shares = [k / CUTS for k in range(CUTS + 1)]
    cuts = points.groupBy(*keys).agg(*[
        F.sort_array(F.array_distinct(F.percentile_approx(x, shares, 8 * CUTS))).alias(f"__c{i}") for i, x in enumerate(axes(dims))])
    bits = 10 * min(3, 6 // dims)
    cells = cut_lineage(points.join(cut_lineage(cuts), list(keys)).select(*points.columns, *[
        F.least(F.floor(_place(x, F.col(f"__c{i}")) * float(1 << bits)), F.lit((1 << bits) - 1)).cast("bigint").alias(f"__p{i}")
        for i, x in enumerate(axes(dims))]))
    # Ten bits at a time, from a table of numbers with their bits ``dims`` apart.
    apart_ = [sum((v >> b & 1) << (b * dims) for b in range(10)) for v in range(1024)]
    table = F.from_json(F.lit(json.dumps(apart_)), "array<bigint>")
    code = F.lit(0).cast("bigint")
    for i in range(dims):
        for bit in range(0, bits, 10):
            ten = F.shiftright(f"__p{i}", bit).bitwiseAND(F.lit(1023).cast("bigint")).cast("int")
            code = code + F.shiftleft(F.get(table, ten), bit * dims + i)
    return ordered_index(cells.select(*points.columns, code.alias("__z")), ["__z", *order], keys, "__rn").drop("__z")


def segments(numbered: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """Add ``__s``, blocks of at most BLOCK neighbours on the curve, and ``node``, leaves of at most LEAF of them.

    Both also end where the curve makes a step far beyond the usual one around: a point on its own has a box of its own.
    Block s belongs to the ASKED points s div ASKED.
    """
    place = F.col("__rn") - 1
    runs = numbered.withColumns({"__run": F.floor(place / ASKED), "__small": F.floor(place / BLOCK), "__leaf": F.floor(place / LEAF)})
    run, small, leaf = (Window.partitionBy(*keys, "__run", *extra).orderBy("__rn") for extra in ((), ("__small",), ("__leaf",)))
    gap = F.greatest(F.lit(0.0), *[F.abs(F.col(f"x{i}") - F.lag(f"x{i}").over(run)) for i in range(dims)])
    usual = F.avg(F.when(F.col("__gap") > 0, F.log("__gap"))).over(Window.partitionBy(*keys, "__run"))
    far = runs.withColumn("__gap", gap).withColumn("__far", F.coalesce(F.log("__gap") > usual + FAR, F.lit(False)).cast("bigint"))
    return far.select(*numbered.columns, *[
        (F.col(name) * size + F.least(F.sum("__far").over(window), F.lit(size - 1))).alias(out)
        for name, size, window, out in (("__small", BLOCK, small, "__s"), ("__leaf", LEAF, leaf, "node"))])


def _sides(dims: int, low: str = "l", high: str = "h") -> list[str]:
    return [f"{n}{i}" for i in range(dims) for n in (low, high)]


def boxed(rows: DataFrame, by: Sequence[str], dims: int, *more: Column) -> DataFrame:
    """Boxes l0, h0, .. and counts of rows that have coordinates (x0, ..)."""
    return rows.groupBy(*by).agg(
        *[f(f"x{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("l", F.min), ("h", F.max))],
        F.count(F.lit(1)).alias("n"), *more)


def over(nodes: DataFrame, keys: Sequence[str], dims: int, *more: Column) -> DataFrame:
    """The nodes one level up."""
    up = nodes.withColumn("node", F.floor(F.col("node") / F.lit(FAN)))
    return up.groupBy(*keys, "node").agg(
        *[f(f"{n}{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("l", F.min), ("h", F.max))], F.sum("n").alias("n"), *more)


def levels_of(leaves: DataFrame, keys: Sequence[str], dims: int, *more: Column) -> list[DataFrame]:
    """Written node tables from the leaves up to at most FAN nodes a group."""
    levels = [cut_lineage(leaves)]
    most = levels[0].agg(F.max("node")).first()[0] or 0
    while most >= FAN:
        levels.append(cut_lineage(over(levels[-1], keys, dims, *more)))
        most //= FAN
    return levels


def apart(dims: int, metric: str) -> tuple[Column, Column]:
    """(least, largest) distance between a point of box (l, h) and one of box (ql, qh)."""

    def joined(gaps: list[Column]) -> Column:
        if metric == "euclidean":
            return F.sqrt(reduce(lambda a, b: a + b, [g * g for g in gaps]))
        return reduce(lambda a, b: a + b, gaps) if metric == "manhattan" else F.greatest(*gaps, F.lit(0.0))

    near = [F.greatest(F.lit(0.0), F.col(f"l{i}") - F.col(f"qh{i}"), F.col(f"ql{i}") - F.col(f"h{i}")) for i in range(dims)]
    far = [F.greatest(F.col(f"h{i}") - F.col(f"ql{i}"), F.col(f"qh{i}") - F.col(f"l{i}")) for i in range(dims)]
    return joined(near), joined(far)


def descended(
    asked: DataFrame, levels: list[DataFrame], by: Sequence[str], keys: Sequence[str], need: int,
    least: Column, most: Column, enough: Column, fits: Column | None = None, bound: str | None = None,
) -> DataFrame:
    """(by, node): the leaves that each of ``asked`` (by, box ql0, qh0, .., ..) may need for its ``need`` nearest.

    ``least`` and ``most`` bound the distance to what is under a node, ``enough`` says how many points count for it; ``fits`` leaves
    nodes out, and a column ``bound`` of ``asked`` is a limit known before.
    """
    keys, by = list(keys), list(by)
    box = [c for c in asked.columns if c not in by and c != bound]
    inf = F.lit(float("inf"))
    pairs = asked.select(*by, *box, (F.col(bound) if bound else inf).alias("__limit"), F.lit(0).cast("bigint").alias("__up"))
    spent: DataFrame | None = None
    for depth in range(len(levels) - 1, -1, -1):
        # A node brings those below it, so a pair is moved once for all of them, and what lies beyond the limit known so far is not moved on.
        fields = [c for c in levels[depth].columns if c not in keys]
        below = levels[depth].withColumn("__up", F.floor(F.col("node") / F.lit(FAN))).groupBy(*keys, "__up").agg(
            F.collect_list(F.struct(*fields)).alias("__below"))
        met = pairs.join(below, [*keys, "__up"]).select(*by, *box, "__limit", F.explode("__below").alias("__node")).select(
            *by, *box, "__limit", "__node.*")
        if fits is not None:
            met = met.where(fits)
        met = met.select(*by, *box, "__limit", F.struct(most.alias("most"), "node", least.alias("least"), enough.alias("c")).alias("e")).where(
            F.col("e.least") <= F.col("__limit"))
        held = met.groupBy(*by, *box, "__limit").agg(F.sort_array(F.collect_list("e")).alias("all"))
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), inf.alias("at"))
        reach = F.aggregate("all", start, lambda s, e: F.when(s["seen"] >= need, s).otherwise(F.struct(
            (s["seen"] + e["c"]).alias("seen"), F.when(s["seen"] + e["c"] >= need, e["most"]).otherwise(inf).alias("at"))))["at"]
        # Distances of boxes and of points may differ in their last digits.
        kept = held.withColumn("__limit", F.least(reach * (1 + 1e-9), F.col("__limit"))).select(
            *by, *box, "__limit", F.explode(F.filter("all", lambda e: e["least"] <= F.col("__limit"))).alias("e"))
        if depth:
            kept = kept.select(*by, *box, "__limit", F.col("e.node").alias("__up"))
        else:
            kept = kept.select(*by, F.col("e.node").alias("node"))
        kept = cut_lineage(kept)
        if spent is not None:
            release(spent)
        pairs = spent = kept
    return pairs


def around(asked: DataFrame, levels: list[DataFrame], keys: Sequence[str], need: int, most: Column) -> DataFrame:
    """``asked`` with ``__bound`` in place of ``__own``, the leaf it comes from: how far that leaf, or the node above it, is at most if it holds enough."""
    asked = asked.withColumn("__bound", F.lit(float("inf")))
    for depth, nodes in enumerate(levels[:2]):
        extra = [c for c in nodes.columns if c not in (*keys, "node")]
        asked = asked.withColumn("__at", F.floor(F.col("__own") / F.lit(FAN ** depth))).join(
            nodes.withColumnRenamed("node", "__at"), [*keys, "__at"], "left").withColumn(
            "__bound", F.least("__bound", F.when(F.col("n") >= need, most * (1 + 1e-9)))).drop("__at", *extra)
    return asked.drop("__own")


def _points(table: pa.Table, dims: int, names: Sequence[str]) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """(ids, coordinates, other columns) of rows that hold lists of points."""
    table = table.combine_chunks()
    flat = [table[c].combine_chunks().flatten() if table.num_rows else None for c in ("ids", *[f"x{i}" for i in range(dims)], *names)]
    if flat[0] is None:
        return pa.array([], table.schema.field("ids").type.value_type), np.zeros((0, dims)), [np.zeros(0) for _ in names]
    numbers = [f.to_numpy(zero_copy_only=False) for f in flat[1:]]
    return flat[0], np.stack(numbers[:dims], axis=1), numbers[dims:]


def listed(rows: DataFrame, by: Sequence[str], dims: int, id_col: str, *more: str) -> DataFrame:
    """Points (id_col, x0, .., more) as lists, a row for each of ``by``; what one row holds is of one order."""
    names = [id_col, *[f"x{i}" for i in range(dims)], *more]
    held = rows.groupBy(*by).agg(F.collect_list(F.struct(*names)).alias("__p"))
    return held.select(*by, *[F.col(f"__p.{n}").alias("ids" if n == id_col else n) for n in names])


def nearest_points(
    points: DataFrame, keys: Sequence[str], k: int, metric: str, dims: int, targets: DataFrame | None = None
) -> DataFrame:
    """(keys, pt_id, neighbour, distance, rank): the k nearest others of points in up to three dimensions, ties by id.

    ``targets`` (keys, target_id, features) are searched in place of the points themselves. Points and targets without a group of the other kind
    give nothing.
    """
    names = list(keys) or [_ALL]
    given = [*keys, *([] if keys else [F.lit(0).alias(_ALL)])]
    kind = {f.name: f.dataType for f in points.schema.fields}
    searched = kind["pt_id"] if targets is None else targets.schema["target_id"].dataType
    itself = F.col("pt_id") if targets is None else F.lit(None).cast(searched)
    flat = points.select(*given, "pt_id", itself.alias("target_id"), "features")
    if targets is not None:
        flat = flat.unionByName(targets.select(*given, F.lit(None).cast(kind["pt_id"]).alias("pt_id"), "target_id", "features"))
    # Zeros of both signs are one place.
    numbered = cut_lineage(segments(along_curve(flat, names, dims, ["pt_id", "target_id"]).select(
        *names, "pt_id", "target_id", "__rn", *[(x + F.lit(0.0)).alias(f"x{i}") for i, x in enumerate(axes(dims))]), names, dims))
    # Of targets at one place no one needs more than k + 1.
    spot = Window.partitionBy(*names, *[f"x{i}" for i in range(dims)]).orderBy("target_id")
    few = cut_lineage(numbered.where(F.col("target_id").isNotNull()).withColumn("__copy", F.row_number().over(spot)).where(
        F.col("__copy") <= k + 1).select(*names, "target_id", "node", *[f"x{i}" for i in range(dims)]))
    levels = levels_of(boxed(few, [*names, "node"], dims), names, dims)
    leaves = cut_lineage(listed(few, [*names, "node"], dims, "target_id"))
    asking = numbered.where(F.col("pt_id").isNotNull())
    boxes = boxed(asking, [*names, "__s"], dims, F.min("node").alias("__own")).select(
        *names, "__s", "__own", *[F.col(c).alias(f"q{c}") for c in _sides(dims)])
    least, most = apart(dims, metric)
    near = cut_lineage(around(boxes, levels, names, k + 1, most))
    pairs = descended(near, levels, [*names, "__s"], names, k + 1, least, most, F.col("n"), bound="__bound")
    block = F.floor(F.col("__s") / F.lit(ASKED)).alias("__q")
    found = pairs.select(*names, block, "node").distinct().join(leaves, [*names, "node"])
    asked = listed(asking.withColumn("__q", block), [*names, "__q"], dims, "pt_id")
    out = T.StructType([
        *[T.StructField(c, kind[c]) for c in keys], T.StructField("pt_id", kind["pt_id"]), T.StructField("neighbour", searched),
        T.StructField("distance", T.DoubleType()), T.StructField("rank", T.LongType())])
    held, alone = list(keys), targets is None

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, at, _ = _points(left, dims, ())
        others, there, _ = _points(right, dims, ())
        order = pa.compute.sort_indices(others)
        others, there = others.take(order), there[order.to_numpy()]
        mine, names_ = ids.to_numpy(zero_copy_only=False), others.to_numpy(zero_copy_only=False)
        rows, columns, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a in range(0, len(there), AT_ONCE):
            dist = pairwise(at, there[a: a + AT_ONCE], metric)
            if alone:
                dist[mine[:, None] == names_[None, a: a + AT_ONCE]] = np.inf
            count = min(k, dist.shape[1])
            reach = np.partition(dist, count - 1, axis=1)[:, count - 1]
            row, column = np.nonzero((dist <= reach[:, None]) & np.isfinite(dist))
            rows.append(row)
            columns.append(column + a)
            lengths.append(dist[row, column])
        row, column, dist = (np.concatenate(x) for x in (rows, columns, lengths))
        order = np.lexsort((column, dist, row))
        row, column, dist = row[order], column[order], dist[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        keep = rank <= k
        row, column, dist, rank = row[keep], column[keep], dist[keep], rank[keep]
        key = [pa.repeat(left[c][0], len(row)) for c in held] if len(row) else [left[c].slice(0, 0) for c in held]
        return pa.table([*key, ids.take(pa.array(row)), others.take(pa.array(column)), dist, rank.astype(np.int64)],
                        names=out.fieldNames())

    return asked.groupBy(*names, "__q").cogroup(found.groupBy(*names, "__q")).applyInArrow(nearest, out)
