"""Assigning points to their nearest centre, and to the micro-cluster that can take them.

The centres of a group travel as one array beside its points, so the nearest one is found
row by row and no point-centre pair is laid out. Arrays hold at most ``CENTRES`` centres. More centres in up to
three dimensions are searched through a tree of boxes; in more dimensions they are looked up array by array and the best of
each is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.ordering import ordered_index
from murmura.functions.vector import distance, v_add, v_norm
from murmura.operators.boxes import low_dimensional, nearest_points
from murmura.schema import NOISE

CENTRES = 1024
# Centres of a model without keys are sent to every task up to this many.
BROADCAST_CENTRES = 1 << 16
SALTS = 256


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def beside(
    points: DataFrame, centres: DataFrame, keys: Sequence[str], fields: Sequence[str], bound: int
) -> DataFrame:
    """Points with ``centres``: the centres of their group as array of structs, NULL without any.

    ``bound`` is the most centres a group has. Above ``CENTRES`` a point comes once per array.
    """
    keys = list(keys)
    parts = -(-bound // CENTRES)
    slot = F.pmod(F.xxhash64(*fields[:1]), F.lit(parts)) if parts > 1 else F.lit(0).cast("bigint")
    arrays = centres.withColumn("__part", slot).groupBy(*keys, "__part").agg(
        F.collect_list(F.struct(*fields)).alias("centres")
    ).drop("__part")
    if keys:
        return points.join(arrays, keys, "left")
    if bound <= BROADCAST_CENTRES:
        return points.withColumn("__all", F.lit(0)).join(
            F.broadcast(arrays.withColumn("__all", F.lit(0))), "__all", "left"
        ).drop("__all")
    # Too many to send everywhere: points are dealt to salts, every salt gets the arrays.
    dealt = points.withColumn("__salt", F.pmod(F.xxhash64("pt_id"), F.lit(SALTS)).cast("int"))
    copies = arrays.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, "__salt", "left").drop("__salt")


def _best_of_arrays(df: DataFrame, point: Sequence[str], best: str) -> DataFrame:
    """One row per point with the least ``best`` over its arrays."""
    rest = [c for c in df.columns if c not in (*point, best)]
    merged = df.groupBy(*point).agg(F.min(best).alias(best), F.first(F.struct(*rest)).alias("__rest"))
    return merged.select(*point, best, "__rest.*")


def _through_tree(points: DataFrame, centres: DataFrame, keys: list[str], dims: int, centre: str, held: Sequence[str]) -> DataFrame:
    """(keys, pt_id, __best): the nearest centre as struct of its distance ``d``, mc_id and ``held``; points without one are left out."""
    near = nearest_points(points, keys, 1, "euclidean", dims, centres.select(
        *keys, F.col("mc_id").alias("target_id"), F.col(centre).alias("features"))).withColumnRenamed("neighbour", "mc_id")
    return near.join(centres.select(*keys, "mc_id", *held), [*keys, "mc_id"]).select(
        *keys, "pt_id", F.struct(F.col("distance").alias("d"), "mc_id", *held).alias("__best"))


def _cut_to(points: DataFrame, dims: int | None) -> DataFrame:
    return points if dims is None else points.withColumn("features", F.slice("features", 1, dims))


def nearest_centroid(
    points: DataFrame,
    centroids: DataFrame,
    keys: Sequence[str] = (),
    max_distance: float | None = None,
    bound: int | None = None,
    dims: int | None = None,
) -> DataFrame:
    """Points with ``label``, ``mc_id`` and ``distance`` of the nearest centroid of their group.

    ``centroids`` has keys, mc_id, centroid. The label is the position of the centroid among
    those of its group ordered by mc_id, from 0; ties go to the lowest. Without a centroid, or
    farther than ``max_distance``, the label is -1. ``bound`` is a known limit on the centroids
    per group, else they are counted.
    """
    keys = list(keys)
    if bound is None:
        bound = largest_group(centroids, keys)
    ranked = ordered_index(centroids.select(*keys, "mc_id", "centroid"), ["mc_id"], keys, "label").withColumn(
        "label", F.col("label") - 1
    )
    bare = points.drop("label", "mc_id", "distance")
    low = low_dimensional(_cut_to(bare, dims), "euclidean") if bound > CENTRES else None
    if low:
        best = _through_tree(_cut_to(bare, dims), ranked, keys, low, "centroid", ["label"])
        found = bare.join(best, [*keys, "pt_id"], "left")
    else:
        joined = beside(bare, ranked, keys, ["mc_id", "centroid", "label"], max(1, bound))
        found = joined.withColumn("__best", F.array_min(F.transform("centres", lambda c: F.struct(
            distance(F.col("features"), c["centroid"], dims).alias("d"),
            c["label"].alias("label"), c["mc_id"].alias("mc_id"),
        )))).drop("centres")
    if bound > CENTRES and not low:
        found = _best_of_arrays(found, [*keys, "pt_id"], "__best")
    near = F.col("__best").isNotNull()
    if max_distance is not None:
        near = near & (F.col("__best.d") <= max_distance)
    return found.select(
        *bare.columns,
        F.when(near, F.col("__best.label")).otherwise(F.lit(NOISE)).cast("bigint").alias("label"),
        F.when(near, F.col("__best.mc_id")).alias("mc_id"),
        F.when(near, F.col("__best.d")).alias("distance"),
    )


RADIUS_FORMS = ("rms", "norms")


def squared_radius(w: Column, cf1: Column, cf2: Column, form: str = "rms") -> Column:
    """Squared radius of a micro-cluster, at least 0.

    ``rms`` is the mean squared distance to the centre, which does not depend on where the origin is. ``norms`` puts
    vector lengths into the same expression, |CF2| / w - (|CF1| / w) ** 2, as some published code does; it is smaller, and far from the
    origin it lets distant points in.
    """
    if form not in RADIUS_FORMS:
        raise ValueError(f"radius form must be one of {RADIUS_FORMS}, got {form}")
    if form == "norms":
        return F.greatest(v_norm(cf2) / w - (v_norm(cf1) / w) * (v_norm(cf1) / w), F.lit(0.0))
    spread = F.aggregate(
        F.zip_with(cf2, cf1, lambda q, s: q / w - (s / w) * (s / w)), F.lit(0.0), lambda acc, v: acc + v)
    return F.greatest(spread, F.lit(0.0))


def absorb(
    points: DataFrame,
    state: DataFrame,
    epsilon: float,
    keys: Sequence[str] = (),
    bound: int | None = None,
    dims: int | None = None,
    radius_form: str = "rms",
) -> DataFrame:
    """Points with the micro-cluster that takes them: ``mc_id``, ``distance``, or NULLs.

    ``state`` has keys, mc_id, status ('p' or 'o'), w, cf1, cf2. The nearest 'p' takes the
    point if its radius stays within ``epsilon``, else the nearest 'o' under the same test.
    """
    keys = list(keys)
    if bound is None:
        bound = largest_group(state, keys)
    bare = points.drop("mc_id", "distance")
    placed = state.withColumn("centre", F.transform("cf1", lambda v: v / F.col("w")))
    low = low_dimensional(_cut_to(bare, dims), "euclidean") if bound > CENTRES else None

    def nearest(status: str) -> Column:
        return F.array_min(F.transform(
            F.filter("centres", lambda c: c["status"] == status),
            lambda c: F.struct(
                distance(F.col("features"), c["centre"], dims).alias("d"),
                c["mc_id"].alias("mc_id"), c["w"].alias("w"), c["cf1"].alias("cf1"), c["cf2"].alias("cf2"),
            ),
        ))

    if low:
        found = bare
        for status in ("p", "o"):
            best = _through_tree(
                _cut_to(bare, dims), placed.where(F.col("status") == status), keys, low, "centre", ["w", "cf1", "cf2"])
            found = found.join(best.withColumnRenamed("__best", f"__{status}"), [*keys, "pt_id"], "left")
    else:
        joined = beside(bare, placed, keys, ["mc_id", "status", "centre", "w", "cf1", "cf2"], max(1, bound))
        found = joined.withColumns({"__p": nearest("p"), "__o": nearest("o")}).drop("centres")
    if bound > CENTRES and not low:
        rest = [c for c in bare.columns if c not in (*keys, "pt_id")]
        found = found.groupBy(*keys, "pt_id").agg(
            F.min("__p").alias("__p"), F.min("__o").alias("__o"), F.first(F.struct(*rest)).alias("__rest")
        ).select(*keys, "pt_id", "__p", "__o", "__rest.*")

    def takes(side: str) -> Column:
        merged = squared_radius(
            F.col(f"{side}.w") + 1,
            v_add(F.col(f"{side}.cf1"), F.col("features")),
            F.zip_with(F.col(f"{side}.cf2"), F.col("features"), lambda s, v: s + v * v),
            radius_form,
        )
        return F.coalesce(F.sqrt(merged) <= epsilon, F.lit(False))

    taker = F.when(takes("__p"), F.col("__p")).when(takes("__o"), F.col("__o"))
    return found.withColumn("__taker", taker).select(
        *bare.columns, F.col("__taker.mc_id").alias("mc_id"), F.col("__taker.d").alias("distance")
    )
