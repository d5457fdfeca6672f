"""Centroid drift and cluster lifecycle over a table of snapshots.

A snapshot row is (keys, step, cluster_id, centroid); ``step`` counts snapshots of a stream
from any start without gaps, so an empty snapshot is a step without rows. ``number_steps``
makes that number from timestamps.

Nothing here walks a cluster's whole history in one task. Neighbouring steps meet through a
grouping on (keys, cluster_id, step), and running values (age, smoothed drift) are folds of
affine maps, which ``affine_scan`` computes in bounded chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions.ordering import affine_scan, ordered_index
from murmura.functions.vector import distance, v_norm, v_scale, v_sub, v_unit
from murmura.operators.validate import sane_centroids

MIN_AGE_FOR_DRIFT = 2


def check_alpha(alpha: float | None) -> None:
    if alpha is not None and not 0 < alpha <= 1:
        raise ValueError(f"ema_alpha {alpha} is not above 0 and at most 1")


def number_steps(timestamps: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Step table (keys, step, ts, dt) from the distinct snapshot times; the first dt is 1.

    Pass the times of all snapshots, also of those without clusters.
    """
    keys = list(keys)
    numbered = ordered_index(timestamps.select(*keys, ts).distinct(), [ts], key=keys, out="step")
    return with_dt(numbered, keys, ts)


def _seconds(times: DataFrame, ts: str):
    """Time as a number: seconds of a timestamp or date, a number as it is."""
    if times.schema[ts].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)
    return F.col(ts).cast("double")


def with_dt(steps: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Add ``dt``, the time since the step before; 1 for the first step of a stream."""
    keys = list(keys)
    seconds = _seconds(steps, ts)
    earlier = steps.select(*keys, (F.col("step") + 1).alias("step"), seconds.alias("__before"))
    return steps.join(earlier, [*keys, "step"], "left").withColumn(
        "dt", F.coalesce(seconds - F.col("__before"), F.lit(1.0))
    ).drop("__before")


def check_time_order(arrivals: DataFrame, keys: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Snapshots (keys, seq, ts) in arrival order whose time does not move forward.

    Strict mode fails on the first one; else ``late`` marks them. ``seq`` has no gaps.
    """
    keys = list(keys)
    earlier = arrivals.select(*keys, (F.col("seq") + 1).alias("seq"), F.col("ts").alias("__before"))
    marked = arrivals.join(earlier, [*keys, "seq"], "left").withColumn(
        "late", F.coalesce(F.col("ts") <= F.col("__before"), F.lit(False))
    ).drop("__before")
    if not strict:
        return marked
    guard = F.when(~F.col("late"), F.lit(True)).otherwise(
        F.raise_error(F.lit("timestamp must be increasing between updates")).cast("boolean")
    )
    return marked.where(guard)


def lifecycle(snapshots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, step, cluster_id, state, centroid, previous, age_hint) with state appeared / stable / disappeared.

    A row is sent to its own step and the following two, so one shuffle shows every step what
    the two steps before held. A cluster gone after the last step gives no row: there is no
    later snapshot to miss it.
    """
    keys = list(keys)
    here = F.col("__lag") == 0
    spread = snapshots.select(
        *keys, "cluster_id", "step", "centroid", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("__lag")
    ).withColumn("step", F.col("step") + F.col("__lag"))
    met = spread.groupBy(*keys, "cluster_id", "step").agg(
        F.max(F.when(here, F.col("centroid"))).alias("centroid"),
        F.max(F.when(F.col("__lag") == 1, F.col("centroid"))).alias("previous"),
        F.max(F.col("__lag") == 2).alias("two_back"),
    )
    state = (
        F.when(F.col("previous").isNull(), "appeared")
        .when(F.col("centroid").isNull(), "disappeared")
        .otherwise("stable")
    )
    return met.where(F.col("centroid").isNotNull() | F.col("previous").isNotNull()).withColumn("state", state)


def step_span(snapshots: DataFrame) -> tuple[int, int]:
    """Lowest and highest step over all streams; (0, -1) without rows."""
    low, high = snapshots.agg(F.min("step"), F.max("step")).first()
    return (0, -1) if low is None else (low, high)


def last_steps(snapshots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return snapshots.groupBy(*keys).agg(F.max("step").alias("last_step"))


def _known_changes(
    snapshots: DataFrame, keys: list[str], steps: DataFrame | None, last_step: int | None
) -> DataFrame:
    """Lifecycle rows up to the last snapshot of each stream."""
    changes = lifecycle(snapshots, keys)
    if steps is not None:
        return changes.join(steps.select(*keys, "step"), [*keys, "step"], "left_semi")
    if keys:
        return changes.join(last_steps(snapshots, keys), keys).where(
            F.col("step") <= F.col("last_step")
        ).drop("last_step")
    if last_step is None:
        last_step = step_span(snapshots)[1]
    return changes.where(F.col("step") <= last_step)


def displacements(
    snapshots: DataFrame,
    keys: Sequence[str] = (),
    steps: DataFrame | None = None,
    dims: int | None = None,
    last_step: int | None = None,
) -> DataFrame:
    """Lifecycle rows with displacement, distance, direction and speed for stable clusters.

    ``steps`` is a step table with ``dt`` (timestamp mode); without it dt is 1 (step mode).
    """
    keys = list(keys)
    changes = _known_changes(snapshots, keys, steps, last_step)
    if steps is None:
        timed = changes.withColumn("dt", F.lit(1.0))
    else:
        timed = changes.join(steps.select(*keys, "step", "dt"), [*keys, "step"], "left")
    stable = F.col("state") == "stable"
    moved = timed.withColumns({
        "displacement": F.when(stable, v_sub(F.col("centroid"), F.col("previous"))),
        "distance": F.when(stable, distance(F.col("centroid"), F.col("previous"), dims)),
    })
    return moved.withColumns({
        "direction": F.when(stable, v_unit(F.col("displacement"), F.col("distance"))),
        "speed": F.when(stable, F.when(F.col("dt") > 0, F.col("distance") / F.col("dt")).otherwise(0.0)),
    })


def per_cluster_drift(
    snapshots: DataFrame,
    keys: Sequence[str] = (),
    ema_alpha: float | None = None,
    smooth_direction: bool = True,
    steps: DataFrame | None = None,
    dims: int = 2,
    chunk: int = 1024,
    span: tuple[int, int] | None = None,
) -> DataFrame:
    """Every lifecycle row with age, smoothed distance and smoothed direction.

    The smoothed distance starts at the first distance of a cluster's life; the smoothed
    direction starts at zero, is stored as it is and shown normalised, and a cluster that
    does not move keeps it untouched and shows none. ``span`` is the known step range, else
    it is looked up.
    """
    check_alpha(ema_alpha)
    keys = list(keys)
    low, high = span or step_span(snapshots)
    moved = displacements(snapshots, keys, steps, dims, high)
    alive = moved.where(F.col("state") != "disappeared")
    stable = F.col("state") == "stable"
    one, zero = F.lit(1.0), F.lit(0.0)
    maps = {"age": (F.when(stable, one).otherwise(zero), one)}
    if ema_alpha is not None:
        keep = F.lit(1.0 - ema_alpha)
        first = ~F.coalesce(F.col("two_back"), F.lit(False))
        maps["ema_distance"] = (
            F.when(stable & ~first, keep).otherwise(zero),
            F.when(stable & first, F.col("distance"))
            .when(stable, F.lit(ema_alpha) * F.col("distance")).otherwise(zero),
        )
        if smooth_direction:
            turning = F.col("direction").isNotNull()
            for i in range(dims):
                maps[f"__dir{i}"] = (
                    F.when(stable & turning, keep).when(stable, one).otherwise(zero),
                    F.when(stable & turning, F.lit(ema_alpha) * F.get("direction", F.lit(i))).otherwise(zero),
                )
    placed = alive.withColumn("__pos", F.col("step") - F.lit(low))
    folded = affine_scan(
        placed, [*keys, "cluster_id"], "__pos", maps, max(1, high - low + 1), chunk
    ).drop("__pos")
    folded = folded.withColumn("age", F.col("age").cast("bigint"))
    no_vector = F.lit(None).cast("array<double>")
    if ema_alpha is None:
        folded = folded.withColumns({"ema_distance": F.lit(None).cast("double"), "ema_state": no_vector, "ema_direction": no_vector})
    else:
        folded = folded.withColumn("ema_distance", F.when(F.col("state") == "stable", F.col("ema_distance")))
        if smooth_direction:
            state = F.array(*[F.col(f"__dir{i}") for i in range(dims)])
            size = v_norm(F.col("ema_state"))
            folded = folded.withColumn("ema_state", state).drop(*[f"__dir{i}" for i in range(dims)]).withColumn(
                "ema_direction", F.when(F.col("direction").isNotNull() & (size > 0), v_scale(F.col("ema_state"), 1 / size))
            )
        else:
            folded = folded.withColumns({"ema_state": no_vector, "ema_direction": no_vector})
    gone = moved.where(F.col("state") == "disappeared").withColumns({
        "age": F.lit(None).cast("bigint"), "ema_distance": F.lit(None).cast("double"),
        "ema_state": no_vector, "ema_direction": no_vector,
    })
    return folded.unionByName(gone).drop("two_back").withColumn(
        "last_seen", F.when(F.col("state") != "disappeared", F.col("step"))
    )


def drift_summary(drift: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per step: mean and largest drift, mean speed, counts and sorted id lists."""
    state = F.col("state")

    def ids(name: str):
        return F.array_sort(F.collect_list(F.when(state == name, F.col("cluster_id")))).alias(name)

    return drift.groupBy(*keys, "step").agg(
        F.avg("distance").alias("mean_drift_distance"),
        F.max("distance").alias("max_drift_distance"),
        F.avg("speed").alias("mean_speed"),
        F.count_if(state == "appeared").alias("num_appeared"),
        F.count_if(state == "disappeared").alias("num_disappeared"),
        F.count_if(state == "stable").alias("num_stable"),
        ids("appeared"), ids("disappeared"), ids("stable"),
    )


def drift_update(
    snapshots: DataFrame,
    keys: Sequence[str] = (),
    ema_alpha: float | None = None,
    smooth_direction: bool = True,
    steps: DataFrame | None = None,
    dims: int = 2,
    strict: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The full update of every step: (per-cluster rows, per-step summary).

    ``steps`` also makes empty snapshots visible in the summary.
    """
    keys = list(keys)
    drift = per_cluster_drift(sane_centroids(snapshots, strict), keys, ema_alpha, smooth_direction, steps, dims)
    summary = drift_summary(drift, keys)
    if steps is not None:
        empty = F.array().cast("array<bigint>")
        summary = steps.join(summary, [*keys, "step"], "left").withColumns({
            **{c: F.coalesce(c, F.lit(0)) for c in ("num_appeared", "num_disappeared", "num_stable")},
            **{c: F.coalesce(c, empty) for c in ("appeared", "disappeared", "stable")},
        })
    return drift, summary


def drift_state(drift: DataFrame, last: DataFrame | int, keys: Sequence[str] = ()) -> DataFrame:
    """What a tracker remembers after the last step: centroids, ages, last seen, smoothed values.

    ``last`` is the last step, or one row per stream with its ``last_step``.
    """
    keys = list(keys)
    alive = drift.where(F.col("state") != "disappeared")
    if isinstance(last, int):
        latest = alive.where(F.col("step") == last)
    else:
        latest = alive.join(last.withColumnRenamed("last_step", "step"), [*keys, "step"], "left_semi")
    return latest.select(
        *keys, "cluster_id", "centroid", "age", "last_seen", "ema_distance", F.col("ema_state").alias("ema_direction")
    )


def high_drift(
    state: DataFrame,
    distance_threshold: float | None = None,
    speed_threshold: float | None = None,
) -> DataFrame:
    """Clusters of a drift state past the thresholds, seen for at least two steps.

    Both thresholds are compared with the smoothed distance, as the reference does; without
    smoothing nothing qualifies.
    """
    if distance_threshold is None and speed_threshold is None:
        raise ValueError("no drift threshold was given; at least one is needed")
    ema = F.col("ema_distance")
    over = F.lit(False)
    if distance_threshold is not None:
        over = over | (ema > distance_threshold)
    if speed_threshold is not None:
        over = over | ((ema > 0) & (ema > speed_threshold))
    return state.where((F.col("age") >= MIN_AGE_FOR_DRIFT) & over)
