"""Online damped-window micro-clusters, one mini-batch at a time.

The state is a table with a row per micro-cluster of a stream:

    keys, mc_id, status, n, w, cf1, cf2, t_created, t_last

``w``, ``cf1`` and ``cf2`` are the faded sums of 1, x and x squared at time ``t_last``. Status is
'p' (potential, shown as active), 'o' (outlier, shown as decayed), 'buffer' (a point held back
during warm-up) or 'clock' (one row per stream: ``n`` points seen, ``w`` 1 once warmed up,
``t_created`` the last pruning, ``t_last`` now).

A mini-batch is compared with the state at its start, so the order inside it has no effect and
a batch is one pass over its points:

1. every point looks for the micro-cluster that can take it (``absorb``);
2. points are summed per (micro-cluster, distance ring, grid cell), on the map side first;
3. a micro-cluster takes its rings from the inside out while its radius stays within epsilon;
4. all other points found an outlier micro-cluster per grid cell of diagonal 2 epsilon, which
   keeps its radius within epsilon; it is named by its first point. The warm-up ends the same
   way: the points held back found the first micro-clusters;
5. outliers heavy enough are promoted, and every pruning period faded ones are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from murmura.functions.durable import cut_lineage, new_path, release, remove
from murmura.functions.scalar import decayed_weight, outlier_floor, prune_period
from murmura.operators.assign import RADIUS_FORMS, absorb, largest_group, squared_radius
from murmura.operators.components import components
from murmura.operators.offline import mst_edges
from murmura.operators.online_run import CLASH, folded

RINGS_PER_EPSILON = 8
CLOCK_ID = -1
#: Points of a stream folded in one task, and micro-clusters up to which that is done.
RUN_ROWS = 1 << 18
RUN_CLUSTERS = 1 << 14


@dataclass(frozen=True)
class OnlineConfig:
    """Parameters of the damped window."""

    decay_factor: float = 0.01
    epsilon: float = 0.5
    beta: float = 0.5
    mu: float = 2.5
    n_samples_init: int = 200
    stream_speed: int = 50
    #: How a radius is measured, see ``squared_radius``.
    radius_form: str = "rms"

    def __post_init__(self) -> None:
        prune_period(self.decay_factor, self.beta, self.mu)
        if self.epsilon <= 0:
            raise ValueError(f"epsilon must be greater than 0, got {self.epsilon}")
        if self.radius_form not in RADIUS_FORMS:
            raise ValueError(f"radius_form must be one of {RADIUS_FORMS}, got {self.radius_form}")
        if self.stream_speed <= 0:
            raise ValueError(f"stream_speed must be greater than 0, got {self.stream_speed}")

    @property
    def core_weight(self) -> float:
        return self.beta * self.mu

    @property
    def period(self) -> int:
        return prune_period(self.decay_factor, self.beta, self.mu)

    @classmethod
    def from_dict(cls, payload: dict) -> OnlineConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in payload.items() if k in known})

    def to_dict(self) -> dict[str, float | int]:
        return asdict(self)

    def configured(self, **changes: float | int | None) -> OnlineConfig:
        """Changed copy; unknown names and None are ignored."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in changes.items() if k in known and v is not None})


class OnlineClusterer:
    """``update(state, batch) -> state``, ``fit(batch) -> state``, ``clusters(state) -> rows``.

    ``batch`` has keys, pt_id (bigint, unique in its stream), features and optionally ``t``, the
    model time of each point; without it all points of a batch arrive at its end, and time is
    the number of points seen divided by ``stream_speed``.
    """

    def __init__(
        self, config: OnlineConfig | None = None, keys: Sequence[str] = (), dims: int = 2,
        micro_clusters: int | None = None,
    ) -> None:
        self.config = config or OnlineConfig()
        self.keys = list(keys)
        self.dims = dims
        # A known limit on the micro-clusters of one stream; counted per update without it.
        self.micro_clusters = micro_clusters

    def state_schema(self, like: DataFrame | None = None) -> T.StructType:
        types = {f.name: f.dataType for f in like.schema.fields} if like is not None else {}
        vector = T.ArrayType(T.DoubleType())
        return T.StructType([
            *[T.StructField(k, types.get(k, T.StringType())) for k in self.keys],
            T.StructField("mc_id", T.LongType()), T.StructField("status", T.StringType()),
            T.StructField("n", T.LongType()), T.StructField("w", T.DoubleType()),
            T.StructField("cf1", vector), T.StructField("cf2", vector),
            T.StructField("t_created", T.DoubleType()), T.StructField("t_last", T.DoubleType()),
        ])

    def empty_state(self, spark: SparkSession, like: DataFrame | None = None) -> DataFrame:
        return spark.createDataFrame([], self.state_schema(like))

    def fit(self, batch: DataFrame) -> DataFrame:
        return self.update(self.empty_state(batch.sparkSession, batch), batch)

    # --- one mini-batch ---

    def update(self, state: DataFrame, batch: DataFrame) -> DataFrame:
        cfg, keys = self.config, self.keys
        # Two small tables are written: the clocks, and the sums of the batch. All that follows
        # works on them and the state, so the batch is read for nothing else.
        clock = cut_lineage(self._clock(state, batch))
        arrived = batch.select(
            *keys, "pt_id", "features", *(["t"] if "t" in batch.columns else [])
        )
        held = state.where("status = 'buffer'").select(
            *keys, F.col("mc_id").alias("pt_id"), F.col("cf1").alias("features"), F.col("t_created").alias("t")
        )
        if "t" not in arrived.columns:
            arrived = arrived.withColumn("t", F.lit(None).cast("double"))
        points = self._join_clock(
            arrived.withColumn("t", F.col("t").cast("double")).unionByName(held), clock
        ).withColumn("t", F.coalesce("t", "now"))
        waiting = points.where(~F.col("ready")).select(
            *keys, F.col("pt_id").alias("mc_id"), F.lit("buffer").alias("status"), F.lit(1).cast("bigint").alias("n"),
            F.lit(1.0).alias("w"), F.col("features").alias("cf1"),
            F.transform("features", lambda v: v * v).alias("cf2"),
            F.col("t").alias("t_created"), F.col("t").alias("t_last"),
        )

        faded = self._faded(state, clock)
        pieces = cut_lineage(self._pieces(points.where("ready"), faded))
        kept, rest = self._rings(pieces, faded)
        grown = self._grown(faded, kept)
        founded = self._founded(rest)
        living = self._join_clock(grown.unionByName(founded), clock)
        living = living.withColumn(
            "status",
            F.when((F.col("status") == "o") & (F.col("w") >= cfg.core_weight), "p").otherwise(F.col("status")),
        )
        stays = self.prune_rule(F.col("now"))
        living = living.where(~F.col("prune") | stays).select(*[f.name for f in self.state_schema().fields])
        ticks = clock.select(
            *keys, F.lit(CLOCK_ID).cast("bigint").alias("mc_id"), F.lit("clock").alias("status"),
            F.col("seen").alias("n"), F.col("ready").cast("double").alias("w"),
            F.array().cast("array<double>").alias("cf1"), F.array().cast("array<double>").alias("cf2"),
            F.when(F.col("prune"), F.col("now")).otherwise(F.col("last_prune")).alias("t_created"),
            F.col("now").alias("t_last"),
        )
        # Spread by row and left to adaptive coalescing: unions would otherwise add up partitions
        # from update to update.
        return living.unionByName(waiting).unionByName(ticks).repartition(*keys, "mc_id")

    def _clock(self, state: DataFrame, batch: DataFrame) -> DataFrame:
        """Per stream: points seen, now, whether warm-up is over, whether pruning is due."""
        cfg, keys = self.config, self.keys
        timed = F.max("t").cast("double") if "t" in batch.columns else F.lit(None).cast("double")
        new = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), timed.alias("t_max"))
        old = state.where("status = 'clock'").select(
            *keys, "n", F.col("w").alias("warm"), F.col("t_created").alias("last_prune"), F.col("t_last")
        )
        none = {c: F.lit(None).cast("double") for c in ("warm", "last_prune", "t_last")}
        both = new.withColumns(none).unionByName(old.withColumn("t_max", F.lit(None).cast("double")))
        merged = both.groupBy(*keys).agg(
            F.sum("n").alias("seen"), F.max("t_max").alias("t_max"), F.max("warm").alias("warm"),
            F.max("last_prune").alias("last_prune"), F.max("t_last").alias("t_last"),
        )
        counted = F.floor(F.col("seen") / F.lit(cfg.stream_speed)).cast("double")
        now = F.greatest(F.coalesce("t_max", counted), F.coalesce("t_last", F.lit(0.0)))
        ready = (F.coalesce("warm", F.lit(0.0)) > 0) | (F.col("seen") >= cfg.n_samples_init)
        return (
            merged.where("seen is not null")
            .withColumn("now", F.when(F.col("t_max").isNull() & F.col("t_last").isNotNull() & F.lit("t" in batch.columns), F.col("t_last")).otherwise(now))
            .withColumn("ready", ready)
            .withColumn("last_prune", F.coalesce("last_prune", F.col("now")))
            .withColumn("prune", F.col("now") - F.col("last_prune") >= cfg.period)
            .select(*keys, "seen", "now", "ready", "last_prune", "prune")
        )

    def _join_clock(self, df: DataFrame, clock: DataFrame) -> DataFrame:
        if self.keys:
            return df.join(clock.select(*self.keys, "now", "ready", "prune"), self.keys)
        # without keys the clock is one row
        one = F.broadcast(clock.select(F.lit(0).alias("__one"), "now", "ready", "prune"))
        return df.withColumn("__one", F.lit(0)).join(one, "__one").drop("__one")

    def _faded(self, state: DataFrame, clock: DataFrame) -> DataFrame:
        """Micro-clusters with their sums faded to now."""
        live = self._join_clock(state.where(F.col("status").isin("p", "o")), clock)
        return fade(live, F.col("now"), self.config.decay_factor).drop("ready", "prune")

    def _pieces(self, points: DataFrame, faded: DataFrame) -> DataFrame:
        """Sums of the points per (micro-cluster, ring, cell); the only pass over the batch."""
        cfg, keys = self.config, self.keys
        # A point of another dimension may not be cut or padded in silence.
        points = points.where(F.when(F.size("features") == self.dims, F.lit(True)).otherwise(F.raise_error(F.concat(
            F.lit(f"points must have {self.dims} coordinates, got "), F.size("features").cast("string"))).cast("boolean")))
        centres = faded.select(*keys, "mc_id", "status", "w", "cf1", "cf2")
        taken = absorb(points, centres, cfg.epsilon, keys, self.micro_clusters, self.dims, cfg.radius_form)
        side = 2 * cfg.epsilon / math.sqrt(self.dims)
        f = decayed_weight(F.lit(1.0), F.col("now") - F.col("t"), cfg.decay_factor)
        x = [F.get("features", F.lit(i)) for i in range(self.dims)]
        return taken.withColumns({
            "ring": F.floor(F.col("distance") / F.lit(cfg.epsilon / RINGS_PER_EPSILON)).cast("bigint"),
            "cell": F.array(*[F.floor(v / F.lit(side)).cast("bigint") for v in x]),
            "f": f,
        }).groupBy(*keys, "mc_id", "ring", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.sum("f").alias("w"),
            F.array(*[F.sum(F.col("f") * v) for v in x]).alias("cf1"),
            F.array(*[F.sum(F.col("f") * v * v) for v in x]).alias("cf2"),
            F.min("pt_id").alias("first_id"), F.min("t").alias("t_first"), F.max("now").alias("now"),
        )

    def _rings(self, pieces: DataFrame, faded: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Split the pieces into those their micro-cluster takes and the rest."""
        keys, dims = self.keys, range(self.dims)
        ring = pieces.where("mc_id is not null").groupBy(*keys, "mc_id", "ring").agg(
            F.sum("w").alias("w"),
            *[F.sum(F.get("cf1", F.lit(i))).alias(f"s{i}") for i in dims],
            *[F.sum(F.get("cf2", F.lit(i))).alias(f"q{i}") for i in dims],
        )
        inside = Window.partitionBy(*keys, "mc_id").orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)
        base = faded.select(*keys, "mc_id", F.col("w").alias("w0"), F.col("cf1").alias("c1"), F.col("cf2").alias("c2"))
        summed = ring.join(base, [*keys, "mc_id"]).withColumns({
            "W": F.col("w0") + F.sum("w").over(inside),
            **{f"S{i}": F.get("c1", F.lit(i)) + F.sum(f"s{i}").over(inside) for i in dims},
            **{f"Q{i}": F.get("c2", F.lit(i)) + F.sum(f"q{i}").over(inside) for i in dims},
        })
        W, S, Q = F.col("W"), F.array(*[F.col(f"S{i}") for i in dims]), F.array(*[F.col(f"Q{i}") for i in dims])
        radius = F.sqrt(squared_radius(W, S, Q, self.config.radius_form))
        too_wide = F.max((radius > self.config.epsilon).cast("int")).over(inside)
        verdict = summed.withColumn("out", too_wide).select(*keys, "mc_id", "ring", "out")
        judged = pieces.join(verdict, [*keys, "mc_id", "ring"], "left")
        return judged.where("out = 0").drop("out"), judged.where("out is null or out > 0").drop("out")

    def _grown(self, faded: DataFrame, kept: DataFrame) -> DataFrame:
        keys = self.keys
        gain = kept.groupBy(*keys, "mc_id").agg(*self._sums(), F.max("now").alias("__now")).select(
            *keys, "mc_id", *[F.col(c).alias(f"+{c}") for c in ("n", "w", "cf1", "cf2")]
        )
        def plus(a: str) -> Column:
            return F.when(F.col(f"+{a}").isNull(), F.col(a)).otherwise(
                F.zip_with(a, f"+{a}", lambda p, q: p + q)
            )
        return faded.join(gain, [*keys, "mc_id"], "left").select(
            *keys, "mc_id", "status", (F.col("n") + F.coalesce("+n", F.lit(0))).alias("n"),
            (F.col("w") + F.coalesce("+w", F.lit(0.0))).alias("w"), plus("cf1").alias("cf1"), plus("cf2").alias("cf2"),
            "t_created", "t_last",
        )

    def _founded(self, rest: DataFrame) -> DataFrame:
        return rest.groupBy(*self.keys, "cell").agg(
            *self._sums(), F.min("first_id").alias("mc_id"), F.min("t_first").alias("t_created"), F.max("now").alias("t_last")
        ).select(*self.keys, "mc_id", F.lit("o").alias("status"), "n", "w", "cf1", "cf2", "t_created", "t_last")

    def _sums(self) -> list[Column]:
        return [
            F.sum("n").alias("n"), F.sum("w").alias("w"),
            *[F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(self.dims)]).alias(c) for c in ("cf1", "cf2")],
        ]

    def prune_rule(self, now: Column) -> Column:
        """Whether a micro-cluster faded to ``now`` is kept at pruning time."""
        floor = outlier_floor(now, F.col("t_created"), self.config.decay_factor, self.config.period)
        return F.when(F.col("status") == "p", F.col("w") >= self.config.core_weight).otherwise(F.col("w") >= floor)

    def plain(self, points: DataFrame) -> Column:
        """Whether a point has all that ``update_run`` asks for."""
        far = 1e15 * self.config.epsilon
        sound = F.col("pt_id").isNotNull() & (F.size("features") == self.dims) & F.forall("features", lambda v: F.abs(v) <= far)
        for key in self.keys:
            sound = sound & F.col(key).isNotNull()
        if "t" in points.columns:
            sound = sound & F.coalesce(F.abs(F.col("t").cast("double")) <= 1e15, F.lit(True))
        return F.coalesce(sound, F.lit(False))

    def update_run(self, state: DataFrame, points: DataFrame, batch: str = "batch_id") -> DataFrame:
        """The state after all batches of ``points`` in turn, a task for each stream; a row CLASH where ``update`` has to do it."""
        keys, cfg, dims, timed = self.keys, self.config, self.dims, "t" in points.columns
        by, one = (keys, []) if keys else (["__all"], [F.lit(0).alias("__all")])
        t = F.col("t").cast("double") if timed else F.lit(None).cast("double")
        arrived = points.select(
            *keys, *one, "pt_id", F.col("features").cast("array<double>").alias("features"), t.alias("t"), F.col(batch).alias("__b"))
        out = self.state_schema(points)
        columns = out.fieldNames()[len(keys):]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            found = folded(left, right, cfg, dims, timed, RINGS_PER_EPSILON, CLOCK_ID)
            rows, given = len(found["mc_id"]), left if left.num_rows else right
            return pa.table(
                [*[pa.repeat(given[k][0], rows) for k in keys], *[pa.array(found[c], right.schema.field(c).type) for c in columns]],
                names=out.fieldNames())

        return arrived.groupBy(*by).cogroup(state.select(*state.columns, *one).groupBy(*by)).applyInArrow(run, out)

    # --- reading a state ---

    def clusters(self, state: DataFrame) -> DataFrame:
        """Micro-clusters as cluster rows at the stream's current time.

        (keys, mc_id, id, centroid, size, density, status), status active or decayed.
        """
        clock = state.where("status = 'clock'").select(
            *self.keys, F.col("t_last").alias("now"), F.lit(True).alias("ready"), F.lit(False).alias("prune")
        )
        live = self._join_clock(state.where(F.col("status").isin("p", "o")), clock)
        return to_clusters(fade(live, F.col("now"), self.config.decay_factor), self.keys)


def fade(micro_clusters: DataFrame, now: Column, decay: float) -> DataFrame:
    """Sums faded from ``t_last`` to ``now``."""
    factor = decayed_weight(F.lit(1.0), F.col("__now") - F.col("t_last"), decay)
    return micro_clusters.withColumn("__now", now).withColumn("__f", factor).withColumns({
        "w": F.col("w") * F.col("__f"),
        "cf1": F.transform("cf1", lambda v: v * F.col("__f")),
        "cf2": F.transform("cf2", lambda v: v * F.col("__f")),
        "t_last": F.col("__now"),
    }).drop("__f", "__now")


def centre() -> Column:
    return F.transform("cf1", lambda v: v / F.col("w"))


def to_clusters(faded: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    status = F.when(F.col("status") == "p", "active").otherwise("decayed")
    return faded.select(
        *keys, "mc_id", F.concat_ws("-", status, F.col("mc_id").cast("string")).alias("id"),
        centre().alias("centroid"), F.col("n").alias("size"), F.col("w").alias("density"), status.alias("status"),
    )


def run_batches(clusterer: OnlineClusterer, points: DataFrame, first: int, last: int, batch: str = "batch_id") -> DataFrame:
    """State after the batches ``first`` to ``last`` in turn, cut from its lineage.

    Batches of less than RUN_ROWS points a stream are folded in runs of several, each run a job that reads its own folder. Larger
    batches, and points that ``update`` alone can judge (coordinates missing or without bound, no id or key), are taken one by one.
    """
    keys, spark = clusterer.keys, points.sparkSession
    state = clusterer.empty_state(spark, points)
    asked = points.where(F.col(batch).between(first, last))
    most, odd, begun = asked.groupBy(*keys, batch).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~clusterer.plain(points)).alias("odd")
    ).agg(F.max("n"), F.sum("odd"), F.min(batch)).first()
    named = isinstance(points.schema["pt_id"].dataType, T.LongType)
    if not most or most > RUN_ROWS or odd or not named or (begun > first and not keys):
        return _one_by_one(clusterer, state, points, first, last, batch)
    per_run = RUN_ROWS // most
    path = new_path(spark, "runs")
    run = F.floor((F.col(batch) - first) / F.lit(per_run)).cast("bigint")
    asked.withColumn("__run", run).repartition(*keys, "__run").write.partitionBy("__run").parquet(path)
    runs = spark.read.schema(T.StructType([*points.schema.fields, T.StructField("__run", T.LongType())])).parquet(path)
    largest = 0
    for start in range(first, last + 1, per_run):
        here = runs.where(F.col("__run") == (start - first) // per_run).drop("__run")
        new = cut_lineage(clusterer.update_run(state, here, batch)) if largest <= RUN_CLUSTERS else None
        if new is not None and new.where(F.col("status") == CLASH).limit(1).count():
            release(new)
            new = None
        if new is None:
            new = _one_by_one(clusterer, state, here, start, min(last, start + per_run - 1), batch)
        release(state)
        state, largest = new, largest_group(new, keys)
    remove(spark, path)
    return state


def _one_by_one(clusterer: OnlineClusterer, state: DataFrame, points: DataFrame, first: int, last: int, batch: str) -> DataFrame:
    for number in range(first, last + 1):
        state = cut_lineage(clusterer.update(state, points.where(F.col(batch) == number)))
    return state


def macro_clusters(
    clusters: DataFrame, epsilon: float, keys: Sequence[str] = (), group_bound: int | None = None
) -> DataFrame:
    """Clusters with ``macro``: the smallest mc_id reachable over centres at most 2 epsilon apart."""
    keys = list(keys)
    by = keys or ["__all"]
    rows = clusters if keys else clusters.withColumn("__all", F.lit(0))
    centres = rows.select(*by, F.col("mc_id").alias("pt_id"), F.col("centroid").alias("features"))
    edges = mst_edges(centres, by, k=0, group_bound=group_bound).where(F.col("w") <= 2 * epsilon)
    found = components(centres.select(*by, F.col("pt_id").alias("node")), edges, by, group_bound)
    joined = rows.join(found.select(*by, F.col("node").alias("mc_id"), F.col("component").alias("macro")), [*by, "mc_id"])
    return joined if keys else joined.drop("__all")
