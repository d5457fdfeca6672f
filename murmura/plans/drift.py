"""Registered queries: lifecycle, drift and histories over the snapshot view."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.functions.durable import new_path
from murmura.operators import drift as D
from murmura.operators import history as H
from murmura.plans.quality import r6
from murmura.plans.registry import query
from murmura.plans.views import CLUSTERS, PTS, SNAP, clusters, featured, pts, snapshots
from murmura.streaming.drift_stream import track_drift
from murmura.streaming.replay import read_replay, write_replay

ALPHA = 0.3


def xy(name: str, out: str):
    return [F.round(F.get(name, F.lit(i)), 6).alias(f"{out}_{c}") for i, c in enumerate("xy")]


def id_list(name: str):
    return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)


# Lifecycle rows of the snapshot view up to its last step.
LIFE = SNAP + """,
life AS (SELECT coalesce(c.step, p.step + 1) AS step, coalesce(c.cluster_id, p.cluster_id) AS cluster_id,
                c.cx, c.cy, p.cx AS px, p.cy AS py,
                CASE WHEN p.step IS NULL THEN 'appeared' WHEN c.step IS NULL THEN 'disappeared' ELSE 'stable' END AS state
         FROM snap c FULL JOIN snap p ON c.step = p.step + 1 AND c.cluster_id = p.cluster_id),
moves AS (SELECT *, CASE WHEN state = 'stable' THEN sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) END AS distance
          FROM life WHERE step <= (SELECT max(step) FROM snap)),
-- islands of consecutive steps
alive AS (SELECT *, step - row_number() OVER (PARTITION BY cluster_id ORDER BY step) AS island FROM moves WHERE state <> 'disappeared'),
aged AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, island ORDER BY step) AS age FROM alive)"""

FOLD = LIFE + f""",
runs AS (SELECT cluster_id, island, list(distance ORDER BY step) AS ds,
                list(CASE WHEN distance > 0 THEN (cx - px) / distance END ORDER BY step) AS ux,
                list(CASE WHEN distance > 0 THEN (cy - py) / distance END ORDER BY step) AS uy
         FROM aged GROUP BY 1, 2),
ema AS (SELECT a.*,
    CASE WHEN age >= 2 THEN list_reduce(ds[2:age], lambda acc, d: CAST({ALPHA} AS DOUBLE) * d + CAST({1 - ALPHA} AS DOUBLE) * acc) END AS ema_distance,
    CASE WHEN age >= 2 THEN list_reduce(list_concat([CAST(0 AS DOUBLE)], list_filter(ux[2:age], lambda u: u IS NOT NULL)),
        lambda acc, u: CAST({ALPHA} AS DOUBLE) * u + CAST({1 - ALPHA} AS DOUBLE) * acc) ELSE 0 END AS ex,
    CASE WHEN age >= 2 THEN list_reduce(list_concat([CAST(0 AS DOUBLE)], list_filter(uy[2:age], lambda u: u IS NOT NULL)),
        lambda acc, u: CAST({ALPHA} AS DOUBLE) * u + CAST({1 - ALPHA} AS DOUBLE) * acc) ELSE 0 END AS ey
    FROM aged a JOIN runs r ON a.cluster_id = r.cluster_id AND a.island = r.island)"""


@query("lifecycle", f"WITH {LIFE} SELECT step, cluster_id, state FROM moves")
def _lifecycle(spark, sf):
    return D.displacements(snapshots(spark, sf), dims=2).select("step", "cluster_id", "state")


@query("drift_prev", f"WITH {LIFE} SELECT step, cluster_id, round(px, 6) AS prev_x, round(py, 6) AS prev_y FROM moves WHERE state <> 'disappeared'")
def _drift_prev(spark, sf):
    moved = D.displacements(snapshots(spark, sf), dims=2).where("state <> 'disappeared'")
    return moved.select("step", "cluster_id", *xy("previous", "prev"))


@query("drift_distance", f"""WITH {LIFE} SELECT step, cluster_id, round(cx - px, 6) AS displacement_x, round(cy - py, 6) AS displacement_y,
round(distance, 6) AS distance, round(CASE WHEN distance > 0 THEN (cx - px) / distance END, 6) AS direction_x,
round(CASE WHEN distance > 0 THEN (cy - py) / distance END, 6) AS direction_y FROM moves WHERE state = 'stable'""")
def _drift_distance(spark, sf):
    moved = D.displacements(snapshots(spark, sf), dims=2).where("state = 'stable'")
    return moved.select("step", "cluster_id", *xy("displacement", "displacement"), r6("distance"), *xy("direction", "direction"))


# Timestamp mode: one snapshot per batch at the time of its last point.
TIMED = PTS + """, st AS (SELECT batch_id AS step, epoch_us(max(ts)) / CAST(1000000 AS DOUBLE) AS ts FROM pts GROUP BY 1),
steps AS (SELECT step, ts, coalesce(ts - lag(ts) OVER (ORDER BY step), CAST(1 AS DOUBLE)) AS dt FROM st),
tsnap AS (SELECT batch_id AS step, label AS cluster_id, avg(x) AS cx, avg(y) AS cy FROM pts WHERE label <> -1 GROUP BY 1, 2)"""


@query("drift_speed", f"""WITH {TIMED} SELECT c.step, c.cluster_id, round(s.dt, 6) AS dt,
round(CASE WHEN s.dt > 0 THEN sqrt((c.cx - p.cx) * (c.cx - p.cx) + (c.cy - p.cy) * (c.cy - p.cy)) / s.dt ELSE 0 END, 6) AS speed
FROM tsnap c JOIN tsnap p ON c.step = p.step + 1 AND c.cluster_id = p.cluster_id JOIN steps s ON c.step = s.step""")
def _drift_speed(spark, sf):
    batches = pts(spark, sf)
    times = batches.groupBy("batch_id").agg((F.unix_micros(F.max("ts")) / F.lit(1e6)).alias("ts"))
    steps = D.number_steps(times)
    centres = batches.where("label <> -1").groupBy(
        F.col("batch_id").alias("step"), F.col("label").alias("cluster_id")
    ).agg(F.array(F.avg("x"), F.avg("y")).alias("centroid"))
    return D.displacements(centres, steps=steps, dims=2).where("state = 'stable'").select(
        "step", "cluster_id", r6("dt"), r6("speed")
    )


@query("cluster_age", f"WITH {LIFE} SELECT step, cluster_id, age, step AS last_seen FROM aged")
def _cluster_age(spark, sf):
    drift = D.per_cluster_drift(snapshots(spark, sf))
    return drift.where("state <> 'disappeared'").select("step", "cluster_id", "age", "last_seen")


@query("ema_distance", f"WITH {FOLD} SELECT step, cluster_id, round(ema_distance, 6) AS ema_distance FROM ema WHERE state = 'stable'")
def _ema_distance(spark, sf):
    drift = D.per_cluster_drift(snapshots(spark, sf), ema_alpha=ALPHA, smooth_direction=False)
    return drift.where("state = 'stable'").select("step", "cluster_id", r6("ema_distance"))


@query("ema_direction", f"""WITH {FOLD} SELECT step, cluster_id,
round(CASE WHEN distance > 0 AND ex * ex + ey * ey > 0 THEN ex / sqrt(ex * ex + ey * ey) END, 6) AS direction_x,
round(CASE WHEN distance > 0 AND ex * ex + ey * ey > 0 THEN ey / sqrt(ex * ex + ey * ey) END, 6) AS direction_y
FROM ema WHERE state = 'stable'""")
def _ema_direction(spark, sf):
    drift = D.per_cluster_drift(snapshots(spark, sf), ema_alpha=ALPHA)
    return drift.where("state = 'stable'").select("step", "cluster_id", *xy("ema_direction", "direction"))


SUMMARY = """SELECT step, round(avg(distance), 6) AS mean_drift_distance, round(max(distance), 6) AS max_drift_distance,
round(avg(distance), 6) AS mean_speed, count(*) FILTER (state = 'appeared') AS num_appeared,
count(*) FILTER (state = 'disappeared') AS num_disappeared, count(*) FILTER (state = 'stable') AS num_stable,
coalesce(string_agg(CAST(cluster_id AS VARCHAR), ',' ORDER BY cluster_id) FILTER (state = 'appeared'), '') AS appeared,
coalesce(string_agg(CAST(cluster_id AS VARCHAR), ',' ORDER BY cluster_id) FILTER (state = 'disappeared'), '') AS disappeared,
coalesce(string_agg(CAST(cluster_id AS VARCHAR), ',' ORDER BY cluster_id) FILTER (state = 'stable'), '') AS stable
FROM moves GROUP BY 1"""


@query("drift_summary", f"WITH {LIFE} {SUMMARY}")
def _drift_summary(spark, sf):
    moved = D.displacements(snapshots(spark, sf), dims=2)
    return D.drift_summary(moved).select(
        "step", r6("mean_drift_distance"), r6("max_drift_distance"), r6("mean_speed"),
        "num_appeared", "num_disappeared", "num_stable", id_list("appeared"), id_list("disappeared"), id_list("stable"),
    )


STATE = FOLD + ", st AS (SELECT * FROM ema WHERE step = (SELECT max(step) FROM snap))"


def _state(spark, sf):
    snaps = snapshots(spark, sf)
    span = D.step_span(snaps)
    return D.drift_state(D.per_cluster_drift(snaps, ema_alpha=ALPHA, span=span), span[1])


@query("drift_state", f"""WITH {STATE} SELECT cluster_id, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, age, step AS last_seen,
round(ema_distance, 6) AS ema_distance, round(ex, 6) AS ema_x, round(ey, 6) AS ema_y FROM st""")
def _drift_state(spark, sf):
    return _state(spark, sf).select(
        "cluster_id", *xy("centroid", "centroid"), "age", "last_seen", r6("ema_distance"), *xy("ema_direction", "ema")
    )


@query("high_drift", f"WITH {STATE} SELECT cluster_id, round(ema_distance, 6) AS ema_distance FROM st WHERE age >= 2 AND ema_distance > 20")
def _high_drift(spark, sf):
    return D.high_drift(_state(spark, sf), distance_threshold=20.0).select("cluster_id", r6("ema_distance"))


UPDATED = f"""WITH {FOLD} SELECT m.step, m.cluster_id, m.state, round(m.distance, 6) AS distance, round(m.distance, 6) AS speed,
e.age, round(CASE WHEN m.state = 'stable' THEN e.ema_distance END, 6) AS ema_distance,
round(CASE WHEN e.distance > 0 AND ex * ex + ey * ey > 0 THEN ex / sqrt(ex * ex + ey * ey) END, 6) AS ema_x,
round(CASE WHEN e.distance > 0 AND ex * ex + ey * ey > 0 THEN ey / sqrt(ex * ex + ey * ey) END, 6) AS ema_y
FROM moves m LEFT JOIN ema e ON m.step = e.step AND m.cluster_id = e.cluster_id AND m.state <> 'disappeared'"""


@query("drift_update", UPDATED)
def _drift_update(spark, sf):
    drift, _ = D.drift_update(snapshots(spark, sf), ema_alpha=ALPHA)
    return drift.select("step", "cluster_id", "state", r6("distance"), r6("speed"), "age", r6("ema_distance"), *xy("ema_direction", "ema"))


# Steps in one trigger of the streamed form.
STEPS = 1000


@query("drift_stream", UPDATED)
def _drift_stream(spark, sf):
    """The same rows from a stream of whole snapshots, empty ones included, with its state between triggers."""
    root = new_path(spark, "drift")
    snaps = snapshots(spark, sf)
    first, last = D.step_span(snaps)
    maps = snaps.groupBy("step").agg(F.map_from_entries(F.collect_list(F.struct("cluster_id", "centroid"))).alias("centroids"))
    steps = spark.range(first, last + 1).select(F.col("id").alias("step"))
    write_replay(steps.join(maps, "step", "left").select(
        F.lit("all").alias("key"), F.col("step").cast("double").alias("ts"), "centroids", F.col("step").alias("seq"),
        (F.floor((F.col("step") - first) / F.lit(STEPS)) + 1).cast("bigint").alias("batch_id")), f"{root}/in")
    stream = read_replay(spark, f"{root}/in", "key string, ts double, centroids map<bigint, array<double>>, seq bigint")
    track_drift(stream, ema_alpha=ALPHA).writeStream.format("parquet").option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select(
        F.col("ts").cast("bigint").alias("step"), "cluster_id", "state", r6("distance"), r6("speed"), "age", r6("ema_distance"),
        *xy("ema_direction", "ema"))


# Histories

@query("last_n", f"""WITH {CLUSTERS} SELECT label, batch_id, size FROM
(SELECT *, row_number() OVER (PARTITION BY label ORDER BY batch_id DESC) AS rn FROM clusters) WHERE rn <= 10""")
def _last_n(spark, sf):
    return H.last_n(clusters(spark, sf).select("label", "batch_id", "size"), 10, ["label"], ["batch_id"])


@query("last_centroid", f"""WITH {SNAP} SELECT cluster_id, round(arg_max(cx, step), 6) AS centroid_x, round(arg_max(cy, step), 6) AS centroid_y,
max(step) AS step FROM snap GROUP BY 1""")
def _last_centroid(spark, sf):
    return H.last_centroids(snapshots(spark, sf)).select("cluster_id", *xy("centroid", "centroid"), "step")


@query("trajectories", f"""WITH {SNAP}, g AS (SELECT * FROM (SELECT DISTINCT step FROM snap) s CROSS JOIN (SELECT DISTINCT cluster_id FROM snap) c)
SELECT g.step, g.cluster_id, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y
FROM g LEFT JOIN snap s ON g.step = s.step AND g.cluster_id = s.cluster_id""")
def _trajectories(spark, sf):
    return H.trajectories(snapshots(spark, sf)).select("step", "cluster_id", *xy("centroid", "centroid"))


@query("id_set_ops", f"""WITH {SNAP}, s AS (SELECT step, list_sort(list(cluster_id)) AS ids FROM snap GROUP BY 1),
j AS (SELECT s.step, s.ids, coalesce(p.ids, []) AS prev FROM s LEFT JOIN s p ON s.step = p.step + 1)
SELECT step, array_to_string(ids, ',') AS ids,
array_to_string(list_filter(ids, lambda i: NOT list_contains(prev, i)), ',') AS appeared,
array_to_string(list_filter(prev, lambda i: NOT list_contains(ids, i)), ',') AS disappeared,
array_to_string(list_filter(ids, lambda i: list_contains(prev, i)), ',') AS stable FROM j""")
def _id_set_ops(spark, sf):
    return H.id_changes(snapshots(spark, sf)).select(
        "step", id_list("ids"), id_list("appeared"), id_list("disappeared"), id_list("stable")
    )


@query("id_union", f"WITH {SNAP} SELECT cluster_id FROM snap UNION SELECT label FROM pts WHERE label <> -1")
def _id_union(spark, sf):
    from_points = pts(spark, sf).where("label <> -1").select(F.col("label").alias("cluster_id"))
    return snapshots(spark, sf).select("cluster_id").union(from_points).distinct()


@query("sorted_ids", f"WITH {PTS} SELECT batch_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS ids FROM (SELECT DISTINCT batch_id, label FROM pts WHERE label <> -1) GROUP BY 1")
def _sorted_ids(spark, sf):
    ids = pts(spark, sf).where("label <> -1").groupBy("batch_id").agg(F.array_sort(F.collect_set("label")).alias("ids"))
    return ids.select("batch_id", id_list("ids"))


@query("centroid_fallback", f"""WITH {CLUSTERS}, model AS (SELECT batch_id, label, cx, cy FROM clusters WHERE status = 'active'),
comp AS (SELECT batch_id, label, avg(x) AS cx, avg(y) AS cy FROM pts WHERE label <> -1 GROUP BY 1, 2)
SELECT batch_id, label, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, 'model' AS origin FROM model
UNION ALL SELECT batch_id, label, round(cx, 6), round(cy, 6), 'points' FROM comp WHERE batch_id NOT IN (SELECT batch_id FROM model)""")
def _centroid_fallback(spark, sf):
    from murmura.operators.quality import centroids

    model = clusters(spark, sf).where("status = 'active'").select("batch_id", "label", "centroid")
    computed = centroids(featured(pts(spark, sf)), dims=2).select("batch_id", "label", "centroid")
    return H.centroid_fallback(model, computed).select("batch_id", "label", *xy("centroid", "centroid"), "origin")
