"""Registered queries: sources, projections, parsing, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.functions import scalar as S
from murmura.functions import vector as V
from murmura.functions.durable import new_path
from murmura.operators import history as H
from murmura.operators import points as P
from murmura.operators import validate as R
from murmura.operators.quality import batch_metrics
from murmura.plans.quality import r6, silhouette_sql
from murmura.plans.registry import query
from murmura.plans.views import (
    BATCH, CLUSTERS, EMB, PTS, TRIPS, clusters, emb, event_points, featured, pts, table, trips,
)
from murmura.sources import logs as L
from murmura.sources import sinks
from murmura.sources.json_points import posted_points
from murmura.sources.trips import read_trips, trip_batches, trip_cluster_points

UTC_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# --- trips ---------------------------------------------------------------------------------

def _clean_columns(clean):
    return clean.select(
        F.unix_micros("tpep_pickup_datetime").alias("pickup_us"),
        F.round("pickup_longitude", 6).alias("lon"), F.round("pickup_latitude", 6).alias("lat"),
        "trip_distance", "total_amount",
    )


CLEAN_SQL = f"WITH {TRIPS} SELECT epoch_us(tpep_pickup_datetime) AS pickup_us, round(pickup_longitude, 6) AS lon, round(pickup_latitude, 6) AS lat, trip_distance, total_amount FROM clean"


@query("trip_csv", CLEAN_SQL)
def _trip_csv(spark, sf):
    path = new_path(spark, "csv") + "/trips.csv"
    trips(spark, sf).drop("trip_id").write.option("header", True).option(
        "timestampFormat", UTC_TEXT
    ).csv(path)
    return _clean_columns(P.clean_trips(read_trips(spark, path)))


@query("trip_load", f"WITH {TRIPS} SELECT epoch_us(tpep_pickup_datetime) AS pickup_us, round(pickup_longitude, 6) AS lon, round(pickup_latitude, 6) AS lat, trip_distance, total_amount FROM trips")
def _trip_load(spark, sf):
    path = new_path(spark, "trips") + "/trips.parquet"
    trips(spark, sf).write.parquet(path)
    loaded = read_trips(spark, path)
    return loaded.select(
        F.unix_micros("tpep_pickup_datetime").alias("pickup_us"),
        F.round("pickup_longitude", 6).alias("lon"), F.round("pickup_latitude", 6).alias("lat"),
        "trip_distance", "total_amount",
    )


@query("trip_clean", CLEAN_SQL)
def _trip_clean(spark, sf):
    return _clean_columns(P.clean_trips(trips(spark, sf)))


GRID_SQL = """((CAST(trunc(pickup_longitude * 100) AS BIGINT) * 73856093 + CAST(trunc(pickup_latitude * 100) AS BIGINT) * 19349663) % 500 + 500) % 500"""
TRIP_BATCH = f"CAST(floor((row_number() OVER (ORDER BY tpep_pickup_datetime, trip_id) - 1) / {BATCH}) AS BIGINT) + 1"


@query("trip_points", f"""WITH {TRIPS} SELECT round(pickup_longitude, 6) AS x, round(pickup_latitude, 6) AS y,
round(epoch_us(tpep_pickup_datetime) / CAST(1000000 AS DOUBLE), 6) AS timestamp, {GRID_SQL} AS cluster_id, 'nyc_taxi' AS source,
{TRIP_BATCH} AS batch_id, CAST(NULL AS BOOLEAN) AS noise FROM clean""")
def _trip_points(spark, sf):
    points = trip_batches(trips(spark, sf), BATCH, ["trip_id"])
    return points.select(r6("x"), r6("y"), r6("timestamp"), "cluster_id", "source", "batch_id", "noise")


@query("trip_cluster_points", f"""WITH {TRIPS} SELECT round(pickup_longitude, 6) AS x, round(pickup_latitude, 6) AS y,
CAST({GRID_SQL} AS VARCHAR) AS cluster_id, round(epoch_us(tpep_pickup_datetime) / CAST(1000000 AS DOUBLE), 6) AS timestamp,
CAST(1 AS DOUBLE) AS weight, {TRIP_BATCH} AS batch_id, CAST(NULL AS BOOLEAN) AS noise FROM clean""")
def _trip_cluster_points(spark, sf):
    points = trip_cluster_points(trips(spark, sf), BATCH, ["trip_id"])
    return points.select(r6("x"), r6("y"), "cluster_id", r6("timestamp"), "weight", "batch_id", "noise")


@query("fixed_batches", f"WITH {PTS} SELECT batch_id, min(pt_id) AS first_id, max(pt_id) AS last_id, count(*) AS n FROM pts GROUP BY 1")
def _fixed_batches(spark, sf):
    return pts(spark, sf).groupBy("batch_id").agg(
        F.min("pt_id").alias("first_id"), F.max("pt_id").alias("last_id"), F.count(F.lit(1)).alias("n")
    )


@query("grid_cell", f"WITH {TRIPS} SELECT trip_id, CAST(trunc(pickup_longitude * 100) AS BIGINT) AS cell_x, CAST(trunc(pickup_latitude * 100) AS BIGINT) AS cell_y FROM clean")
def _grid_cell(spark, sf):
    return trips(spark, sf).na.drop("any").select(
        "trip_id", S.grid_cell(F.col("pickup_longitude")).alias("cell_x"), S.grid_cell(F.col("pickup_latitude")).alias("cell_y")
    )


@query("grid_cluster", f"WITH {TRIPS} SELECT {GRID_SQL} AS cluster_id, count(*) AS n FROM clean GROUP BY 1")
def _grid_cluster(spark, sf):
    cells = trips(spark, sf).na.drop("any").select(
        S.grid_cluster(S.grid_cell(F.col("pickup_longitude")), S.grid_cell(F.col("pickup_latitude"))).alias("cluster_id")
    )
    return cells.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


# --- points --------------------------------------------------------------------------------

def _data_points(spark, sf):
    """Points in the external form: text ids on some rows missing, noise flagged."""
    noise = F.col("label") == -1
    return pts(spark, sf).select(
        "pt_id", "x", "y", S.epoch_seconds(F.col("ts")).alias("timestamp"),
        F.when(~noise, F.col("label")).alias("cluster_id"), F.lit(None).cast("string").alias("source"),
        "batch_id", F.when(noise, F.lit(True)).alias("noise"),
    )


DATA_SQL = PTS + """, dp AS (SELECT pt_id, x, y, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS timestamp,
 CASE WHEN label <> -1 THEN label END AS cluster_id, batch_id, CASE WHEN label = -1 THEN TRUE END AS noise FROM pts)"""


@query("to_cluster_points", f"WITH {DATA_SQL} SELECT x, y, CAST(cluster_id AS VARCHAR) AS cluster_id, round(timestamp, 6) AS timestamp, CAST(1 AS DOUBLE) AS weight, batch_id, noise FROM dp")
def _to_cluster_points(spark, sf):
    return P.to_cluster_points(_data_points(spark, sf)).withColumn("timestamp", F.round("timestamp", 6))


@query("point_defaults", f"WITH {DATA_SQL} SELECT x, y, round(timestamp, 6) AS timestamp, cluster_id, 'synthetic' AS source, batch_id, noise FROM dp")
def _point_defaults(spark, sf):
    return P.fill_data_points(_data_points(spark, sf)).withColumn("timestamp", F.round("timestamp", 6))


@query("features", f"WITH {PTS} SELECT pt_id, x AS f0, y AS f1, CAST(2 AS BIGINT) AS dims FROM pts")
def _features(spark, sf):
    made = P.to_features(event_points(spark, sf))
    return made.select(
        "pt_id", F.get("features", F.lit(0)).alias("f0"), F.get("features", F.lit(1)).alias("f1"),
        F.size("features").cast("bigint").alias("dims"),
    )


@query("non_noise", f"WITH {PTS} SELECT pt_id, batch_id, label FROM pts WHERE label <> -1")
def _non_noise(spark, sf):
    return P.without_noise(pts(spark, sf)).select("pt_id", "batch_id", "label")


@query("normalise_labels", f"WITH {PTS} SELECT pt_id, label FROM pts")
def _normalise_labels(spark, sf):
    return P.normalise_labels(_data_points(spark, sf)).select("pt_id", "label")


@query("union_points", f"WITH {PTS} SELECT pt_id, label, x FROM pts WHERE label <> -1 UNION ALL SELECT pt_id, -1, x FROM pts WHERE label = -1")
def _union_points(spark, sf):
    points = event_points(spark, sf).select("pt_id", "label", "x")
    return P.union_points(points.where("label <> -1"), points.where("label = -1"))


@query("check_features", f"""WITH {EMB} SELECT batch_id, count(*) AS n_samples, min(len(features)) AS min_dims, max(len(features)) AS max_dims,
count(*) FILTER (label IS NULL) AS unlabelled, min(len(features)) = max(len(features)) AND count(*) FILTER (label IS NULL) = 0 AS ok
FROM emb GROUP BY 1""")
def _check_features(spark, sf):
    return R.feature_check(emb(spark, sf), ["batch_id"])


@query("vector_fns", f"""WITH {EMB}, j AS (SELECT a.pt_id, a.features AS f, b.features AS g FROM emb a JOIN emb b ON b.pt_id = a.pt_id + 1)
SELECT pt_id, round(sqrt(list_sum(list_transform(f, lambda v: v * v))), 6) AS norm, round(list_avg(f), 6) AS mean,
round(list_distance(f, g), 6) AS gap, round(f[1] / sqrt(list_sum(list_transform(f, lambda v: v * v))), 6) AS unit_0,
round(f[1] * CAST(2 AS DOUBLE) - g[1], 6) AS mixed_0 FROM j""")
def _vector_fns(spark, sf):
    left = emb(spark, sf).select("pt_id", "features")
    right = left.select((F.col("pt_id") - 1).alias("pt_id"), F.col("features").alias("g"))
    f, g = F.col("features"), F.col("g")
    return left.join(right, "pt_id").select(
        "pt_id", F.round(V.v_norm(f), 6).alias("norm"), F.round(V.v_mean(f), 6).alias("mean"),
        F.round(V.v_norm(V.v_sub(f, g)), 6).alias("gap"), F.round(F.get(V.v_unit(f), F.lit(0)), 6).alias("unit_0"),
        F.round(F.get(V.v_sub(V.v_scale(f, F.lit(2.0)), g), F.lit(0)), 6).alias("mixed_0"),
    )


@query("iso_ts", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def _iso_ts(spark, sf):
    return table(spark, sf, "events").select("event_id", S.iso_timestamp(F.col("ts")).alias("iso"))


@query("decayed_weight", f"WITH {PTS} SELECT batch_id, round(sum(pow(CAST(2 AS DOUBLE), CAST(-0.01 AS DOUBLE) * (epoch_us(m) - epoch_us(ts)) / CAST(60000000 AS DOUBLE))), 6) AS weight FROM (SELECT *, max(ts) OVER (PARTITION BY batch_id) AS m FROM pts) GROUP BY 1")
def _decayed_weight(spark, sf):
    points = pts(spark, sf)
    ends = points.groupBy("batch_id").agg(F.max("ts").alias("end"))
    minutes = (F.unix_micros("end") - F.unix_micros("ts")) / F.lit(60e6)
    return points.join(ends, "batch_id").groupBy("batch_id").agg(
        F.round(F.sum(S.decayed_weight(F.lit(1.0), minutes, 0.01)), 6).alias("weight")
    )


# --- payloads ------------------------------------------------------------------------------

def _point_payloads(spark, sf):
    """One posted point per payload, with text coordinates, missing and broken fields mixed in."""
    x, y, k = F.col("x").cast("string"), F.col("y").cast("bigint").cast("string"), F.col("pt_id") % 7
    text = (
        F.when(k == 0, F.format_string('{"batch_id": %d, "points": [{"x": %s, "y": "%s", "cluster_id": "%d"}]}', "batch_id", x, y, "label"))
        .when(k == 1, F.format_string('{"batch_id": %d, "points": [{"y": %s, "noise": true}]}', "batch_id", y))
        .when(k == 2, F.format_string('{"batch_id": "b", "points": [{"x": null, "y": %s}, 5]}', y))
        .when(k == 3, F.lit('{"points": "none"}'))
        .when(k == 4, F.format_string('{"points": [{"x": "abc", "y": %s}, {"x": [1], "y": 2}]}', y))
        .otherwise(F.format_string('{"batch_id": %d, "points": [{"x": %s, "y": %s, "cluster_id": %d}]}', "batch_id", x, y, "label"))
    )
    return pts(spark, sf).select("pt_id", text.alias("payload"))


@query("parse_points", f"""WITH {PTS} SELECT pt_id, CASE WHEN pt_id % 7 = 1 THEN CAST(0 AS DOUBLE) ELSE x END AS x, y, batch_id,
CASE WHEN pt_id % 7 = 1 THEN NULL ELSE label END AS cluster_id, pt_id % 7 = 1 AS noise
FROM pts WHERE pt_id % 7 IN (0, 1, 5, 6)""")
def _parse_points(spark, sf):
    return P.parse_points(_point_payloads(spark, sf), keep=["pt_id"]).drop("idx")


@query("points_from_json", f"""WITH {PTS} SELECT pt_id AS timestamp_id, x, y, CAST(label AS VARCHAR) AS cluster_id, batch_id FROM pts""")
def _points_from_json(spark, sf):
    body = F.struct(F.array(F.struct(
        "x", "y", F.col("label").cast("string").alias("cluster_id"), F.col("pt_id").cast("double").alias("timestamp"), "batch_id"
    )).alias("points"))
    payloads = pts(spark, sf).select(F.to_json(body).alias("payload"))
    return posted_points(payloads).select(
        F.col("timestamp").cast("bigint").alias("timestamp_id"), "x", "y", "cluster_id", "batch_id"
    )


@query("coerce", """SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN value END AS as_float,
CASE WHEN event_id % 3 <> 1 THEN CAST(trunc(value) AS BIGINT) END AS as_int, CAST(value AS VARCHAR) AS as_str,
CASE WHEN event_id % 3 = 1 THEN CAST(value AS VARCHAR) END AS as_id FROM events""")
def _coerce(spark, sf):
    number = F.col("value").cast("string")
    quoted = F.format_string('{"v": "%s"}', number)
    payload = F.when(F.col("event_id") % 3 == 1, quoted).otherwise(F.format_string('{"v": %s}', number))
    v = F.col("v")
    return table(spark, sf, "events").select("event_id", F.try_parse_json(payload).alias("v")).select(
        "event_id", S.as_float(v, "$.v").alias("as_float"),
        S.as_int(v, "$.v", numeric_text=False).alias("as_int"),
        # A number's text may be written in more than one way, so it is read and written once more.
        S.as_str(v, "$.v").cast("double").cast("string").alias("as_str"),
        S.as_id(v, "$.v").alias("as_id"),
    )


def _stats_payloads(spark, sf):
    """Log payloads of the batches, every third without most fields, every fifth no object."""
    sizes = pts(spark, sf).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("x").alias("latency_ms"), F.max("ts").alias("ts"),
        F.avg((F.col("label") == -1).cast("double")).alias("noise_ratio"),
        F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("active_clusters"),
    )
    full = F.to_json(F.struct(
        S.iso_timestamp(F.col("ts")).alias("timestamp"), F.lit("batch processed").alias("message"), "batch_id",
        F.lit("online").alias("model_name"), "active_clusters", F.round("noise_ratio", 6).alias("noise_ratio"),
        F.round("latency_ms", 6).alias("latency_ms"), F.lit(0.5).alias("silhouette_score"),
        (F.round("noise_ratio", 6) * 2).alias("drift_magnitude"),
    ))
    return sizes.select(
        "batch_id", F.when(F.col("batch_id") % 5 == 0, F.lit("[1, 2]"))
        .when(F.col("batch_id") % 3 == 0, F.lit('{"message": "only text", "noise_ratio": "x"}')).otherwise(full).alias("payload")
    )


STATS = PTS + """, st AS (SELECT batch_id, count(*) AS n_samples, avg(x) AS latency_ms, max(ts) AS ts,
 avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END) AS noise_ratio, count(DISTINCT CASE WHEN label <> -1 THEN label END) AS active_clusters FROM pts GROUP BY 1),
lr AS (SELECT batch_id AS idx, batch_id % 5 <> 0 AND batch_id % 3 <> 0 AS ok, batch_id % 5 <> 0 AS obj, * FROM st),
logs AS (SELECT idx, CASE WHEN ok THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp,
  CASE WHEN ok THEN CAST(batch_id AS VARCHAR) END AS batch_id, CASE WHEN ok THEN 'online' END AS model_name,
  CASE WHEN ok THEN active_clusters END AS active_clusters, CASE WHEN ok THEN round(noise_ratio, 6) END AS noise_ratio,
  CASE WHEN ok THEN round(latency_ms, 6) END AS latency_ms, CASE WHEN ok THEN CAST(0.5 AS DOUBLE) END AS silhouette_score,
  CASE WHEN ok THEN round(noise_ratio, 6) * 2 END AS drift_magnitude, CASE WHEN obj THEN 'as sent' ELSE '{}' END AS raw,
  CASE WHEN ok THEN 'batch processed' WHEN obj THEN 'only text' END AS message FROM lr)"""


def _logs(spark, sf):
    return L.log_records(_stats_payloads(spark, sf).withColumnRenamed("batch_id", "idx"), keep=["idx"])


@query("log_records", f"WITH {STATS} SELECT * FROM logs")
def _log_records(spark, sf):
    sent = _stats_payloads(spark, sf).withColumnRenamed("batch_id", "idx")
    return L.log_records(sent, keep=["idx", "payload"]).withColumn(
        "raw", F.when(F.col("raw") == F.col("payload"), "as sent").otherwise(F.col("raw"))
    ).drop("payload")


@query("log_timeline", f"WITH {STATS} SELECT coalesce(timestamp, batch_id, CAST(idx AS VARCHAR)) AS x, noise_ratio AS value FROM logs WHERE noise_ratio IS NOT NULL")
def _log_timeline(spark, sf):
    return H.timeline(_logs(spark, sf), "noise_ratio")


@query("recent_logs", f"WITH {STATS} SELECT idx, timestamp, message FROM logs ORDER BY timestamp DESC NULLS LAST, idx DESC LIMIT 200")
def _recent_logs(spark, sf):
    return H.recent_logs(_logs(spark, sf).select("idx", "timestamp", "message"), 200, ["timestamp", "idx"])


@query("log_read", """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, 'INFO' AS level, event_type AS message,
CAST(value AS VARCHAR) AS value FROM events""")
def _log_read(spark, sf):
    path = new_path(spark, "logs")
    line = F.to_json(F.struct(
        F.lit("line").alias("text"),
        F.struct(
            F.struct(S.iso_timestamp(F.col("ts")).alias("repr"), S.epoch_seconds(F.col("ts")).alias("timestamp")).alias("time"),
            F.struct(F.lit("INFO").alias("name")).alias("level"), F.col("event_type").alias("message"),
            F.create_map(F.lit("value"), F.col("value").cast("string")).alias("extra"),
        ).alias("record"),
    ))
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.select(line.alias("value")).write.mode("overwrite").text(path)
    return L.read_logs(spark, path).select("timestamp", "level", "message", F.col("extra")["value"].alias("value"))


@query("parse_metrics", f"""WITH {STATS} SELECT batch_id AS idx, 'online' AS model_name, round(noise_ratio, 6) AS noise_ratio,
active_clusters, CAST(batch_id AS VARCHAR) AS batch_id,
CASE WHEN batch_id % 3 <> 0 THEN CAST(active_clusters AS DOUBLE) / 8 END AS silhouette_score,
CASE WHEN batch_id > 0 THEN CAST(batch_id AS DOUBLE) / 4 END AS drift_magnitude,
'batch ' || CAST(batch_id AS VARCHAR) AS timestamp, CAST(active_clusters AS DOUBLE) + 0.5 AS latency_ms FROM st""")
def _parse_metrics(spark, sf):
    stats = pts(spark, sf).groupBy("batch_id").agg(
        F.avg((F.col("label") == -1).cast("double")).alias("noise_ratio"),
        F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("c"),
    )
    odd = F.col("batch_id") % 2 == 1
    record = F.struct(
        F.round("noise_ratio", 6).alias("noise_ratio"), F.when(odd, F.col("c")).alias("number_of_clusters"),
        F.when(~odd, F.col("c")).alias("active_clusters"), "batch_id",
        F.when(F.col("batch_id") % 3 != 0, F.col("c") / 8).alias("silhouette_score"),
        F.when(F.col("batch_id") > 0, F.col("batch_id") / 4).alias("drift_magnitude"),
        F.concat(F.lit("batch "), F.col("batch_id").cast("string")).alias("timestamp"), (F.col("c") + F.lit(0.5).cast("double")).alias("latency_ms"),
    )
    payload = F.to_json(F.struct(F.create_map(F.lit("online"), record).alias("latest")), {"ignoreNullFields": "false"})
    return P.parse_latest_metrics(stats.select(F.col("batch_id").alias("idx"), payload.alias("payload")), keep=["idx"])


@query("parse_centroids", f"""WITH {CLUSTERS}, r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY label) - 1 AS pos FROM clusters)
SELECT batch_id, pos AS cluster_id, round(cx, 6) AS x, round(cy, 6) AS y FROM r WHERE label <> 2""")
def _parse_centroids(spark, sf):
    pair = F.when(F.col("label") != 2, F.array(F.round("cx", 6), F.round("cy", 6))).otherwise(F.array(F.round("cx", 6)))
    states = clusters(spark, sf).groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("label", pair.alias("centroid")))).alias("active_clusters")
    )
    payloads = states.select("batch_id", F.to_json(F.struct("active_clusters")).alias("payload"))
    return P.parse_centroids(payloads, keep=["batch_id"])


# --- records -------------------------------------------------------------------------------

@query("validate_clusters", f"""WITH {CLUSTERS}, c AS (SELECT batch_id, label, CASE WHEN label = 1 THEN -size ELSE size END AS size,
CASE WHEN label = 2 THEN 'gone' ELSE status END AS status, CASE WHEN label = 3 THEN -density ELSE density END AS density FROM clusters)
SELECT batch_id, label, concat_ws(',', CASE WHEN size < 0 THEN 'size_negative' END, CASE WHEN density < 0 THEN 'density_negative' END,
CASE WHEN status NOT IN ('active', 'decayed') THEN 'status_unknown' END) AS reason FROM c""")
def _validate_clusters(spark, sf):
    broken = clusters(spark, sf).withColumns({
        "size": F.when(F.col("label") == 1, -F.col("size")).otherwise(F.col("size")),
        "status": F.when(F.col("label") == 2, "gone").otherwise(F.col("status")),
        "density": F.when(F.col("label") == 3, -F.col("density")).otherwise(F.col("density")),
        "points": F.array().cast("array<double>"),
    })
    return R.check_rows(broken, R.cluster_rules()).select("batch_id", "label", F.array_join("reason", ",").alias("reason"))


@query("sane_centroids", f"WITH {CLUSTERS} SELECT batch_id, label AS cluster_id, round(cx, 6) AS cx FROM clusters WHERE label <> 2")
def _sane_centroids(spark, sf):
    odd = F.when(F.col("label") == 2, F.lit(float("nan"))).otherwise(F.col("cy"))
    rows = clusters(spark, sf).select(
        "batch_id", F.col("label").cast("string").alias("cluster_id"), F.array("cx", odd).alias("centroid")
    )
    kept = R.sane_centroids(rows, strict=False)
    return kept.select("batch_id", "cluster_id", F.round(F.get("centroid", F.lit(0)), 6).alias("cx"))


@query("cluster_id_num", f"""WITH {CLUSTERS}, c AS (SELECT batch_id, CASE WHEN label = 0 THEN 'base' WHEN label = 1 THEN 'main' ELSE id END AS id FROM clusters),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY id) - 1 AS rk FROM c)
SELECT batch_id, id, CASE WHEN contains(id, '-') THEN CAST(split_part(id, '-', 2) AS BIGINT) ELSE rk END AS cluster_num FROM r""")
def _cluster_id_num(spark, sf):
    named = clusters(spark, sf).select(
        "batch_id", F.when(F.col("label") == 0, "base").when(F.col("label") == 1, "main").otherwise(F.col("id")).alias("id")
    )
    return P.cluster_numbers(named, "id", ["batch_id"])


@query("cluster_names", f"WITH {CLUSTERS} SELECT batch_id, status || '-' || label AS name, size FROM clusters")
def _cluster_names(spark, sf):
    return clusters(spark, sf).select("batch_id", S.cluster_name(F.col("status"), F.col("label")).alias("name"), "size")


@query("centroid_rows", f"WITH {CLUSTERS} SELECT batch_id, label AS cluster_id, round(cx, 6) AS x, round(cy, 6) AS y FROM clusters")
def _centroid_rows(spark, sf):
    maps = clusters(spark, sf).groupBy("batch_id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "centroid"))).alias("centroids")
    )
    return P.centroid_rows(maps).select("batch_id", "cluster_id", r6("x"), r6("y"))


@query("batch_stats", f"""WITH {CLUSTERS}, m AS (SELECT batch_id, count(*) AS n_samples, avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END) AS noise_ratio, max(ts) AS ts FROM pts GROUP BY 1),
a AS (SELECT batch_id, count(*) AS active_clusters, avg(density) AS avg_density FROM clusters WHERE status = 'active' GROUP BY 1)
SELECT 'clustering_batch' AS event, 'online' AS model_name, m.batch_id, n_samples, round(noise_ratio, 6) AS noise_ratio,
epoch_us(ts) AS ts_us, coalesce(active_clusters, 0) AS active_clusters, round(avg_density, 6) AS avg_density FROM m LEFT JOIN a ON m.batch_id = a.batch_id""")
def _batch_stats(spark, sf):
    metrics = batch_metrics(featured(pts(spark, sf)), "online", group_bound=BATCH).drop("silhouette_score")
    stats = sinks.batch_statistics(metrics, clusters(spark, sf))
    return stats.select(
        "event", "model_name", "batch_id", "n_samples", r6("noise_ratio"), F.unix_micros("ts").alias("ts_us"),
        "active_clusters", r6("avg_density"),
    )


@query("batch_metadata", f"WITH {PTS} SELECT batch_id, epoch_us(max(ts)) AS ts_us, count(*) AS n_samples FROM pts GROUP BY 1")
def _batch_metadata(spark, sf):
    return sinks.batch_metadata(pts(spark, sf)).select("batch_id", F.unix_micros("ts").alias("ts_us"), "n_samples")


def _two_models(spark, sf):
    """Given labels against labels from a 10-unit grid over y, as two models."""
    points = featured(pts(spark, sf))
    coarse = points.withColumn("label", F.floor(F.col("y") / F.lit(25)).cast("bigint"))
    return batch_metrics(points, "online", group_bound=BATCH).unionByName(
        batch_metrics(coarse, "offline", group_bound=BATCH)
    )


MODELS = PTS + f""", coarse AS (SELECT pt_id, ts, x, y, CAST(floor(y / 25) AS BIGINT) AS label, batch_id FROM pts),
{silhouette_sql('pts', 'label <> -1')}, {silhouette_sql('coarse', 'label <> -1', name='coarse_')},
m AS (SELECT 'online' AS model_name, c.*, silhouette_score FROM (SELECT batch_id, max(ts) AS ts, count(*) AS n_samples, count(DISTINCT CASE WHEN label <> -1 THEN label END) AS number_of_clusters,
 avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END) AS noise_ratio FROM pts GROUP BY 1) c LEFT JOIN sil ON c.batch_id = sil.batch_id
 UNION ALL SELECT 'offline', c.*, silhouette_score FROM (SELECT batch_id, max(ts), count(*) AS n_samples, count(DISTINCT label) AS number_of_clusters,
 CAST(0 AS DOUBLE) AS noise_ratio FROM coarse GROUP BY 1) c LEFT JOIN coarse_sil ON c.batch_id = coarse_sil.batch_id)"""


@query("latest_metrics", f"""WITH {MODELS} SELECT model_name, batch_id, n_samples, number_of_clusters, round(noise_ratio, 6) AS noise_ratio,
round(silhouette_score, 6) AS silhouette_score FROM m WHERE batch_id = (SELECT max(batch_id) FROM pts)""")
def _latest_metrics(spark, sf):
    return sinks.latest_metrics(_two_models(spark, sf)).select(
        "model_name", "batch_id", "n_samples", "number_of_clusters", r6("noise_ratio"), r6("silhouette_score")
    )


@query("model_compare", f"""WITH {MODELS} SELECT a.batch_id, a.n_samples AS online_n_samples, a.number_of_clusters AS online_number_of_clusters,
round(a.noise_ratio, 6) AS online_noise_ratio, round(a.silhouette_score, 6) AS online_silhouette_score,
b.n_samples AS offline_n_samples, b.number_of_clusters AS offline_number_of_clusters, round(b.noise_ratio, 6) AS offline_noise_ratio,
round(b.silhouette_score, 6) AS offline_silhouette_score
FROM m a JOIN m b ON a.batch_id = b.batch_id AND a.model_name = 'online' AND b.model_name = 'offline'""")
def _model_compare(spark, sf):
    wide = H.model_compare(_two_models(spark, sf), ["online", "offline"])
    rounded = [r6(c) if c.endswith(("_ratio", "_score")) else c for c in wide.columns]
    return wide.select(*rounded)
