"""Registered queries: what is written to sinks and streams, read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions.durable import new_path
from murmura.operators import quality as Q
from murmura.plans.basic import DATA_SQL, _data_points
from murmura.plans.quality import r6, silhouette_sql
from murmura.plans.registry import query
from murmura.plans.views import BATCH, PTS, featured, pts
from murmura.sources import json_points as J
from murmura.sources import sinks
from murmura.streaming.replay import read_replay, write_replay

# Batches taken by one trigger of the replayed stream.
PER_TRIGGER = 25


@query("points_json_sink", f"WITH {DATA_SQL} SELECT x, y, round(timestamp, 6) AS timestamp, cluster_id, batch_id, noise FROM dp")
def _points_json_sink(spark, sf):
    path = J.save_batches(_data_points(spark, sf).drop("pt_id"), new_path(spark, "points"))
    return J.read_batches(spark, path).select("x", "y", r6("timestamp"), "cluster_id", "batch_id", "noise")


@query("cluster_points_json_sink", f"WITH {DATA_SQL} SELECT x, y, CAST(cluster_id AS VARCHAR) AS cluster_id, CAST(1 AS DOUBLE) AS weight, batch_id, noise FROM dp")
def _cluster_points_json_sink(spark, sf):
    path = J.save_cluster_point_batches(_data_points(spark, sf), new_path(spark, "cluster-points"))
    return J.read_cluster_point_batches(spark, path).select("x", "y", "cluster_id", "weight", "batch_id", "noise")


@query("metrics_history", f"""WITH {PTS}, {silhouette_sql('pts', 'label <> -1')}, h AS (SELECT 'offline' AS model_name, batch_id, count(*) AS n_samples,
count(DISTINCT CASE WHEN label <> -1 THEN label END) AS number_of_clusters, round(avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_ratio,
epoch_us(max(ts)) AS ts_us FROM pts GROUP BY 2)
SELECT h.*, round(silhouette_score, 6) AS silhouette_score FROM h LEFT JOIN sil ON h.batch_id = sil.batch_id""")
def _metrics_history(spark, sf):
    """Records appended by model, in one partition per model; writing them again replaces them."""
    path = new_path(spark, "metrics")
    metrics = Q.batch_metrics(featured(pts(spark, sf)), "offline", group_bound=BATCH)
    for _ in range(2):
        sinks.append_batches(metrics, path, ["model_name"])
    return sinks.read_metrics(spark, path, "offline").select(
        "model_name", "batch_id", "n_samples", "number_of_clusters", r6("noise_ratio"), F.unix_micros("ts").alias("ts_us"),
        r6("silhouette_score"),
    )


@query("replay_stream", f"""WITH {PTS} SELECT batch_id, count(*) AS n_samples, min(pt_id) AS first_id, max(pt_id) AS last_id,
CAST(floor((batch_id - 1) / {PER_TRIGGER}) AS BIGINT) AS trigger_id FROM pts GROUP BY 1""")
def _replay_stream(spark, sf):
    """The table replayed as a stream, some batches per trigger, in order; statistics per batch."""
    root = new_path(spark, "replay")
    write_replay(pts(spark, sf).select("pt_id", "batch_id"), f"{root}/in", PER_TRIGGER)
    schema = T.StructType([T.StructField("pt_id", T.LongType()), T.StructField("batch_id", T.LongType())])

    def summarise(batch, epoch):
        batch.coalesce(1).groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("n_samples"), F.min("pt_id").alias("first_id"), F.max("pt_id").alias("last_id")
        ).withColumn("trigger_id", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    # A trigger is one file of PER_TRIGGER batches of BATCH points, so its sums need no other task.
    stream = read_replay(spark, f"{root}/in", schema)
    stream.writeStream.foreachBatch(summarise).option("checkpointLocation", f"{root}/check").trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("epoch")
