"""The benchmark tables seen as points, snapshots, trips and payloads.

Each view exists twice: as a DataFrame and as a SQL common table expression of the same
name, used by the oracles. Views always cover the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions.ordering import fixed_batches

BATCH = 500
STEP_SECONDS = 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # events.ts is a zone-less timestamp; the views read it as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points without a batch number."""
    kind = F.col("event_type")
    label = (
        F.when(kind == "click", 0).when(kind == "purchase", 1).when(kind == "signup", 2)
        .when(kind == "view", 3).otherwise(-1)
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pt_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        label.cast("bigint").alias("label"),
        "user_id",
    )


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_batches(event_points(spark, sf_dir), BATCH, ["ts", "pt_id"])


def featured(points: DataFrame) -> DataFrame:
    return points.withColumn("features", F.array("x", "y"))


PTS = f"""pts AS (
  SELECT event_id AS pt_id, ts, value AS x,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
         CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2
              WHEN 'view' THEN 3 ELSE -1 END AS BIGINT) AS label,
         user_id,
         CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / {BATCH}) AS BIGINT) + 1 AS batch_id
  FROM events)"""


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids per time step: (step, ts, cluster_id, cx, cy)."""
    step = F.floor(
        (F.unix_seconds("ts") - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")))
        / F.lit(STEP_SECONDS)
    ).cast("bigint")
    return (
        event_points(spark, sf_dir)
        .where(F.col("label") != -1)
        .groupBy(step.alias("step"), F.col("label").alias("cluster_id"))
        .agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``snap`` with the centroid as one array, as the drift operators take it."""
    return snap(spark, sf_dir).select("step", "cluster_id", F.array("cx", "cy").alias("centroid"))


SNAP = PTS + f""", snap AS (
  SELECT CAST(floor(epoch(ts - TIMESTAMP '2024-01-01 00:00:00') / {STEP_SECONDS}) AS BIGINT) AS step,
         label AS cluster_id, avg(x) AS cx, avg(y) AS cy
  FROM pts WHERE label <> -1 GROUP BY 1, 2)"""


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        vec.alias("pt_id"),
        F.floor(vec / F.lit(100)).cast("bigint").alias("batch_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.when(vec % 10 == 0, -1).otherwise(F.col("label")).cast("bigint").alias("label"),
        F.col("label").cast("bigint").alias("truth"),
    )


EMB = """emb AS (
  SELECT vec_id AS pt_id, CAST(floor(vec_id / 100) AS BIGINT) AS batch_id,
         CAST(embedding AS DOUBLE[]) AS features,
         CAST(CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS BIGINT) AS label,
         CAST(label AS BIGINT) AS truth
  FROM embeddings)"""


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = F.lit(-74.25) + (F.col("value") % F.lit(50.0)) / F.lit(100.0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trip_id"),
        F.col("ts").cast("timestamp").alias("tpep_pickup_datetime"),
        F.when(F.col("event_id") % 97 != 0, lon).alias("pickup_longitude"),
        (F.lit(40.5) + F.get_json_object("props", "$.k").cast("double") / F.lit(250.0)).alias("pickup_latitude"),
        (F.col("value") / F.lit(10.0)).alias("trip_distance"),
        F.col("value").alias("total_amount"),
    )


TRIPS = """trips AS (
  SELECT event_id AS trip_id, ts AS tpep_pickup_datetime,
         CASE WHEN event_id % 97 <> 0
              THEN CAST(-74.25 AS DOUBLE) + (value % CAST(50 AS DOUBLE)) / CAST(100 AS DOUBLE) END AS pickup_longitude,
         CAST(40.5 AS DOUBLE) + CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(250 AS DOUBLE) AS pickup_latitude,
         value / CAST(10 AS DOUBLE) AS trip_distance, value AS total_amount
  FROM events),
clean AS (
  SELECT * FROM trips WHERE pickup_longitude IS NOT NULL AND pickup_latitude IS NOT NULL
     AND tpep_pickup_datetime IS NOT NULL AND trip_distance IS NOT NULL AND total_amount IS NOT NULL)"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cluster per batch and label: (batch_id, label, id, cx, cy, centroid, size, density, status)."""
    size = F.count(F.lit(1))
    return (
        pts(spark, sf_dir).where(F.col("label") != -1)
        .groupBy("batch_id", "label")
        .agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), size.alias("size"))
        .withColumn("status", F.when(F.col("size") >= 100, "active").otherwise("decayed"))
        .withColumn("id", F.concat_ws("-", "status", F.col("label").cast("string")))
        .withColumn("centroid", F.array("cx", "cy"))
        .withColumn("density", F.col("size") / F.lit(float(BATCH)))
    )


CLUSTERS = PTS + f""", clusters AS (
  SELECT *, status || '-' || label AS id, size / CAST({BATCH} AS DOUBLE) AS density
  FROM (SELECT *, CASE WHEN size >= 100 THEN 'active' ELSE 'decayed' END AS status
        FROM (SELECT batch_id, label, avg(x) AS cx, avg(y) AS cy, count(*) AS size
              FROM pts WHERE label <> -1 GROUP BY 1, 2)))"""
