"""Row types. ``points`` is the canonical table every clustering operator takes.

``label`` is always bigint and -1 means noise; textual cluster ids only exist in
the cluster-point form. Timestamps of the external forms are epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import types as T

NOISE = -1

DATA_POINT = T.StructType([
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("cluster_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("noise", T.BooleanType()),
])

CLUSTER_POINT = T.StructType([
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("cluster_id", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("noise", T.BooleanType()),
])

CLUSTER = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("centroid", T.ArrayType(T.DoubleType())),
    T.StructField("size", T.LongType()),
    T.StructField("density", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("points", T.ArrayType(CLUSTER_POINT)),
])

TRIP = T.StructType([
    T.StructField("tpep_pickup_datetime", T.TimestampType()),
    T.StructField("pickup_longitude", T.DoubleType()),
    T.StructField("pickup_latitude", T.DoubleType()),
    T.StructField("trip_distance", T.DoubleType()),
    T.StructField("total_amount", T.DoubleType()),
])
TRIP_COLUMNS = [f.name for f in TRIP.fields]

METRICS = T.StructType([
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("n_samples", T.LongType()),
    T.StructField("number_of_clusters", T.LongType()),
    T.StructField("noise_ratio", T.DoubleType()),
    T.StructField("silhouette_score", T.DoubleType()),
])

# One JSON object per line as written by the structured log sink.
LOG_LINE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("record", T.StructType([
        T.StructField("time", T.StructType([
            T.StructField("repr", T.StringType()),
            T.StructField("timestamp", T.DoubleType()),
        ])),
        T.StructField("level", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("message", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ])),
])

CLUSTER_STATUSES = ("active", "decayed")
