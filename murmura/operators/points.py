"""Point shaping: trips to points, defaults, labels, features, tolerant parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions.ordering import ordered_index
from murmura.functions.scalar import (
    as_coordinate,
    as_float,
    as_id,
    as_int,
    as_str,
    epoch_seconds,
    grid_cell,
    grid_cluster,
    json_kind,
)
from murmura.schema import CLUSTER_POINT, DATA_POINT, NOISE, TRIP_COLUMNS


def clean_trips(trips: DataFrame) -> DataFrame:
    """Keep the five trip columns and the rows where none is null or NaN."""
    parsed = trips.select(*TRIP_COLUMNS).na.drop("any")
    return parsed.withColumn(
        "tpep_pickup_datetime", F.col("tpep_pickup_datetime").cast("timestamp")
    )


def trips_to_points(trips: DataFrame) -> DataFrame:
    """Trip rows as data points; keeps ``batch_id`` when the input has one."""
    batch = F.col("batch_id") if "batch_id" in trips.columns else F.lit(None)
    return trips.select(
        F.col("pickup_longitude").alias("x"),
        F.col("pickup_latitude").alias("y"),
        epoch_seconds(F.col("tpep_pickup_datetime")).alias("timestamp"),
        grid_cluster(
            grid_cell(F.col("pickup_longitude")), grid_cell(F.col("pickup_latitude"))
        ).alias("cluster_id"),
        F.lit("nyc_taxi").alias("source"),
        batch.cast("bigint").alias("batch_id"),
        F.lit(None).cast("boolean").alias("noise"),
    )


def to_cluster_points(points: DataFrame) -> DataFrame:
    """Data points in the form the clusterers ingest: text id, unit weight."""
    return points.select(
        "x", "y",
        F.col("cluster_id").cast("string").alias("cluster_id"),
        "timestamp",
        F.lit(1.0).alias("weight"),
        "batch_id", "noise",
    )


def _with_defaults(df: DataFrame, schema: T.StructType, defaults: dict[str, Column]) -> DataFrame:
    columns = []
    for field in schema.fields:
        name = field.name
        value = F.col(name).cast(field.dataType) if name in df.columns else F.lit(None).cast(field.dataType)
        columns.append((F.coalesce(value, defaults[name]) if name in defaults else value).alias(name))
    return df.select(*columns)


def fill_data_points(df: DataFrame) -> DataFrame:
    return _with_defaults(df, DATA_POINT, {"source": F.lit("synthetic")})


def fill_cluster_points(df: DataFrame) -> DataFrame:
    return _with_defaults(df, CLUSTER_POINT, {"weight": F.lit(1.0)})


def to_features(df: DataFrame, columns: Sequence[str] = ("x", "y"), out: str = "features") -> DataFrame:
    """Add the feature vector from numeric columns, or from one array column.

    Raises ``TypeError`` while the plan is built when the columns are not numeric.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in columns if c not in types]
    if missing:
        raise TypeError(f"no such feature columns: {missing}")
    if len(columns) == 1 and isinstance(types[columns[0]], T.ArrayType):
        if not isinstance(types[columns[0]].elementType, T.NumericType):
            raise TypeError(f"feature array must hold numbers, got {types[columns[0]].simpleString()}")
        return df.withColumn(out, F.col(columns[0]).cast("array<double>"))
    bad = [c for c in columns if not isinstance(types[c], T.NumericType)]
    if bad:
        raise TypeError(f"feature columns must be numeric: {bad}")
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))


def without_noise(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) != NOISE)


def normalise_labels(df: DataFrame, cluster_id: str = "cluster_id", noise: str = "noise") -> DataFrame:
    """``label``: the id, or -1 where it is missing or the noise flag is set."""
    flagged = F.col(cluster_id).isNull() | F.coalesce(F.col(noise), F.lit(False))
    return df.withColumn(
        "label", F.when(flagged, F.lit(NOISE)).otherwise(F.col(cluster_id)).cast("bigint")
    )


def parse_points(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Posted batches to rows (batch_id, idx, x, y, cluster_id, noise).

    Entries that are no objects, or whose coordinates are no numbers, are skipped; a
    missing coordinate is 0.
    """
    body = F.from_json(F.col(payload), "struct<batch_id variant, points array<variant>>")
    items = df.select(*keep, body.alias("b")).select(
        *keep,
        as_int(F.col("b.batch_id"), "$").alias("batch_id"),
        F.posexplode("b.points").alias("idx", "v"),
    )
    v = F.col("v")
    return (
        items.where(F.schema_of_variant(v).startswith("OBJECT"))
        .select(
            *keep, "batch_id", "idx",
            as_coordinate(v, "$.x").alias("x"),
            as_coordinate(v, "$.y").alias("y"),
            as_int(v, "$.cluster_id").alias("cluster_id"),
            F.coalesce(F.try_variant_get(v, "$.noise", "boolean"), F.lit(False)).alias("noise"),
        )
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def parse_centroids(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Active clusters of a state payload to rows (cluster_id, x, y).

    The id is the position in the list; a centroid that is not a pair of numbers is dropped.
    """
    body = F.from_json(F.col(payload), "struct<active_clusters array<variant>>")
    items = df.select(
        *keep, F.posexplode(body["active_clusters"]).alias("idx", "v")
    )
    v = F.col("v")
    pair = (F.try_variant_get(v, "$.centroid", "array<variant>"))
    return (
        items.where(F.size(pair) == 2)
        .select(
            *keep,
            F.col("idx").cast("bigint").alias("cluster_id"),
            as_float(v, "$.centroid[0]").alias("x"),
            as_float(v, "$.centroid[1]").alias("y"),
        )
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def parse_latest_metrics(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """First model of a latest-metrics payload as one flat row per payload."""
    entries = F.map_entries(
        F.from_json(F.col(payload), "struct<latest map<string, variant>>")["latest"]
    )
    flat = df.select(*keep, F.get(entries, 0).alias("e"))
    v = F.col("e.value")
    return flat.select(
        *keep,
        F.col("e.key").alias("model_name"),
        as_float(v, "$.silhouette_score").alias("silhouette_score"),
        F.when(
            F.coalesce(json_kind(v, "$.number_of_clusters"), F.lit("VOID")) != "VOID",
            as_int(v, "$.number_of_clusters", numeric_text=False),
        ).otherwise(as_int(v, "$.active_clusters", numeric_text=False)).alias("active_clusters"),
        as_float(v, "$.noise_ratio").alias("noise_ratio"),
        as_float(v, "$.drift_magnitude").alias("drift_magnitude"),
        as_id(v, "$.batch_id").alias("batch_id"),
        as_str(v, "$.timestamp").alias("timestamp"),
        as_float(v, "$.latency_ms").alias("latency_ms"),
    )


def cluster_numbers(df: DataFrame, id_column: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """``cluster_num``: digits after the first dash, else the rank among the ids of the group."""
    suffix = F.regexp_extract(F.col(id_column), r"^[^-]*-(\d+)$", 1)
    distinct = df.select(*keys, id_column).distinct()
    unparsed = distinct.where(suffix == "").select(*keys, id_column)
    ranked = ordered_index(distinct, [id_column], key=list(keys), out="__rank")
    fallback = ranked.join(unparsed, [*keys, id_column], "left_semi").select(
        *keys, id_column, (F.col("__rank") - 1).alias("__rank")
    )
    return (
        df.join(fallback, [*keys, id_column], "left")
        .withColumn("cluster_num", F.coalesce(suffix.try_cast("bigint"), F.col("__rank")))
        .drop("__rank")
    )


def centroid_rows(snapshots: DataFrame, column: str = "centroids") -> DataFrame:
    """A ``map<bigint, array<double>>`` of centroids as one row per cluster."""
    rest = [c for c in snapshots.columns if c != column]
    return snapshots.select(*rest, F.explode(column).alias("cluster_id", "__c")).select(
        "cluster_id",
        F.get("__c", 0).alias("x"),
        F.get("__c", 1).alias("y"),
        *rest,
    )


def union_points(clustered: DataFrame, noise: DataFrame) -> DataFrame:
    """Clustered and noise points in one table; noise rows get label -1."""
    flagged = noise.withColumn("label", F.lit(NOISE).cast("bigint"))
    return clustered.unionByName(flagged, allowMissingColumns=True)
