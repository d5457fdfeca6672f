"""Trip tables: CSV or Parquet by file suffix, always with a fixed schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from murmura.functions.ordering import ROWS_PER_BUCKET, fixed_batches
from murmura.operators.points import clean_trips, to_cluster_points, trips_to_points
from murmura.schema import TRIP, TRIP_COLUMNS


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """Trips of a file or folder; a ``.parquet`` suffix is read as Parquet, the rest as CSV.

    A CSV file is read whole by its header, so columns may come in any order and others may
    be there; what cannot be parsed becomes NULL.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select(*TRIP_COLUMNS)
    header = spark.read.option("header", True).csv(path)
    types = {f.name: f.dataType for f in TRIP.fields}
    return header.select(*[header[c].try_cast(types[c]).alias(c) for c in TRIP_COLUMNS])


def trip_batches(
    trips: DataFrame,
    batch_size: int = 500,
    tie_break: Sequence[str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Clean trips as data points in chronological batches, numbered from 1.

    Equal times are ordered by the other trip columns; rows equal in all of them are
    interchangeable. ``tie_break`` names other columns of ``trips`` to order by after the time.
    """
    extra = list(tie_break or ())
    kept = trips.select(*TRIP_COLUMNS, *extra).na.drop("any", subset=TRIP_COLUMNS)
    kept = kept.withColumn("tpep_pickup_datetime", kept["tpep_pickup_datetime"].cast("timestamp"))
    order = ["tpep_pickup_datetime", *(extra or TRIP_COLUMNS[1:])]
    return trips_to_points(fixed_batches(kept, batch_size, order, rows_per_bucket=rows_per_bucket))


def trip_cluster_points(trips: DataFrame, batch_size: int = 500, tie_break: Sequence[str] | None = None) -> DataFrame:
    return to_cluster_points(trip_batches(trips, batch_size, tie_break))


__all__ = ["clean_trips", "read_trips", "trip_batches", "trip_cluster_points"]
