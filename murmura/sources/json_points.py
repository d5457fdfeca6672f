"""JSON points: batch files written by us or by others, and posted payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.operators.points import to_cluster_points
from murmura.schema import CLUSTER_POINT, DATA_POINT


def save_batches(points: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write data points as JSON lines, one folder per batch. Null fields are kept."""
    points.write.mode(mode).option("ignoreNullFields", False).partitionBy("batch_id").json(path)
    return path


def save_cluster_point_batches(points: DataFrame, path: str, mode: str = "overwrite") -> str:
    """The same, converted to cluster points first."""
    return save_batches(to_cluster_points(points), path, mode)


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType = DATA_POINT, multi_line: bool = False
) -> DataFrame:
    """Saved batches; ``multi_line`` reads files that hold one JSON array."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_cluster_point_batches(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_batches(spark, path, CLUSTER_POINT, multi_line)


def posted_points(payloads: DataFrame, column: str = "payload", schema: T.StructType = CLUSTER_POINT) -> DataFrame:
    """Strict form of posted batches ``{"points": [...]}``: typed fields, one row per entry."""
    fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields)
    body = F.from_json(F.col(column), f"points array<struct<{fields}>>")
    return payloads.select(F.explode(body["points"]).alias("__p")).select("__p.*")

