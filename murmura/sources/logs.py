"""Structured logs: JSON lines of the log sink, and log payloads as typed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions.scalar import as_float, as_id, as_int, as_str
from murmura.schema import LOG_LINE


def flatten_log_lines(lines: DataFrame) -> DataFrame:
    """(timestamp, level, message, extra) of serialised log lines."""
    record = F.col("record")
    return lines.where(record.isNotNull()).select(
        record["time"]["repr"].alias("timestamp"),
        record["level"]["name"].alias("level"),
        record["message"].alias("message"),
        record["extra"].alias("extra"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return flatten_log_lines(spark.read.schema(LOG_LINE).json(path))


def stream_logs(spark: SparkSession, path: str) -> DataFrame:
    return flatten_log_lines(spark.readStream.schema(LOG_LINE).json(path))


def log_records(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Log payloads as typed rows. Missing keys and payloads that are no object give NULLs."""
    v = F.try_parse_json(F.col(payload))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    fields = {
        "timestamp": as_str, "batch_id": as_id, "model_name": as_str, "active_clusters": as_int,
        "noise_ratio": as_float, "silhouette_score": as_float, "drift_magnitude": as_float,
        "latency_ms": as_float, "message": as_str,
    }

    def typed(name: str, coerce):
        value = coerce(v, f"$.{name}", numeric_text=False) if coerce is as_int else coerce(v, f"$.{name}")
        return F.when(is_object, value).alias(name)

    return df.select(
        *keep, *[typed(n, c) for n, c in fields.items()],
        F.when(is_object, F.col(payload)).otherwise(F.lit("{}")).alias("raw"),
    )
