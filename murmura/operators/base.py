"""What a clusterer must offer to be driven by the streaming job."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession


@runtime_checkable
class Clusterer(Protocol):
    """State and clusters are DataFrames; nothing is kept in the object between calls."""

    def empty_state(self, spark: SparkSession, like: DataFrame | None = None) -> DataFrame: ...

    def fit(self, batch: DataFrame) -> DataFrame:
        """State after ``batch`` alone."""

    def update(self, state: DataFrame, batch: DataFrame) -> DataFrame:
        """State after ``batch`` on top of ``state``."""

    def clusters(self, state: DataFrame) -> DataFrame:
        """(keys, mc_id, id, centroid, size, density, status)."""
