"""Streaming update of an online model with per-batch metrics.

Every micro-batch reads state version N - 1 and writes version N into a folder of its own, as do
metrics and statistics, so a retried micro-batch overwrites its own output and nothing is
counted twice. The configuration is part of the state path: a job with another configuration starts from
an empty state, one with an earlier configuration finds its state again; ``configure`` always begins anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from murmura.functions.durable import folder_names, remove
from murmura.operators.assign import nearest_centroid
from murmura.operators.base import Clusterer
from murmura.operators.clusters import with_status
from murmura.operators.online import OnlineClusterer, OnlineConfig
from murmura.operators.quality import batch_metrics
from murmura.sources.sinks import append_batches, append_metrics, batch_statistics

Sink = Callable[[DataFrame, int], None]
TRIMMED = "trimmed"


class OnlineJob:
    """Drives a clusterer over a stream of points (keys, pt_id, features)."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        config: OnlineConfig | None = None,
        factory: Callable[[OnlineConfig], Clusterer] | None = None,
        keys: Sequence[str] = (),
        model_name: str = "online",
        metrics_sink: Sink | None = None,
        dims: int = 2,
        keep_versions: int = 3,
    ) -> None:
        """``dims`` is the length of the points; the latest ``keep_versions`` states stay, so that a micro-batch can be repeated."""
        if keep_versions < 2:
            raise ValueError("keep_versions must be 2 at least: a repeated micro-batch starts from the state before it")
        self.spark, self.root, self.keys, self.model_name = spark, root, list(keys), model_name
        self.config = config or OnlineConfig()
        self.factory = factory or (lambda cfg: OnlineClusterer(cfg, keys, dims))
        self.keep_versions = keep_versions
        self.clusterer = self.factory(self.config)
        self.metrics_sink = metrics_sink or (lambda df, _: append_metrics(df, f"{root}/metrics"))

    # --- configuration and state versions ---

    def configure(self, **changes: float | int | None) -> dict[str, float | int]:
        """Apply known settings; any change builds a new clusterer on an empty state."""
        changed = self.config.configured(**changes)
        if changed != self.config:
            self.config = changed
            self.clusterer = self.factory(changed)
            self.reset()
        return self.config.to_dict()

    def reset(self) -> None:
        """Start over from an empty state, for later jobs on the same root too."""
        self.spark.range(0).write.mode("overwrite").parquet(f"{self._config_root}/run={self.run + 1}/begun")

    @property
    def run(self) -> int:
        """How often this configuration began anew: the latest marker below the root."""
        return max((int(n[len("run="):]) for n in folder_names(self.spark, self._config_root) if n.startswith("run=")), default=0)

    @property
    def _config_root(self) -> str:
        text = json.dumps(self.config.to_dict(), sort_keys=True)
        return f"{self.root}/state/config={hashlib.sha256(text.encode()).hexdigest()[:16]}"

    @property
    def state_root(self) -> str:
        return f"{self._config_root}/run={self.run}"

    def _versions(self) -> list[int]:
        """Finished state versions; the file system is asked for folder names only."""
        names = folder_names(self.spark, self.state_root, finished=True)
        return sorted(int(n[len("epoch="):]) for n in names if n.startswith("epoch="))

    def state(self, before: int | None = None, like: DataFrame | None = None) -> DataFrame:
        """Latest state, or the latest below version ``before``; an error where that one was removed."""
        versions = [v for v in self._versions() if before is None or v < before]
        if not versions:
            if before and TRIMMED in folder_names(self.spark, self.state_root):
                raise ValueError(f"the state before version {before} is no longer kept")
            return self.clusterer.empty_state(self.spark, like)
        # The stored types count: a key's type is the stream's.
        return self.spark.read.parquet(f"{self.state_root}/epoch={versions[-1]}")

    def _trim(self, epoch_id: int) -> None:
        """Remove states that no repeated micro-batch can ask for; a marker, written first, tells them from none."""
        old = [v for v in self._versions() if v <= epoch_id][: -self.keep_versions]
        if old and TRIMMED not in folder_names(self.spark, self.state_root):
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.state_root}/{TRIMMED}")
        for version in old:
            remove(self.spark, f"{self.state_root}/epoch={version}")

    def current_clusters(self) -> tuple[DataFrame, DataFrame]:
        """(active, decayed) clusters of the latest state."""
        rows = self.clusterer.clusters(self.state())
        return with_status(rows, "active"), with_status(rows, "decayed")

    # --- one micro-batch ---

    def process(self, batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                self._empty(epoch_id, batch)
                return
            path = f"{self.state_root}/epoch={epoch_id}"
            self.clusterer.update(self.state(epoch_id, batch), batch).write.mode("overwrite").parquet(path)
            clusters = self.clusterer.clusters(self.state(epoch_id + 1, batch))
            centres = with_status(clusters, "active").select(*self.keys, "mc_id", "centroid")
            labelled = nearest_centroid(batch, centres, self.keys)
            self._report(labelled, clusters, epoch_id)
            self._trim(epoch_id)
        finally:
            batch.unpersist()

    def _report(self, labelled: DataFrame, clusters: DataFrame, epoch_id: int) -> None:
        stamped = labelled.withColumns({"batch_id": F.lit(epoch_id).cast("bigint"), "ts": F.current_timestamp()})
        groups = ["batch_id", *self.keys]
        metrics = batch_metrics(stamped, self.model_name, groups)
        self.metrics_sink(metrics, epoch_id)
        found = clusters.withColumn("batch_id", F.lit(epoch_id).cast("bigint"))
        statistics = batch_statistics(metrics.drop("silhouette_score"), found, groups)
        append_batches(statistics, f"{self.root}/statistics", ["model_name", "batch_id"])

    def _empty(self, epoch_id: int, batch: DataFrame) -> None:
        """No points: the state stays, the metrics of the batch are zero."""
        row = self.spark.range(1).select(
            F.lit(epoch_id).cast("bigint").alias("batch_id"),
            *[F.lit(None).cast(batch.schema[k].dataType).alias(k) for k in self.keys],
            F.lit(self.model_name).alias("model_name"), F.lit(0).cast("bigint").alias("n_samples"),
            F.lit(0).cast("bigint").alias("number_of_clusters"), F.lit(0.0).alias("noise_ratio"),
            F.lit(None).cast("double").alias("silhouette_score"), F.current_timestamp().alias("ts"),
        )
        self.metrics_sink(row, epoch_id)

    def start(self, points: DataFrame, checkpoint: str) -> StreamingQuery:
        """Process what is there now and stop; the checkpoint remembers what was done."""
        return (
            points.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
