"""Streaming jobs over file sources give what the batch operators give."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions.ordering import fixed_batches
from murmura.operators.base import Clusterer
from murmura.operators.drift import per_cluster_drift, with_dt
from murmura.operators.online import OnlineClusterer, OnlineConfig
from murmura.sources.sinks import append_metrics, latest_metrics, read_metrics
from murmura.streaming.drift_stream import track_drift
from murmura.streaming.online_job import OnlineJob
from murmura.streaming.replay import read_replay, write_replay

POINT = T.StructType([
    T.StructField("pt_id", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType())),
    T.StructField("batch_id", T.LongType()),
])


def stream_points(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    centre = np.array([(-3.0, 0.0), (3.0, 0.0)])[np.arange(n) % 2]
    xy = centre + rng.normal(0, 0.2, size=(n, 2))
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(xy)]
    return spark.createDataFrame(rows, "pt_id bigint, features array<double>")


def test_replay_job_metrics_and_state(spark, tmp_path):
    points = fixed_batches(stream_points(spark, 250), 100, ["pt_id"])
    assert write_replay(points, str(tmp_path / "in")) == 3
    order = []
    stream = read_replay(spark, str(tmp_path / "in"), POINT)
    job = OnlineJob(spark, str(tmp_path / "out"), OnlineConfig(n_samples_init=100))
    plain = job.process

    def seen(batch, epoch):
        order.append(sorted({r[0] for r in batch.select("batch_id").distinct().collect()}))
        plain(batch, epoch)

    job.process = seen
    job.start(stream, str(tmp_path / "check")).awaitTermination()
    assert order == [[1], [2], [3]]

    metrics = {r["batch_id"]: r for r in read_metrics(spark, str(tmp_path / "out" / "metrics"), "online").collect()}
    assert [metrics[b]["n_samples"] for b in (0, 1, 2)] == [100, 100, 50]
    assert all(metrics[b]["noise_ratio"] == 0.0 for b in metrics)
    active, decayed = job.current_clusters()
    assert active.count() >= 2 and decayed.where("status <> 'decayed'").count() == 0
    assert active.agg(F.sum("size")).first()[0] + (decayed.agg(F.sum("size")).first()[0] or 0) <= 250

    # The same batches applied one by one give the same model.
    clusterer = OnlineClusterer(OnlineConfig(n_samples_init=100))
    state = clusterer.empty_state(spark)
    for b in (1, 2, 3):
        state = clusterer.update(state, points.where(F.col("batch_id") == b))
    assert {r[0] for r in clusterer.clusters(state).select("id").collect()} == {
        r[0] for r in active.unionByName(decayed).select("id").collect()
    }

    # A repeated micro-batch replaces its output.
    plain(points.where("batch_id = 3"), 2)
    assert read_metrics(spark, str(tmp_path / "out" / "metrics")).count() == 3
    # An empty one leaves the state and reports zeros.
    before = sorted(map(tuple, job.state().select("mc_id", "n").collect()))
    plain(points.where("batch_id = 99"), 3)
    assert sorted(map(tuple, job.state().select("mc_id", "n").collect())) == before
    row = latest_metrics(read_metrics(spark, str(tmp_path / "out" / "metrics"))).first()
    assert (row["batch_id"], row["n_samples"], row["noise_ratio"], row["silhouette_score"]) == (3, 0, 0.0, None)

    # Another configuration, and a reset, start from nothing.
    assert job.configure(decay_factor=0.2, unknown=1)["decay_factor"] == 0.2
    assert job.state().count() == 0
    job.configure(decay_factor=0.01)
    assert job.state().count() == 0
    plain(points.where("batch_id = 1"), 4)
    root = str(tmp_path / "out")
    assert OnlineJob(spark, root, OnlineConfig(n_samples_init=100)).state().count() > 0
    job.reset()
    assert job.state().count() == 0
    # A job that starts later sees the reset.
    assert OnlineJob(spark, root, OnlineConfig(n_samples_init=100)).state().count() == 0


def test_batches_of_a_trigger_in_one_file(spark, tmp_path):
    points = fixed_batches(stream_points(spark, 65), 10, ["pt_id"])
    assert write_replay(points, str(tmp_path / "in"), 3) == 3
    order = []
    read_replay(spark, str(tmp_path / "in"), POINT).writeStream.foreachBatch(
        lambda batch, epoch: order.append((epoch, sorted({r[0] for r in batch.select("batch_id").collect()}), batch.count()))
    ).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert order == [(0, [1, 2, 3], 30), (1, [4, 5, 6], 30), (2, [7], 5)]


def test_numeric_keys_and_empty_batches(spark, tmp_path):
    points = stream_points(spark, 300).select((F.col("pt_id") % 3).alias("k"), "pt_id", "features")
    job = OnlineJob(spark, str(tmp_path / "out"), OnlineConfig(n_samples_init=10), keys=["k"])
    job.process(points.where("pt_id < 150"), 0)
    job.process(points.where("pt_id < 0"), 1)
    job.process(points.where("pt_id >= 150"), 2)
    active, _ = job.current_clusters()
    assert dict(active.dtypes)["k"] == "bigint" and active.select("k").distinct().count() == 3
    again = OnlineJob(spark, str(tmp_path / "out"), OnlineConfig(n_samples_init=10), keys=["k"])
    assert again.current_clusters()[0].count() == active.count()
    assert read_metrics(spark, str(tmp_path / "out" / "metrics")).count() == 7


class Sums:
    """A clusterer whose state is one row: the number of points seen."""

    def empty_state(self, spark, like=None):
        return spark.createDataFrame([], "mc_id bigint, seen bigint")

    def fit(self, batch):
        return batch.select(F.lit(1).cast("bigint").alias("mc_id"), F.lit(1).cast("bigint").alias("seen"))

    def update(self, state, batch):
        return state.unionByName(self.fit(batch)).groupBy("mc_id").agg(F.sum("seen").alias("seen"))

    def clusters(self, state):
        return state.select(
            "mc_id", F.lit("a-1").alias("id"), F.array(F.lit(0.0), F.lit(0.0)).alias("centroid"),
            F.lit(3).alias("size"), F.lit(0.6).alias("density"), F.lit("active").alias("status"))


def test_old_states_are_removed(spark, tmp_path):
    job = OnlineJob(spark, str(tmp_path), factory=lambda cfg: Sums(), metrics_sink=lambda df, e: None, keep_versions=2)
    points = stream_points(spark, 8)
    for epoch in range(6):
        job.process(points, epoch)
        assert len(job._versions()) <= 2
    assert job._versions() == [4, 5] and job.state().first()["seen"] == 48
    # A repeated micro-batch starts from the state before it.
    job.process(points, 5)
    assert job._versions() == [4, 5] and job.state().first()["seen"] == 48
    with pytest.raises(ValueError, match="no longer kept"):
        job.state(3)
    assert job.state(0).count() == 0
    job.reset()
    assert job.state(3).count() == 0
    with pytest.raises(ValueError, match="keep_versions"):
        OnlineJob(spark, str(tmp_path), keep_versions=1)


def test_points_of_three_dimensions(spark, tmp_path):
    points = stream_points(spark, 60).withColumn("features", F.concat("features", F.array(F.lit(1.0))))
    job = OnlineJob(spark, str(tmp_path), OnlineConfig(n_samples_init=10), dims=3, metrics_sink=lambda df, e: None)
    job.process(points, 0)
    active, _ = job.current_clusters()
    assert active.count() >= 2 and {len(r["centroid"]) for r in active.collect()} == {3}


def test_injected_clusterer_and_sink(spark, tmp_path):
    class Fixed:
        def empty_state(self, spark, like=None):
            return spark.createDataFrame([], "mc_id bigint")

        def fit(self, batch):
            return batch.select(F.lit(1).cast("bigint").alias("mc_id")).distinct()

        def update(self, state, batch):
            return self.fit(batch)

        def clusters(self, state):
            return state.select(
                "mc_id", F.lit("a-1").alias("id"), F.array(F.lit(0.0), F.lit(0.0)).alias("centroid"),
                F.lit(3).alias("size"), F.lit(0.6).alias("density"), F.lit("active").alias("status"),
            )

    assert isinstance(Fixed(), Clusterer)
    kept = []
    job = OnlineJob(spark, str(tmp_path), factory=lambda cfg: Fixed(), metrics_sink=lambda df, e: kept.append((e, df.collect())))
    job.process(stream_points(spark, 1), 7)
    assert kept[0][0] == 7 and kept[0][1][0]["n_samples"] == 1 and kept[0][1][0]["batch_id"] == 7
    stats = spark.read.parquet(str(tmp_path / "statistics")).first()
    assert (stats["active_clusters"], stats["avg_density"], stats["n_samples"]) == (1, 0.6, 1)


def test_stream_drift_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(12):
        present = {c: [float(v) for v in rng.normal(0, 2, 2)] for c in range(4) if rng.random() < 0.7}
        rows.append(("k", float(t * t + 1), present, t + 1))
    schema = "key string, ts double, centroids map<bigint, array<double>>, batch_id bigint"
    snaps = spark.createDataFrame(rows, schema)
    write_replay(snaps, str(tmp_path / "in"))
    stream = read_replay(spark, str(tmp_path / "in"), snaps.schema, per_trigger=3).drop("batch_id")
    q = (
        track_drift(stream, ema_alpha=0.4).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = {(r["ts"], r["cluster_id"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    flat = snaps.select(F.col("batch_id").alias("step"), F.explode("centroids").alias("cluster_id", "centroid"))
    steps = with_dt(snaps.select(F.col("batch_id").alias("step"), "ts"))
    want = per_cluster_drift(flat, ema_alpha=0.4, steps=steps).join(steps.select("step", "ts"), "step").collect()
    assert len(got) == len(want) > 20
    for r in want:
        mine = got[(r["ts"], r["cluster_id"])]
        assert (mine["state"], mine["age"]) == (r["state"], r["age"])
        for c in ("distance", "speed", "ema_distance"):
            assert mine[c] == (None if r[c] is None else pytest.approx(r[c]))
        assert mine["ema_direction"] == (None if r["ema_direction"] is None else pytest.approx(r["ema_direction"]))


def test_metrics_sink_replaces_a_batch(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("m", 1, n)], "model_name string, batch_id bigint, n_samples bigint")
    append_metrics(rows(5), str(tmp_path / "m"))
    append_metrics(rows(6), str(tmp_path / "m"))
    assert [r["n_samples"] for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [6]
