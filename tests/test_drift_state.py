"""Drift as stream state: one value per cluster, arrival order, restarts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from murmura.operators.drift import per_cluster_drift, with_dt
from murmura.streaming.drift_stream import track_drift

SCHEMA = "key string, ts double, centroids map<bigint, array<double>>, seq bigint"


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = track_drift(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def feed(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def snapshots(steps, clusters, seed=3, keys=("a", "b")):
    rng = np.random.default_rng(seed)
    return [(k, float(t * t + 1), {c: [float(v) for v in rng.normal(0, 2, 2)] for c in range(clusters) if rng.random() < 0.7}, t)
            for t in range(steps) for k in keys]


def test_a_restarted_stream_goes_on_from_its_state(spark, tmp_path):
    rows = snapshots(9, 5)
    feed(spark, tmp_path, rows[:10])
    run(spark, tmp_path, ema_alpha=0.4)
    feed(spark, tmp_path, rows[10:])
    got = {(r["key"], r["ts"], r["cluster_id"]): r for r in run(spark, tmp_path, ema_alpha=0.4).collect()}
    flat = spark.createDataFrame(rows, SCHEMA).select(
        "key", F.col("seq").alias("step"), F.explode("centroids").alias("cluster_id", "centroid"))
    steps = with_dt(spark.createDataFrame(rows, SCHEMA).select("key", F.col("seq").alias("step"), "ts"), ["key"])
    want = per_cluster_drift(flat, ["key"], ema_alpha=0.4, steps=steps).join(steps.select("key", "step", "ts"), ["key", "step"]).collect()
    assert len(got) == len(want) > 40
    for r in want:
        mine = got[(r["key"], r["ts"], r["cluster_id"])]
        assert (mine["state"], mine["age"]) == (r["state"], r["age"])
        for c in ("distance", "speed", "ema_distance", "ema_direction"):
            assert mine[c] == (None if r[c] is None else pytest.approx(r[c]))


def test_disorder_inside_a_trigger(spark, tmp_path):
    rows = [("k", 1.0, {1: [0.0, 0.0]}, 0), ("k", 5.0, {1: [3.0, 4.0]}, 1), ("k", 3.0, {1: [9.0, 9.0]}, 2), ("k", 6.0, {1: [3.0, 4.0]}, 3)]
    feed(spark, tmp_path, rows)
    with pytest.raises(StreamingQueryException, match="increasing"):
        run(spark, tmp_path)


def test_late_snapshots_are_flagged_and_skipped(spark, tmp_path):
    rows = [("k", 1.0, {1: [0.0, 0.0]}, 0), ("k", 5.0, {1: [3.0, 4.0]}, 1), ("k", 3.0, {1: [9.0, 9.0]}, 2), ("k", 6.0, {1: [3.0, 4.0]}, 3)]
    feed(spark, tmp_path, rows)
    got = run(spark, tmp_path, strict=False).orderBy("ts").collect()
    assert [(r["ts"], r["late"], r["state"], r["distance"]) for r in got] == [
        (1.0, False, "appeared", None), (3.0, True, None, None), (5.0, False, "stable", 5.0), (6.0, False, "stable", 0.0)]


def test_a_key_with_very_many_clusters(spark, tmp_path):
    n = 100_000
    for step in range(2):
        rows = [("k", float(step), {c: [float(c), float(3 * step)] for c in range(step, n + step)}, step)]
        feed(spark, tmp_path, rows)
    got = run(spark, tmp_path).groupBy("ts", "state").agg(F.count(F.lit(1)), F.min("distance"), F.max("distance")).collect()
    assert {tuple(r) for r in got} == {
        (0.0, "appeared", n, None, None), (1.0, "appeared", 1, None, None), (1.0, "disappeared", 1, None, None), (1.0, "stable", n - 1, 3.0, 3.0)}
