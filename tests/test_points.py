"""Sources, shaping, parsing and validation on the small known inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from murmura.functions.scalar import prune_period
from murmura.operators import points as P
from murmura.operators import validate as V
from murmura.sources import json_points as J
from murmura.sources.logs import log_records, read_logs
from murmura.sources.trips import read_trips, trip_batches, trip_cluster_points


@pytest.fixture
def trip_file(tmp_path):
    lines = ["extra,tpep_pickup_datetime,pickup_longitude,pickup_latitude,trip_distance,total_amount"]
    lines += [f"z,2016-01-01 00:0{i}:00,{-73.99 + i / 100:.2f},{40.73 + i / 100:.2f},{1.1 * (i + 1):.1f},8.8" for i in range(4)]
    lines.append("z,2016-01-01 00:09:00,,40.7,1.0,2.0")
    path = tmp_path / "trips.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_trips(spark, trip_file, tmp_path):
    trips = read_trips(spark, trip_file)
    assert P.clean_trips(trips).count() == 4
    rows = trip_batches(trips, 3).orderBy("timestamp").collect()
    assert [r["batch_id"] for r in rows] == [1, 1, 1, 2]
    assert rows[0]["timestamp"] == 1451606400.0 and rows[0]["source"] == "nyc_taxi" and rows[0]["noise"] is None
    assert all(0 <= r["cluster_id"] < 500 for r in rows)
    trips.write.parquet(str(tmp_path / "t.parquet"))
    again = trip_cluster_points(read_trips(spark, str(tmp_path / "t.parquet")), 2).collect()
    assert sorted(r["batch_id"] for r in again) == [1, 1, 2, 2]
    assert all(r["weight"] == 1.0 and isinstance(r["cluster_id"], str) for r in again)
    with pytest.raises(ValueError):
        trip_batches(trips, 0)


def test_json_batches(spark, trip_file, tmp_path):
    points = trip_batches(read_trips(spark, trip_file), 2)
    J.save_batches(points, str(tmp_path / "p"))
    back = J.read_batches(spark, str(tmp_path / "p"))
    assert back.count() == 4 and set(back.columns) == set(points.columns)
    J.save_cluster_point_batches(points, str(tmp_path / "c"))
    assert J.read_cluster_point_batches(spark, str(tmp_path / "c")).where("weight = 1 and x < 0").count() == 4
    (tmp_path / "array.json").write_text(json.dumps([{"x": 1.0, "y": 2.0, "batch_id": 3}], indent=4))
    assert J.read_batches(spark, str(tmp_path / "array.json"), multi_line=True).first()["x"] == 1.0


def test_parse_points(spark):
    payload = {"batch_id": 3, "points": [
        {"x": 1, "y": 2, "cluster_id": "1"}, {"x": "2.5", "noise": True}, {"x": None, "y": 1}, {"x": [1]}, 7, {"x": "abc"},
    ]}
    df = spark.createDataFrame([(json.dumps(payload),), ('{"points": 1}',), ("broken{",)], "payload string")
    rows = [tuple(r) for r in P.parse_points(df).orderBy("idx").collect()]
    assert rows == [(3, 0, 1.0, 2.0, 1, False), (3, 1, 2.5, 0.0, None, True)]


def test_parse_state_metrics_and_logs(spark):
    state = {"active_clusters": [{"centroid": [1, 2.5]}, {"centroid": [1]}, 5, {"centroid": ["a", 1]}, {"centroid": [3, 4]}]}
    df = spark.createDataFrame([(json.dumps(state),)], "payload string")
    assert [tuple(r) for r in P.parse_centroids(df).orderBy("cluster_id").collect()] == [(0, 1.0, 2.5), (4, 3.0, 4.0)]

    latest = {"latest": {"m": {"silhouette_score": 0.4, "active_clusters": 3, "noise_ratio": 0.1, "batch_id": 7}}}
    df = spark.createDataFrame([(json.dumps(latest),), ("{}",)], "payload string")
    got = P.parse_latest_metrics(df).collect()
    assert (got[0]["model_name"], got[0]["silhouette_score"], got[0]["active_clusters"], got[0]["batch_id"]) == ("m", 0.4, 3, "7")
    assert got[0]["timestamp"] is None and got[1]["model_name"] is None

    df = spark.createDataFrame([('{"message": "a", "latency_ms": 1.5, "batch_id": "b"}',), ("[1]",), ("{}",)], "payload string")
    logs = log_records(df).collect()
    assert (logs[0]["message"], logs[0]["latency_ms"], logs[0]["batch_id"], logs[0]["noise_ratio"]) == ("a", 1.5, "b", None)
    assert all(v is None for k, v in logs[1].asDict().items() if k != "raw") and logs[1]["raw"] == "{}"


def test_log_lines(spark, tmp_path):
    line = {"text": "t", "record": {"time": {"repr": "2024", "timestamp": 1.0}, "level": {"name": "INFO"}, "message": "m", "extra": {"a": 1}}}
    (tmp_path / "l.jsonl").write_text(json.dumps(line) + "\n")
    row = read_logs(spark, str(tmp_path / "l.jsonl")).first()
    assert (row["level"], row["message"], row["extra"]) == ("INFO", "m", {"a": "1"})


def test_labels_features_ids(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, True), (3, False)], "cluster_id bigint, noise boolean")
    assert [r["label"] for r in P.normalise_labels(df).collect()] == [1, -1, -1, 3]
    xy = spark.createDataFrame([(1.0, 2.0, "a")], "x double, y double, s string")
    assert P.to_features(xy).first()["features"] == [1.0, 2.0]
    for bad in (["s", "x"], ["nope"]):
        with pytest.raises(TypeError):
            P.to_features(xy, bad)
    ids = spark.createDataFrame([("active-12",), ("b",), ("a-x",)], "id string")
    assert {r["id"]: r["cluster_num"] for r in P.cluster_numbers(ids).collect()} == {"active-12": 12, "a-x": 0, "b": 2}


def test_validation(spark):
    points = "points array<struct<x:double>>"
    rows = [("a", [0.0, 0.0], 2, 0.5, "active", []), ("b", [0.0], -1, -0.1, "gone", []), ("c", [0.0, 0.0], 1, 0.5, None, [(1.0,), (2.0,)])]
    df = spark.createDataFrame(rows, f"id string, centroid array<double>, size bigint, density double, status string, {points}")
    got = {r["id"]: set(r["reason"]) for r in V.check_rows(df, V.cluster_rules()).collect()}
    assert got["a"] == set() and got["c"] == {"size_below_points"}
    assert got["b"] == {"centroid_length", "size_negative", "density_negative", "status_unknown"}
    valid, broken = V.split_valid(df, V.cluster_rules())
    assert valid.count() == 1 and broken.count() == 2
    weights = spark.createDataFrame([(1.0,), (0.0,)], "weight double")
    with pytest.raises(Exception, match="weight_not_positive"):
        V.require_valid(weights, V.point_rules()).count()


def test_prune_period():
    assert prune_period(0.01, 0.5, 2.5) == 233
    with pytest.raises(ValueError):
        prune_period(0.01, 0.5, 2.0)


def test_centroids_with_text_ids_are_left_out(spark):
    from murmura.operators.validate import sane_centroids

    rows = spark.createDataFrame([("7", [1.0, 2.0]), ("x", [1.0, 2.0]), ("8", [float("nan"), 0.0])], "cluster_id string, centroid array<double>")
    assert [r["cluster_id"] for r in sane_centroids(rows, strict=False).collect()] == [7]
