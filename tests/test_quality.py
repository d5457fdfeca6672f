"""Metrics against brute force, in one block and cut into many."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.operators import quality as Q
from murmura.operators.assign import nearest_centroid
from murmura.operators.clusters import cluster_summary
from murmura.operators.silhouette import silhouette, silhouette_squared

SCHEMA = "batch_id bigint, pt_id bigint, label bigint, features array<double>"


def brute(points, labels, squared=False):
    points, labels = np.asarray(points), np.asarray(labels)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    d = d * d if squared else d
    names = set(labels.tolist())
    if len(names) < 2 or len(names) == len(labels):
        return None
    out = []
    for i, label in enumerate(labels):
        mine = labels == label
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][mine].sum() / (mine.sum() - 1)
        b = min(d[i][labels == other].mean() for other in names - {label})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@pytest.fixture(scope="module")
def batches():
    rng = np.random.default_rng(4)
    # 1: one label holds most points; 2: a singleton and noise; 3: all alone; 4: one label; 5: all noise
    sizes = {1: [0] * 60 + [1] * 7 + [2] * 5 + [-1] * 6, 2: [0] * 9 + [4] + [-1] * 3, 3: [0, 1, 2], 4: [5] * 6, 5: [-1] * 5}
    return {b: (rng.normal(0, 1, (len(l), 3)) + np.array(l)[:, None], l) for b, l in sizes.items()}


@pytest.fixture(scope="module")
def points(spark, batches):
    rows = [
        (b, i, int(l), [float(v) for v in p])
        for b, (xy, labels) in batches.items() for i, (p, l) in enumerate(zip(xy, labels))
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("bound,block", [(100, 2048), (None, 8), (None, 2048)])
def test_silhouette(points, batches, bound, block):
    got = {r[0]: r[1] for r in silhouette(points, group_bound=bound, block_rows=block).collect()}
    for b, (xy, labels) in batches.items():
        kept = [i for i, l in enumerate(labels) if l != -1]
        want = brute(xy[kept], [labels[i] for i in kept]) if kept else None
        assert got.get(b) == (None if want is None else pytest.approx(want)), b


def test_silhouette_modes(points, batches):
    got = {r[0]: r[1] for r in silhouette(points, noise="as_cluster", block_rows=16).collect()}
    assert got[1] == pytest.approx(brute(*batches[1])) and got[2] == pytest.approx(brute(*batches[2]))
    assert got[4] is None and got[5] is None
    flat = {r[0]: r[1] for r in silhouette_squared(points).collect()}
    xy, labels = batches[1]
    kept = [i for i, l in enumerate(labels) if l != -1]
    assert flat[1] == pytest.approx(brute(xy[kept], [labels[i] for i in kept], squared=True))


def test_record_of_every_batch(spark, points):
    wanted = spark.createDataFrame([(b,) for b in (1, 5, 9)], "batch_id bigint")
    rows = {r["batch_id"]: r for r in Q.batch_metrics(points, "m", batches=wanted, group_bound=100).collect()}
    assert (rows[9]["n_samples"], rows[9]["number_of_clusters"], rows[9]["noise_ratio"], rows[9]["silhouette_score"]) == (0, 0, 0.0, None)
    assert (rows[5]["n_samples"], rows[5]["number_of_clusters"], rows[5]["noise_ratio"], rows[5]["silhouette_score"]) == (5, 0, 1.0, None)
    assert rows[1]["number_of_clusters"] == 3 and rows[1]["noise_ratio"] == pytest.approx(6 / 78)
    with pytest.raises(ValueError, match="model_name"):
        Q.batch_metrics(points, "")


def test_answers_do_not_depend_on_names_or_partitions(points):
    renamed = points.withColumn("label", F.when(F.col("label") == -1, -1).otherwise(90 - F.col("label"))).repartition(7)
    for operator in (Q.cluster_count, Q.noise_ratio, Q.cluster_sizes):
        assert {tuple(r) for r in operator(points).collect()} == {tuple(r) for r in operator(renamed).collect()}
    one = {r[0]: r[1] for r in silhouette(points).collect()}
    two = {r[0]: r[1] for r in silhouette(renamed, block_rows=8).collect()}
    assert one.keys() == two.keys()
    assert all(one[b] == (None if two[b] is None else pytest.approx(two[b])) for b in one)


def test_centroids_sizes_summary(spark):
    rows = [(1, 0, 0, [0.0, 0.0]), (1, 1, 0, [1.0, 1.0]), (1, 2, -1, [10.0, 10.0])]
    points = spark.createDataFrame(rows, SCHEMA)
    for dims in (2, None):
        (row,) = Q.centroids(points, dims=dims).collect()
        assert (row["label"], row["centroid"], row["n"]) == (0, [0.5, 0.5], 2)
    clusters = spark.createDataFrame([("a", 10, 0.4), ("b", 5, 0.6)], "id string, size bigint, density double")
    noise = spark.createDataFrame([(5,)], "noise_points bigint")
    s = cluster_summary(clusters, noise=noise).first()
    assert (s["total_clusters"], s["total_points"], s["avg_density"], s["noise_ratio"]) == (2, 15, pytest.approx(0.5), pytest.approx(0.25))
    empty = cluster_summary(clusters.where("size < 0"), noise=noise).first()
    assert (empty["total_clusters"], empty["avg_density"], empty["noise_ratio"]) == (0, 0.0, 1.0)


def test_nearest_with_few_and_many_centres(spark, points, monkeypatch):
    from murmura.operators import assign

    rng = np.random.default_rng(8)
    centres = rng.normal(0, 2, (30, 3))
    df = spark.createDataFrame([(i + 100, [float(v) for v in c]) for i, c in enumerate(centres)], "mc_id bigint, centroid array<double>")
    rows = points.where("batch_id = 1").collect()
    want = {r["pt_id"]: int(np.argmin(((centres - np.array(r["features"])) ** 2).sum(1))) for r in rows}
    only = points.where("batch_id = 1")
    for limit, send in ((1024, 1 << 16), (4, 1 << 16), (4, 8)):
        monkeypatch.setattr(assign, "CENTRES", limit)
        monkeypatch.setattr(assign, "BROADCAST_CENTRES", send)
        got = {r["pt_id"]: (r["label"], r["mc_id"]) for r in nearest_centroid(only, df).collect()}
        assert got == {i: (c, c + 100) for i, c in want.items()}
    far = nearest_centroid(only, df, max_distance=0.0).select("label").distinct().collect()
    assert [r[0] for r in far] == [-1]
    none = nearest_centroid(only, df.where("mc_id < 0")).select("label").distinct().collect()
    assert [r[0] for r in none] == [-1]


def test_parts_of_a_label_follow_the_order(spark):
    rows = [(1, i, i % 2, [float(i)]) for i in range(11)]
    laid = Q.points_by_label(spark.createDataFrame(rows, SCHEMA), part_rows=4).orderBy("label", "part").collect()
    assert [(r["label"], r["part"], [p["pt_id"] for p in r["points"]]) for r in laid] == [
        (0, 0, [0, 2, 4, 6]), (0, 1, [8, 10]), (1, 0, [1, 3, 5, 7]), (1, 1, [9])]


def test_squared_silhouette_does_not_depend_on_the_origin(spark):
    rng = np.random.default_rng(8)
    x, labels = rng.normal(size=(40, 2)) + np.repeat([[0, 0], [4, 1]], 20, axis=0), np.repeat([0, 1], 20)
    for shift in (0.0, 1e7):
        rows = [(1, i, int(label), (p + shift).tolist()) for i, (p, label) in enumerate(zip(x, labels, strict=True))]
        got = silhouette_squared(spark.createDataFrame(rows, SCHEMA)).first()["silhouette_score"]
        assert got == pytest.approx(brute(x, labels, squared=True), abs=1e-6)


def test_metrics_record_has_the_latest_timestamp(spark):
    rows = [(1, 1, 0, [0.0]), (1, 2, 1, [5.0]), (1, 3, -1, [9.0]), (2, 4, -1, [1.0])]
    stamped = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("pt_id"))
    got = Q.batch_metrics(stamped, "offline", group_bound=10).orderBy("batch_id").select(
        "n_samples", "number_of_clusters", F.unix_seconds("ts").alias("s")).collect()
    assert [tuple(r) for r in got] == [(3, 2, 3), (1, 0, 4)]
