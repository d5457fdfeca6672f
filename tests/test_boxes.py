"""Searches through trees of boxes against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from murmura.operators import assign, boxes, offline
from murmura.operators.kernels import pairwise
from murmura.operators.offline import core_distances, mst_edges, neighbours


def clustered(n, dims, seed=1):
    """Dense spots, outliers, copies of one place, points on a line; three groups of different size."""
    rng = np.random.default_rng(seed)
    spots = rng.normal(0, 0.01, (n // 2, dims)) + rng.integers(0, 3, (n // 2, 1)) * 50
    rest = [rng.uniform(-1000, 1000, (n // 8, dims)), np.full((n // 4, dims), 7.0), np.repeat(np.arange(n // 8)[:, None], dims, 1)]
    xs = np.concatenate([spots, *rest])
    group = rng.choice([0, 0, 0, 1], len(xs))
    return pd.DataFrame({"g": group, "pt_id": rng.permutation(len(xs)), "features": list(xs.tolist())})


def brute(frame, keys, k, metric):
    out = {}
    for key, part in frame.groupby(keys) if keys else [((), frame)]:
        part = part.sort_values("pt_id")
        xs, ids = np.array(part["features"].tolist()), part["pt_id"].to_numpy()
        dist = pairwise(xs, xs, metric)
        np.fill_diagonal(dist, np.inf)
        order = np.argsort(dist, axis=1, kind="stable")[:, :min(k, len(ids) - 1)]
        for row, name in enumerate(ids):
            out[(*(key if isinstance(key, tuple) else (key,)), name)] = [(ids[c], dist[row, c]) for c in order[row]]
    return out


@pytest.mark.parametrize(("dims", "metric", "keys", "k"), [
    (2, "euclidean", [], 5), (1, "manhattan", ["g"], 3), (3, "chebyshev", ["g"], 4), (2, "manhattan", [], 1)])
def test_nearest_points(spark, monkeypatch, dims, metric, keys, k):
    for name, size in (("LEAF", 8), ("BLOCK", 4), ("ASKED", 32), ("FAN", 4), ("AT_ONCE", 50)):
        monkeypatch.setattr(boxes, name, size)
    frame = clustered(1200, dims)
    points = spark.createDataFrame(frame, "g int, pt_id bigint, features array<double>")
    got = neighbours(points, keys, k, metric, block_rows=10).toPandas()
    expected = brute(frame, keys, k, metric)
    seen = {name: list(zip(part["neighbour"], part["distance"])) for name, part in got.sort_values("rank").groupby([*keys, "pt_id"])}
    assert len(seen) == len(expected)
    for name, near in expected.items():
        mine = seen[name if isinstance(name, tuple) else (name,)]
        assert [a for a, _ in mine] == [a for a, _ in near]
        assert [d for _, d in mine] == pytest.approx([d for _, d in near])


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_nearest_targets(spark, monkeypatch, keys):
    for name, size in (("LEAF", 8), ("BLOCK", 4), ("ASKED", 32), ("FAN", 4)):
        monkeypatch.setattr(boxes, name, size)
    frame, centres = clustered(600, 2), clustered(300, 2, 5)
    centres["target_id"] = "c" + centres["pt_id"].astype(str).str.zfill(4)
    points = spark.createDataFrame(frame, "g int, pt_id bigint, features array<double>")
    targets = spark.createDataFrame(centres[["g", "target_id", "features"]], "g int, target_id string, features array<double>")
    got = {r["pt_id"]: (r["neighbour"], r["distance"]) for r in boxes.nearest_points(points, keys, 1, "euclidean", 2, targets).collect()}
    assert len(got) == len(frame)
    for name, group, at in zip(frame["pt_id"], frame["g"], frame["features"]):
        mine = centres[centres["g"] == group] if keys else centres
        dist = pairwise(np.array([at]), np.array(mine["features"].tolist()))[0]
        best = min(zip(dist, mine["target_id"]))
        assert got[name][0] == best[1] and got[name][1] == pytest.approx(best[0])


@pytest.mark.parametrize(("dims", "metric", "keys", "k", "name"), [
    (2, "euclidean", [], 5, "bigint"), (3, "chebyshev", ["g"], 0, "bigint"), (1, "manhattan", ["g"], 2, "string")])
def test_spanning_tree(spark, monkeypatch, dims, metric, keys, k, name):
    """Edge for edge the tree of the pairs of blocks, with places that hold hundreds of points and many equal weights."""
    for constant, size in (("LEAF", 8), ("FAN", 4), ("AT_ONCE", 50)):
        monkeypatch.setattr(boxes, constant, size)
    frame = clustered(320, dims, 4)
    frame = pd.concat([frame, pd.DataFrame({"g": [5, 6, 6], "pt_id": [9001, 9002, 9003], "features": [[0.0] * dims, [1.0] * dims, [3.0] * dims]})])
    points = spark.createDataFrame(frame, "g int, pt_id bigint, features array<double>").withColumn("pt_id", F.col("pt_id").cast(name))
    expected = mst_edges(points, keys, k, metric)
    asked = []
    built = offline.box_tree
    monkeypatch.setattr(offline, "box_tree", lambda *a: asked.append(a) or built(*a))
    monkeypatch.setattr(offline, "TREE_BLOCKS", 0)
    got = mst_edges(points, keys, k, metric)
    assert asked and got.schema.simpleString() == expected.schema.simpleString()
    rows = [tuple(r) for r in got.collect()]
    groups = frame["g"].nunique() if keys else 1
    assert len(rows) == len(set(rows)) == len(frame) - groups
    assert set(rows) == {tuple(r) for r in expected.collect()}
    assert not mst_edges(points.limit(0), keys, k, metric).collect()


def test_few_and_single_points(spark):
    points = spark.createDataFrame([(1, [0.0, -0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0])], "pt_id bigint, features array<double>")
    got = {(r["pt_id"], r["neighbour"]): (r["distance"], r["rank"]) for r in neighbours(points, [], 5).collect()}
    assert got == {(1, 3): (0.0, 1), (1, 2): (5.0, 2), (2, 1): (5.0, 1), (2, 3): (5.0, 2), (3, 1): (0.0, 1), (3, 2): (5.0, 2)}
    assert core_distances(points.where("pt_id = 1"), [], 5).first()["core"] == 0.0
    assert not neighbours(points.limit(0), [], 5).collect()


def test_candidates_grow_with_the_points(spark, monkeypatch):
    """The leaves that a block of asking points needs do not grow with n, with a dense spot and far outliers too."""
    rng = np.random.default_rng(2)
    met = {}
    descended = boxes.descended
    for n in (16_000, 48_000):
        xs = np.concatenate([rng.uniform(0, 1, (n // 2, 2)), rng.normal(0.5, 1e-6, (n // 2 - 50, 2)), rng.uniform(-1e6, 1e6, (50, 2))])
        points = spark.createDataFrame(pd.DataFrame({"pt_id": np.arange(n), "features": xs.tolist()}), "pt_id bigint, features array<double>")
        pairs = []
        monkeypatch.setattr(boxes, "descended", lambda *a, **o: pairs.append(descended(*a, **o)) or pairs[-1])
        assert neighbours(points, [], 5).agg(F.count(F.lit(1))).first()[0] == 5 * n
        met[n] = pairs[0].count() * boxes.BLOCK / n
    assert met[48_000] < 64 and met[48_000] < 1.5 * met[16_000]


def test_few_pairs_go_from_level_to_level(spark, monkeypatch):
    """A block goes on with the nodes it may need, not with all that lies below them."""
    for name, size in (("LEAF", 16), ("BLOCK", 16)):
        monkeypatch.setattr(boxes, name, size)
    n, moved, cut = 6_000, [], boxes.cut_lineage

    def counted(rows):
        out = cut(rows)
        if "ql0" in out.columns and {"node", "__up"} & set(out.columns):
            moved.append(out.count() * boxes.BLOCK / n)
        return out

    monkeypatch.setattr(boxes, "cut_lineage", counted)
    xs = np.random.default_rng(3).uniform(0, 1, (n, 2))
    points = spark.createDataFrame(pd.DataFrame({"pt_id": np.arange(n), "features": xs.tolist()}), "pt_id bigint, features array<double>")
    assert neighbours(points, [], 5).count() == 5 * n
    assert moved and max(moved) < 100, moved


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_assignment_to_very_many_centres(spark, monkeypatch, keys):
    """Beyond ``CENTRES`` centres the tree answers what the arrays answer."""
    rng = np.random.default_rng(8)
    frame = clustered(500, 2)
    points = spark.createDataFrame(frame, "g int, pt_id bigint, features array<double>").cache()
    n = 900
    at, size = rng.choice([0.0, 7.0, 50.0], (n, 1)) + rng.normal(0, 3, (n, 2)), rng.integers(1, 9, n).astype(float)
    state = pd.DataFrame({
        "g": rng.choice([0, 0, 1], n), "mc_id": rng.permutation(n), "status": rng.choice(["p", "o"], n), "w": size,
        "cf1": list((at * size[:, None]).tolist()), "cf2": list(((at * at + 0.01) * size[:, None]).tolist())})
    state = spark.createDataFrame(state, "g int, mc_id bigint, status string, w double, cf1 array<double>, cf2 array<double>").cache()
    centres = state.withColumn("centroid", F.transform("cf1", lambda v: v / F.col("w"))).select("g", "mc_id", "centroid")

    def answers():
        taken = assign.absorb(points, state, 2.0, keys, dims=2).select("pt_id", "mc_id", F.round("distance", 9)).collect()
        near = assign.nearest_centroid(points, centres, keys, 40.0, dims=2).select("pt_id", "label", "mc_id", F.round("distance", 9)).collect()
        return {tuple(r) for r in taken}, {tuple(r) for r in near}

    arrays = answers()
    assert len(arrays[0]) == len(frame) and 50 < sum(m is not None for _, m, _ in arrays[0]) < len(frame)
    monkeypatch.setattr(assign, "CENTRES", 16)
    monkeypatch.setattr(boxes, "LEAF", 8)
    joined = []
    monkeypatch.setattr(assign, "beside", lambda *a: joined.append(a))
    assert answers() == arrays and not joined
