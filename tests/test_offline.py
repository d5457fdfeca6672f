"""Offline clustering against brute force, in one block and cut into many."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from murmura.operators import offline as O
from murmura.operators.hierarchy import label_forest, tree_labels


def blobs(rng, n, centres, std):
    centre = np.array(centres)[np.arange(n) % len(centres)]
    return centre + rng.normal(0, std, size=(n, 2))


def frame(spark, batches):
    rows = [(b, i, [float(v) for v in p]) for b, pts in batches.items() for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "batch_id bigint, pt_id bigint, features array<double>")


def reach(points, k):
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(k, len(points) - 1)] if k else np.zeros(len(points))
    return np.maximum(d, np.maximum(core[:, None], core[None, :])), core


def kruskal(weights):
    n = len(weights)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    tree = []
    for w, a, b in sorted((weights[a, b], a, b) for a, b in itertools.combinations(range(n), 2)):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            tree.append((a, b, w))
    return tree


def top_down_labels(n, tree, m, method):
    """Condensed tree read from the root down, as the method is usually described."""
    kids, sizes, node_of = {}, {i: 1 for i in range(n)}, list(range(n))
    level = {}
    members = {i: [i] for i in range(n)}
    for step, (a, b, w) in enumerate(tree):
        left, right, new = node_of[a], node_of[b], n + step
        kids[new], level[new] = (left, right), 1 / w
        sizes[new] = sizes[left] + sizes[right]
        members[new] = members[left] + members[right]
        for p in members[new]:
            node_of[p] = new
    root = n + len(tree) - 1
    clusters = []

    def walk(node, birth, parent):
        me = {"parent": parent, "kids": [], "stab": 0.0, "points": members[node], "own": []}
        clusters.append(me)
        while True:
            if node < n:
                return me
            left, right = kids[node]
            lam = level[node]
            big = [c for c in (left, right) if sizes[c] >= m]
            small = [c for c in (left, right) if sizes[c] < m]
            for c in small:
                me["stab"] += sizes[c] * (lam - birth)
            if len(big) == 2:
                me["stab"] += (sizes[left] + sizes[right]) * (lam - birth)
                me["kids"] = [walk(left, lam, me), walk(right, lam, me)]
                return me
            if not big:
                return me
            node = big[0]

    top = walk(root, 0.0, None)

    def choose(c):
        if not c["kids"]:
            return (c["stab"], [c])
        parts = [choose(k) for k in c["kids"]]
        total, chosen = sum(p[0] for p in parts), [x for p in parts for x in p[1]]
        if method == "eom" and c is not top and c["stab"] >= total:
            return (c["stab"], [c])
        return (max(total, c["stab"]), chosen)

    labels = [-1] * n
    chosen = [c for c in choose(top)[1] if c is not top]
    for i, c in enumerate(sorted(chosen, key=lambda c: min(c["points"]))):
        for p in c["points"]:
            labels[p] = i
    return labels


BATCHES = {
    1: lambda r: blobs(r, 90, [(0, 0), (6, 6), (0, 7)], 0.5),
    2: lambda r: np.vstack([blobs(r, 60, [(0, 0), (4, 4)], 0.3), r.uniform(-6, 6, size=(12, 2))]),
    3: lambda r: r.normal(0, 1, size=(5, 2)),
    4: lambda r: r.normal(0, 1, size=(1, 2)),
}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(42)
    return {b: make(rng) for b, make in BATCHES.items()}


@pytest.fixture(scope="module")
def expected(data):
    out = {}
    for b, points in data.items():
        weights, core = reach(points, 5)
        out[b] = (weights, core, kruskal(weights))
    return out


@pytest.mark.parametrize("bound,block", [(200, 2048), (None, 16)])
def test_core_and_tree(spark, data, expected, bound, block):
    points = frame(spark, data)
    core = O.core_distances(points, k=5, group_bound=bound, block_rows=block).collect()
    assert len(core) == sum(len(p) for p in data.values())
    for r in core:
        assert r["core"] == pytest.approx(expected[r["batch_id"]][1][r["pt_id"]])
    edges = O.mst_edges(points, k=5, group_bound=bound, block_rows=block).collect()
    for b in data:
        mine = sorted((r["a"], r["b"]) for r in edges if r["batch_id"] == b)
        assert mine == sorted((a, c) for a, c, _ in expected[b][2])


@pytest.mark.parametrize("method", ["eom", "leaf"])
def test_bottom_up_equals_top_down(data, expected, method):
    for b, points in data.items():
        if len(points) < 2:
            continue
        tree = expected[b][2]
        for m in (2, 3, 5, 8):
            assert tree_labels(list(range(len(points))), tree, m, method) == top_down_labels(len(points), tree, m, method)


@pytest.mark.parametrize("method", ["eom", "leaf"])
def test_labels_whole_blocks_and_ranges(spark, data, expected, method):
    points = frame(spark, data)
    want = {b: top_down_labels(len(p), expected[b][2], 5, method) if len(p) > 1 else [-1] for b, p in data.items()}
    whole = O.offline_cluster(points, group_bound=200, cluster_selection_method=method).collect()
    edges = spark.createDataFrame(
        [(b, a, c, float(w)) for b in data for a, c, w in expected[b][2]], "batch_id bigint, a bigint, b bigint, w double"
    )
    ranged = label_forest(points, edges, ["batch_id"], 5, method, tree_rows=20).collect()
    for rows in (whole, ranged):
        assert len(rows) == sum(len(p) for p in data.values())
        for r in rows:
            assert r["label"] == want[r["batch_id"]][r["pt_id"]], r


def test_labels_without_a_bound(spark, data, expected):
    points = frame(spark, data)
    rows = O.offline_cluster(points, block_rows=32).collect()
    for r in rows:
        b = r["batch_id"]
        want = top_down_labels(len(data[b]), expected[b][2], 5, "eom") if len(data[b]) > 1 else [-1]
        assert r["label"] == want[r["pt_id"]]


@pytest.mark.parametrize("bound,block", [(200, 2048), (None, 16)])
def test_density_cut(spark, data, expected, bound, block):
    points = frame(spark, data)
    rows = O.density_cut(points, 0.6, k=5, group_bound=bound, block_rows=block).collect()
    for b in data:
        weights, core, _ = expected[b]
        component = list(range(len(weights)))
        changed = True
        while changed:
            changed = False
            for i, j in itertools.product(range(len(weights)), repeat=2):
                if i != j and weights[i, j] <= 0.6 and component[i] > component[j]:
                    component[i], changed = component[j], True
        got = {r["pt_id"]: r["component"] for r in rows if r["batch_id"] == b}
        assert got == {i: component[i] if core[i] <= 0.6 else None for i in range(len(weights))}


def test_neighbours_across_blocks(spark, data):
    points = frame(spark, data)
    one = {tuple(r) for r in O.neighbours(points, k=4, group_bound=200).collect()}
    many = {tuple(r) for r in O.neighbours(points, k=4, block_rows=16).collect()}
    assert one == many


def test_all_noise_and_metrics(spark, data):
    points = frame(spark, {3: data[3]})
    labels = O.offline_cluster(points, min_cluster_size=10, group_bound=10)
    batches = spark.createDataFrame([(3,), (9,)], "batch_id bigint")
    rows = {r["batch_id"]: r for r in O.offline_result(points, labels, batches=batches, group_bound=10).collect()}
    assert (rows[3]["number_of_clusters"], rows[3]["noise_ratio"], rows[3]["silhouette_score"]) == (0, 1.0, None)
    assert rows[3]["max_size"] is None
    assert (rows[9]["n_samples"], rows[9]["noise_ratio"], rows[9]["number_of_clusters"]) == (0, 0.0, 0)


@pytest.mark.parametrize("bad", [
    {"min_cluster_size": 0}, {"min_cluster_size": 1}, {"min_samples": 0}, {"metric": ""}, {"metric": "x"},
    {"cluster_selection_method": "x"}, {"history_size": 0}, {"random_state": -1},
])
def test_params(bad):
    with pytest.raises(ValueError):
        O.check_params(**bad)
