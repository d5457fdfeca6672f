"""Density hierarchy of a spanning tree, folded bottom-up.

Joining components along the tree, lightest edge first, builds the condensed hierarchy with a
few numbers per component:

- two components below the minimum size stay pending, or found a cluster when they reach it;
- a pending component that meets a cluster falls into it;
- two clusters that meet end there and become children of a new one.

A component carries its size, the sum of its points' densities (1 / weight at which they
left), and the best score of its descendants, so a cluster is judged when it ends. Because
only components touched by an edge are needed, a long tree is folded range by range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions.durable import cut_lineage
from murmura.functions.ordering import ordered_index
from murmura.schema import NOISE

TREE_ROWS = 1 << 20


class Merger:
    """Components of one tree, or of a range of its edges."""

    def __init__(self, min_size: int, method: str) -> None:
        self.min_size, self.method = min_size, method
        self.parent: dict = {}
        # root -> [size, cluster or None, density sum, children's score, pending members]
        self.state: dict = {}
        self.home: dict = {}
        self.clusters: dict = {}

    def add_point(self, node) -> None:
        self.add(node, 1, None, 0.0, -1.0, [node])

    def add(self, node, size, cluster, density, score, members) -> None:
        self.parent[node] = node
        self.state[node] = [size, cluster, density, score, members]

    def find(self, node):
        while self.parent[node] != node:
            self.parent[node] = self.parent[self.parent[node]]
            node = self.parent[node]
        return node

    def merge(self, a, b, weight: float, name: str | None = None) -> None:
        left, right = self.find(a), self.find(b)
        one, two = self.state.pop(left), self.state.pop(right)
        root = min(left, right)
        self.parent[max(left, right)] = root
        density = 1.0 / weight if weight > 0 else math.inf
        size = one[0] + two[0]
        name = name or f"{a}-{b}"
        if one[1] is None and two[1] is None:
            if size < self.min_size:
                self.state[root] = [size, None, 0.0, -1.0, one[4] + two[4]]
                return
            self._settle(one[4] + two[4], name)
            self.state[root] = [size, name, size * density, -1.0, []]
        elif one[1] is None or two[1] is None:
            small, big = (one, two) if one[1] is None else (two, one)
            self._settle(small[4], big[1])
            self.state[root] = [size, big[1], big[2] + small[0] * density, big[3], []]
        else:
            score = self._end(one, name, density) + self._end(two, name, density)
            self.state[root] = [size, name, size * density, score, []]

    def _settle(self, members: list, cluster: str) -> None:
        for node in members:
            self.home[node] = cluster

    def _end(self, part: list, parent: str, birth: float) -> float:
        size, cluster, density, score, _ = part
        stability = density - size * birth
        if math.isnan(stability):
            stability = 0.0
        leaf = score < 0
        chosen = leaf or (self.method == "eom" and stability >= score)
        self.clusters[cluster] = (parent, chosen)
        return max(stability, score)

    def close_roots(self) -> None:
        """What is left at the end holds everything and is never a cluster of its own."""
        for state in self.state.values():
            if state[1] is not None:
                self.clusters[state[1]] = (None, False)

    def resolve(self) -> dict:
        """Cluster -> topmost chosen cluster around it (itself included), or None."""
        top: dict = {}
        for cluster in reversed(self.clusters):
            parent, chosen = self.clusters[cluster]
            top[cluster] = top.get(parent) or (cluster if chosen else None)
        return top


def tree_labels(ids: list, edges: list[tuple], min_size: int, method: str) -> list[int]:
    """Labels of the points ``ids`` (ascending) of one tree; edges (a, b, w), lightest first."""
    merger = Merger(min_size, method)
    for node in ids:
        merger.add_point(node)
    for edge in edges:
        merger.merge(*edge)
    merger.close_roots()
    around, numbers = merger.resolve(), {}
    labels = []
    for node in ids:
        cluster = around.get(merger.home.get(node))
        labels.append(NOISE if cluster is None else numbers.setdefault(cluster, len(numbers)))
    return labels


def label_forest(
    points: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    min_size: int,
    method: str,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """(keys, pt_id, label) from the spanning trees (keys, a, b, w) of all groups.

    Trees up to ``tree_rows`` edges are folded in one task each, longer ones in ranges.
    """
    keys = list(keys)
    edges = cut_lineage(edges)
    sizes = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("__edges"))
    longest = sizes.agg(F.max("__edges")).first()[0] or 0
    if longest <= tree_rows:
        return _whole_trees(points, edges, keys, min_size, method)
    long_keys = sizes.where(F.col("__edges") > tree_rows).select(*keys)
    short = _whole_trees(
        points.join(long_keys, keys, "left_anti"), edges.join(long_keys, keys, "left_anti"), keys, min_size, method
    )
    long = _folded_trees(
        points.join(long_keys, keys, "left_semi"), edges.join(long_keys, keys, "left_semi"),
        keys, min_size, method, tree_rows,
    )
    return short.unionByName(long)


def _whole_trees(points: DataFrame, edges: DataFrame, keys: list[str], min_size: int, method: str) -> DataFrame:
    types = {f.name: f.dataType for f in points.schema.fields}
    out = T.StructType([
        *[T.StructField(k, types[k]) for k in keys],
        T.StructField("pt_id", types["pt_id"]), T.StructField("label", T.LongType()),
    ])

    def fold(nodes: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pt_id")
        tree = tree.sort_values(["w", "a", "b"])
        rows = list(zip(tree["a"].tolist(), tree["b"].tolist(), tree["w"].tolist(), strict=True))
        return nodes[[*keys, "pt_id"]].assign(
            label=tree_labels(nodes["pt_id"].tolist(), rows, min_size, method)
        )

    return points.select(*keys, "pt_id").groupBy(*keys).cogroup(edges.groupBy(*keys)).applyInPandas(fold, out)


def _folded_trees(
    points: DataFrame, edges: DataFrame, keys: list[str], min_size: int, method: str, tree_rows: int
) -> DataFrame:
    types = {f.name: f.dataType for f in points.schema.fields}
    point = types["pt_id"]
    out = T.StructType([
        *[T.StructField(k, types[k]) for k in keys],
        T.StructField("kind", T.StringType()),
        T.StructField("id", point), T.StructField("ref", point),
        T.StructField("cluster", T.StringType()), T.StructField("parent", T.StringType()),
        T.StructField("chosen", T.BooleanType()), T.StructField("size", T.LongType()),
        T.StructField("density", T.DoubleType()), T.StructField("score", T.DoubleType()),
        T.StructField("members", T.ArrayType(point)),
    ])
    names = out.fieldNames()

    def fold(tree: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if tree.empty:
            return pd.DataFrame(columns=names)
        merger = Merger(min_size, method)
        for s in known.itertuples(index=False):
            cluster = s.cluster if isinstance(s.cluster, str) else None
            merger.add(s.id, int(s.size), cluster, s.density, s.score, list(s.members) if s.members is not None else [])
        tree = tree.sort_values("rn")
        for a, b, ca, cb, w in zip(*(tree[c].tolist() for c in ("a", "b", "ca", "cb", "w")), strict=True):
            for node in (ca, cb):
                if node not in merger.parent:
                    merger.add_point(node)
            merger.merge(ca, cb, w, f"{a}-{b}")
        rows = [("alias", n, merger.find(n)) + (None,) * 7 for n in list(merger.parent)]
        rows += [("home", n, None, c) + (None,) * 6 for n, c in merger.home.items()]
        rows += [("cluster", None, None, c, p, chosen) + (None,) * 4 for c, (p, chosen) in merger.clusters.items()]
        rows += [("state", n, None, s[1], None, None, s[0], s[2], s[3], s[4]) for n, s in merger.state.items()]
        frame = pd.DataFrame(rows, columns=names[len(keys):], dtype=object)
        for k in keys:
            frame[k] = tree[k].iloc[0]
        return frame[names]

    live = ordered_index(edges.select(*keys, "a", "b", "w"), ["w", "a", "b"], key=keys).withColumn(
        "part", F.floor((F.col("rn") - 1) / F.lit(tree_rows)).cast("bigint")
    )
    live = cut_lineage(live.withColumns({"ca": F.col("a"), "cb": F.col("b")}))
    last = live.agg(F.max("part")).first()[0]
    states, homes, clusters = None, None, None
    for part in range(last + 1):
        now = live.where(F.col("part") == part)
        touched = now.select(*keys, F.col("ca").alias("id")).unionByName(
            now.select(*keys, F.col("cb").alias("id"))
        ).distinct()
        if states is None:
            states = points.sparkSession.createDataFrame([], out)
        known = states.join(touched, [*keys, "id"], "left_semi")
        done = cut_lineage(now.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(fold, out))
        alias = done.where("kind = 'alias'").select(*keys, "id", "ref")
        kept = states.join(touched, [*keys, "id"], "left_anti")
        states = cut_lineage(kept.unionByName(done.where("kind = 'state'")).repartition(*keys, "id"))
        homes = _grown(homes, done.where("kind = 'home'").select(*keys, F.col("id").alias("pt_id"), "cluster"))
        clusters = _grown(clusters, done.where("kind = 'cluster'").select(*keys, "cluster", "parent", "chosen"))
        rest = live.where(F.col("part") > part)
        for side in ("ca", "cb"):
            rest = rest.join(alias.withColumnRenamed("id", side), [*keys, side], "left").withColumn(
                side, F.coalesce("ref", side)
            ).drop("ref")
        live = cut_lineage(rest)
    around = _topmost(clusters, keys)
    member = homes.join(around, [*keys, "cluster"]).where("top is not null").select(*keys, "pt_id", "top")
    first = member.groupBy(*keys, "top").agg(F.min("pt_id").alias("first"))
    numbered = ordered_index(cut_lineage(first), ["first"], key=keys, out="label")
    labelled = member.join(numbered.select(*keys, "top", (F.col("label") - 1).alias("label")), [*keys, "top"])
    return points.select(*keys, "pt_id").join(labelled.select(*keys, "pt_id", "label"), [*keys, "pt_id"], "left").withColumn(
        "label", F.coalesce("label", F.lit(NOISE).cast("bigint"))
    )


def _grown(table: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if table is None else table.unionByName(more)


def _topmost(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster, top): topmost chosen cluster around each, by doubling the reach upwards."""
    current = cut_lineage(clusters.select(
        *keys, "cluster", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("cluster")).alias("top")
    ))
    while current.where("up is not null").limit(1).count():
        above = current.select(
            *keys, F.col("cluster").alias("up"), F.col("up").alias("__up"), F.col("top").alias("__top")
        )
        current = cut_lineage(current.join(above, [*keys, "up"], "left").select(
            *keys, "cluster", F.col("__up").alias("up"), F.coalesce("__top", "top").alias("top")
        ))
    return current
