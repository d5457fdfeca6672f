"""Connected components, and joining a minimum spanning tree from candidate edges.

Both are loops over a shrinking edge table with a checkpoint per round; the number of rounds
grows with the logarithm of the size.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions.durable import cut_lineage


def components(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), group_bound: int | None = None
) -> DataFrame:
    """(keys, node, component): the smallest node reachable over ``edges`` (keys, a, b).

    ``group_bound`` is a known limit on the nodes of a group; such groups are joined up within
    one task each. Without it edges move between tasks by node.
    """
    keys = list(keys)
    if group_bound is not None:
        joined = _grouped(edges, keys)
    else:
        joined = star_rounds(edges, keys)
    return nodes.select(*keys, "node").join(joined, [*keys, "node"], "left").withColumn(
        "component", F.coalesce("component", "node")
    )


def find(parent: dict, node):
    while parent[node] != node:
        parent[node] = parent[parent[node]]
        node = parent[node]
    return node


def _grouped(edges: DataFrame, keys: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in edges.schema.fields}
    out = T.StructType([
        *[T.StructField(k, types[k]) for k in keys],
        T.StructField("node", types["a"]), T.StructField("component", types["a"]),
    ])

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            left, right = find(parent, a), find(parent, b)
            parent[max(left, right)] = min(left, right)
        names = list(parent)
        frame = pd.DataFrame({"node": names, "component": [find(parent, n) for n in names]})
        for k in keys:
            frame[k] = pdf[k].iloc[0]
        return frame[[*keys, "node", "component"]]

    return edges.groupBy(*(keys or [F.lit(0)])).applyInPandas(join_up, out)


def star_rounds(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Alternating star contraction: edges end up pointing every node at its smallest one."""
    current = cut_lineage(
        edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct()
    )
    while True:
        # Larger neighbours of every node move to the smallest node around it.
        both = current.unionByName(current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.join(low, [*keys, "u"]).where("v > u").select(
            *keys, F.col("v").alias("u"), F.col("low").alias("v")
        ).where("u <> v").distinct()
        # Smaller neighbours and the node itself move to the smallest of them.
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("low"))
        paired = large.join(least, [*keys, "u"])
        small = paired.where("v <> low").select(*keys, F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            least.select(*keys, "u", F.col("low").alias("v"))
        ).distinct()
        following = cut_lineage(small)
        moved = following.join(current, [*keys, "u", "v"], "left_anti").limit(1).count()
        if moved == 0 and following.count() == current.count():
            return following.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                following.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        current = following


def spanning_forest(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Minimum spanning forest of (keys, a, b, w) under the order (w, a, b).

    Every round each component takes its lightest outgoing edge and the components so linked
    become one; of parallel edges between two components only the lightest is kept.
    """
    keys = list(keys)
    edge = F.struct("w", "a", "b")
    live = cut_lineage(edges.select(*keys, "a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    chosen: DataFrame | None = None
    while live.limit(1).count():
        ends = live.select(*keys, F.col("ca").alias("c"), F.col("cb").alias("other"), edge.alias("e")).unionByName(
            live.select(*keys, F.col("cb").alias("c"), F.col("ca").alias("other"), edge.alias("e"))
        )
        picks = cut_lineage(ends.groupBy(*keys, "c").agg(F.min(F.struct("e", "other")).alias("m")).select(
            *keys, "c", "m.e.*", F.col("m.other").alias("other")
        ))
        taken = picks.select(*keys, "a", "b", "w").distinct()
        chosen = taken if chosen is None else chosen.unionByName(taken)
        links = picks.select(*keys, F.col("c").alias("a"), F.col("other").alias("b"))
        renamed = star_rounds(links, keys)
        for side in ("ca", "cb"):
            live = live.join(
                renamed.select(*keys, F.col("node").alias(side), F.col("component").alias("__new")), [*keys, side], "left"
            ).withColumn(side, F.coalesce("__new", side)).drop("__new")
        pair = [F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")]
        live = cut_lineage(
            live.where("ca <> cb").select(*keys, *pair, edge.alias("e"))
            .groupBy(*keys, "ca", "cb").agg(F.min("e").alias("e"))
            .select(*keys, "e.a", "e.b", "e.w", "ca", "cb")
        )
    return edges.select(*keys, "a", "b", "w").limit(0) if chosen is None else chosen
