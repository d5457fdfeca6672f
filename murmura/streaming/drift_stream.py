"""Drift tracking as stream state: one tracker per key, one state value per cluster.

Input rows are snapshots (key, ts, centroids map<bigint, array<double>>), also empty ones, with an optional ``seq``,
their order of arrival. The same numbers as ``operators.drift`` come out, one row per cluster change. The state of a
key is a clock and a map with an entry per cluster, so a step rewrites the clusters it moves and
removes those that are gone; nothing is packed into one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from murmura.operators.drift import check_alpha

OUTPUT = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("ts", T.DoubleType()), T.StructField("dt", T.DoubleType()),
    T.StructField("cluster_id", T.LongType()), T.StructField("state", T.StringType()),
    T.StructField("distance", T.DoubleType()), T.StructField("speed", T.DoubleType()),
    T.StructField("ema_distance", T.DoubleType()), T.StructField("ema_direction", T.ArrayType(T.DoubleType())),
    T.StructField("age", T.LongType()), T.StructField("late", T.BooleanType()),
])
CLOCK = T.StructType([T.StructField("last_ts", T.DoubleType())])
CLUSTER = T.StructType([T.StructField("cluster_id", T.LongType())])
KNOWN = T.StructType([
    T.StructField("centroid", T.ArrayType(T.DoubleType())), T.StructField("age", T.LongType()),
    T.StructField("ema_distance", T.DoubleType()), T.StructField("ema_direction", T.ArrayType(T.DoubleType())),
])
#: Output rows handed over at a time.
ROWS = 10_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Map states need this provider; a session that names another one fails here, not in the stream."""
    named = spark.conf.get(_PROVIDER, _ROCKSDB)
    if not named.endswith(("RocksDBStateStoreProvider", "HDFSBackedStateStoreProvider")):
        raise ValueError(f"drift state needs {_ROCKSDB}, the session has {named}")
    spark.conf.set(_PROVIDER, _ROCKSDB)


class DriftProcessor(StatefulProcessor):
    """Snapshots of a key, in order, against its known clusters."""

    def __init__(self, ema_alpha: float | None, smooth_direction: bool, strict: bool, ordered: bool):
        self.alpha, self.smooth, self.strict, self.ordered = ema_alpha, smooth_direction, strict, ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", CLOCK)
        self.clusters = handle.getMapState("clusters", CLUSTER, KNOWN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fed = pd.concat(list(rows)).sort_values("seq" if self.ordered else "ts", kind="stable")
        last_ts = self.clock.get()[0] if self.clock.exists() else None
        before = {c[0]: tuple(v) for c, v in self.clusters.iterator()} if last_ts is not None else {}
        known, out = before, []
        for snapshot in fed.itertuples(index=False):
            now = float(snapshot.ts)
            if last_ts is not None and now <= last_ts:
                if self.strict:
                    raise ValueError("timestamp must be increasing between updates")
                out.append((key[0], now, None, None, None, None, None, None, None, None, True))
                continue
            dt = 1.0 if last_ts is None else now - last_ts
            known, changes = _step(known, dict(snapshot.centroids or {}), dt, self.alpha, self.smooth)
            last_ts = now
            out += [(key[0], now, dt, *change, False) for change in changes]
            while len(out) >= ROWS:
                yield pd.DataFrame(out[:ROWS], columns=OUTPUT.fieldNames())
                out = out[ROWS:]
        for cluster in before.keys() - known.keys():
            self.clusters.removeKey((cluster,))
        for cluster, value in known.items():
            if before.get(cluster) != value:
                self.clusters.updateValue((cluster,), value)
        if last_ts is not None:
            self.clock.update((last_ts,))
        if out:
            yield pd.DataFrame(out, columns=OUTPUT.fieldNames())

    def close(self) -> None:
        pass


def track_drift(
    snapshots: DataFrame, ema_alpha: float | None = None, smooth_direction: bool = True, strict: bool = True
) -> DataFrame:
    """Streaming drift rows. Time must rise per key: strict fails, else late snapshots are flagged and skipped.

    The snapshots of a trigger are taken in the order of ``seq`` where they carry it, so disorder
    inside a trigger is seen as well, else by ``ts``.
    """
    check_alpha(ema_alpha)
    keep_state_in_rocksdb(snapshots.sparkSession)
    processor = DriftProcessor(ema_alpha, smooth_direction, strict, "seq" in snapshots.columns)
    return snapshots.groupBy("key").transformWithStateInPandas(processor, OUTPUT, "Append", "None")


def _step(known: dict, centroids: dict, dt: float, alpha: float | None, smooth: bool) -> tuple[dict, list]:
    """Known clusters are (centroid, age, smoothed distance, smoothed direction).

    All clusters that stay are moved at once; the vectors of a snapshot have one length.
    """
    present = sorted(int(c) for c in centroids)
    following, rows = {}, []
    for cluster in present:
        here = [float(v) for v in centroids[cluster]]
        if not np.isfinite(here).all():
            raise ValueError(f"Centroid for cluster {cluster} contains NaN/inf")
        following[cluster] = (here, 1, None, None)
    stay = [c for c in present if c in known]
    if stay:
        before = np.array([known[c][0] for c in stay], dtype=float)
        move = np.array([following[c][0] for c in stay]) - before
        length = np.sqrt((move * move).sum(axis=1))
        mean, heading, shown = [None] * len(stay), [None] * len(stay), [None] * len(stay)
        if alpha is not None:
            past = np.array([np.nan if known[c][2] is None else known[c][2] for c in stay], dtype=float)
            mean = np.where(np.isnan(past), length, alpha * length + (1 - alpha) * past).tolist()
            heading = [known[c][3] for c in stay]
            if smooth:
                old = np.array([h if h is not None else [0.0] * move.shape[1] for h in heading], dtype=float)
                moved = length > 0
                turned = alpha * move / np.where(moved, length, 1.0)[:, None] + (1 - alpha) * old
                size = np.sqrt((turned * turned).sum(axis=1))
                unit = turned / np.where(size > 0, size, 1.0)[:, None]
                for k in np.flatnonzero(moved).tolist():
                    heading[k] = turned[k].tolist()
                    shown[k] = unit[k].tolist() if size[k] > 0 else None
        speed = (length / dt if dt > 0 else np.zeros(len(stay))).tolist()
        for k, cluster in enumerate(stay):
            age = known[cluster][1] + 1
            following[cluster] = (following[cluster][0], age, mean[k], heading[k])
            rows.append((cluster, "stable", float(length[k]), speed[k], mean[k], shown[k], age))
    rows += [(c, "appeared", None, None, None, None, 1) for c in present if c not in known]
    rows += [(c, "disappeared", None, None, None, None, None) for c in known if c not in following]
    return following, sorted(rows, key=lambda r: r[0])
