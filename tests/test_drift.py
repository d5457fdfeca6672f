"""Drift, lifecycle and smoothing: known numbers, and a step-by-step tracker as check."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.functions.ordering import affine_scan, fixed_batches, ordered_index
from murmura.operators import drift as D
from murmura.operators import history as H


def snaps(spark, steps):
    rows = [(s, c, [float(v) for v in p]) for s, step in enumerate(steps, 1) for c, p in step.items()]
    return spark.createDataFrame(rows, "step bigint, cluster_id bigint, centroid array<double>")


def rows_at(df, step):
    return {r["cluster_id"]: r for r in df.where(F.col("step") == step).collect()}


def test_distance_direction_and_ema(spark):
    moves = snaps(spark, [{0: (0, 0)}, {0: (2, 0)}, {0: (6, 0)}, {0: (6, 0)}, {0: (9, 4)}])
    drift = {r["step"]: r for r in D.per_cluster_drift(moves, ema_alpha=0.5).collect()}
    assert (drift[1]["state"], drift[1]["distance"], drift[1]["age"]) == ("appeared", None, 1)
    assert drift[3]["distance"] == pytest.approx(4.0) and drift[3]["ema_distance"] == pytest.approx(3.0)
    assert drift[4]["distance"] == 0.0 and drift[4]["direction"] is None and drift[4]["ema_direction"] is None
    assert drift[5]["direction"] == pytest.approx([0.6, 0.8])
    # the standing step left the stored direction (0.75, 0) alone
    assert drift[5]["ema_state"] == pytest.approx([0.675, 0.4])
    assert drift[5]["age"] == 5 and drift[5]["last_seen"] == 5


def test_speed_uses_time(spark):
    moves = snaps(spark, [{0: (0, 0)}, {0: (2, 0)}])
    steps = D.number_steps(spark.createDataFrame([(1.0,), (3.0,)], "ts double"))
    row = rows_at(D.displacements(moves, steps=steps), 2)[0]
    assert row["dt"] == 2.0 and row["speed"] == pytest.approx(1.0)


def test_lifecycle_and_summary(spark):
    drift, summary = D.drift_update(snaps(spark, [{0: (0, 0), 1: (1, 1)}, {1: (1, 2), 2: (2, 2)}]))
    rows = {r["step"]: r for r in summary.collect()}
    assert (rows[1]["appeared"], rows[1]["stable"], rows[1]["mean_drift_distance"]) == ([0, 1], [], None)
    assert (rows[2]["appeared"], rows[2]["disappeared"], rows[2]["stable"]) == ([2], [0], [1])
    assert rows[2]["num_appeared"] == rows[2]["num_disappeared"] == 1
    state = {r["cluster_id"]: r for r in D.drift_state(drift, 2).collect()}
    assert set(state) == {1, 2} and state[1]["age"] == 2 and state[2]["age"] == 1


def test_empty_snapshot_ends_lives(spark):
    moves = spark.createDataFrame([(1, 0, [0.0, 0.0]), (3, 0, [5.0, 0.0])], "step bigint, cluster_id bigint, centroid array<double>")
    steps = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 3.0, 1.0)], "step bigint, ts double, dt double")
    _, summary = D.drift_update(moves, steps=steps)
    rows = {r["step"]: r for r in summary.collect()}
    assert rows[2]["disappeared"] == [0] and rows[3]["appeared"] == [0] and rows[3]["stable"] == []


def test_bad_input(spark):
    with pytest.raises(ValueError, match="ema_alpha"):
        D.per_cluster_drift(snaps(spark, [{0: (0, 0)}]), ema_alpha=1.5)
    with pytest.raises(ValueError, match="at least one"):
        D.high_drift(snaps(spark, [{0: (0, 0)}]))
    with pytest.raises(Exception, match="contains NaN/inf"):
        D.sane_centroids(snaps(spark, [{0: (float("nan"), 0)}])).collect()
    arrivals = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 4.0)], "seq bigint, ts double")
    with pytest.raises(Exception, match="must be increasing"):
        D.check_time_order(arrivals).collect()
    assert [r["late"] for r in D.check_time_order(arrivals, strict=False).orderBy("seq").collect()] == [False, True, False]


@pytest.mark.parametrize("chunk", [4, 1024])
def test_against_a_tracker(spark, chunk):
    """Many short chunks and one long chunk give what walking step by step gives."""
    rng = np.random.default_rng(11)
    steps = [{c: rng.normal(0, 3, 2) for c in range(3) if rng.random() < 0.85} for _ in range(70)]
    got = {(r["step"], r["cluster_id"]): r for r in D.per_cluster_drift(snaps(spark, steps), ema_alpha=0.3, chunk=chunk).collect()}
    before, age, ema = {}, {}, {}
    for s, now in enumerate(steps, 1):
        for c in set(before) - set(now):
            assert got[(s, c)]["state"] == "disappeared"
            age.pop(c), ema.pop(c, None)
        for c, p in now.items():
            r = got[(s, c)]
            if c not in before:
                age[c] = 1
                assert r["state"] == "appeared"
            else:
                d = float(np.linalg.norm(p - before[c]))
                ema[c] = 0.3 * d + 0.7 * ema.get(c, d)
                age[c] += 1
                assert r["distance"] == pytest.approx(d) and r["ema_distance"] == pytest.approx(ema[c])
            assert r["age"] == age[c]
        before = now


def test_high_drift(spark):
    moves = snaps(spark, [{0: (0, 0), 1: (0, 0)}, {0: (5, 0), 1: (0.1, 0), 2: (9, 9)}])
    drift = D.per_cluster_drift(moves, ema_alpha=0.5)
    state = D.drift_state(drift, 2)
    assert [r["cluster_id"] for r in D.high_drift(state, distance_threshold=1.0).collect()] == [0]
    assert [r["cluster_id"] for r in D.high_drift(state, speed_threshold=0.05).orderBy("cluster_id").collect()] == [0, 1]
    plain = D.drift_state(D.per_cluster_drift(moves), 2)
    assert D.high_drift(plain, speed_threshold=0.0).count() == 0


def test_ordered_index_over_buckets(spark):
    rng = np.random.default_rng(2)
    # a third of the rows share one key and one time
    rows = [(int(k), float(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 600), rng.integers(0, 40, 600)))]
    rows += [(7, 5.0, 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, t double, id bigint").repartition(5)
    got = {r["id"]: r["rn"] for r in ordered_index(df, ["t", "id"], rows_per_bucket=50).collect()}
    assert got == {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    keyed = {r["id"]: r["rn"] for r in ordered_index(df, ["t", "id"], key=["k"], rows_per_bucket=50).collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        assert [keyed[r[2]] for r in mine] == list(range(1, len(mine) + 1))
    sizes = [r["count"] for r in fixed_batches(df, 64, ["t", "id"], rows_per_bucket=100).groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [64] * 14 + [4]


def test_affine_scan_levels(spark):
    df = spark.range(200).select(F.lit("a").alias("k"), F.col("id").alias("pos"))
    maps = {"s": (F.when(F.col("pos") % 50 == 0, 0.0).otherwise(1.0), F.lit(1.0))}
    got = {r["pos"]: r["s"] for r in affine_scan(df, ["k"], "pos", maps, 200, chunk=5).collect()}
    assert got == {i: float(i % 50 + 1) for i in range(200)}


def test_histories(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "k string, t bigint")
    kept = {tuple(r) for r in H.last_n(df, 3, ["k"], ["t"]).collect()}
    assert kept == {("a", 8), ("a", 7), ("a", 6), ("b", 1)}
    assert H.recent_logs(df.withColumnRenamed("t", "timestamp"), 0).count() == 0
    cells = H.trajectories(snaps(spark, [{0: (0, 0)}, {1: (1, 1)}])).collect()
    assert {(r["step"], r["cluster_id"]): r["centroid"] for r in cells} == {
        (1, 0): [0.0, 0.0], (1, 1): None, (2, 0): None, (2, 1): [1.0, 1.0]
    }


def test_steps_of_timestamps(spark):
    times = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT timestamp'2024-01-01 00:00:02.5'")
    from murmura.operators.drift import number_steps

    assert [(r["step"], r["dt"]) for r in number_steps(times).orderBy("step").collect()] == [(1, 1.0), (2, 2.5)]
