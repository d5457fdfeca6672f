"""The online model: against a plain walk through the same rules, and in known scenarios."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.functions.durable import cut_lineage
from murmura.operators.assign import absorb
from murmura.operators.drift import per_cluster_drift
from murmura.operators import online
from murmura.operators.online import OnlineClusterer, OnlineConfig, macro_clusters, run_batches

CFG = OnlineConfig(epsilon=0.5, n_samples_init=30, stream_speed=10, decay_factor=0.05)


def radius(w, cf1, cf2):
    """Root of the mean squared distance to the centre."""
    return math.sqrt(max(sum(q / w - (s / w) ** 2 for q, s in zip(cf2, cf1)), 0))


def walk(batches, cfg):
    """Micro-clusters {id: [status, n, w, cf1, cf2, created, last]} of one stream, rule by rule."""
    live, held, seen, warm, last_prune, clock = {}, [], 0, False, None, 0.0
    for batch in batches:
        seen += len(batch)
        now = max(float(seen // cfg.stream_speed), clock)
        clock = now
        last_prune = now if last_prune is None else last_prune
        points = held + [(i, np.array(x), now) for i, x in batch]
        if not warm and seen < cfg.n_samples_init:
            held = points
            continue
        warm, held = True, []
        for mc in live.values():
            f = 2 ** (-cfg.decay_factor * (now - mc[6]))
            mc[2], mc[3], mc[4], mc[6] = mc[2] * f, mc[3] * f, mc[4] * f, now
        taken, rest = {}, []
        for i, x, t in points:
            home = None
            for status in ("p", "o"):
                near = sorted((float(np.linalg.norm(x - mc[3] / mc[2])), k) for k, mc in live.items() if mc[0] == status)
                if near and home is None:
                    d, k = near[0]
                    if radius(live[k][2] + 1, live[k][3] + x, live[k][4] + x * x) <= cfg.epsilon:
                        home = (k, math.floor(d / (cfg.epsilon / 8)))
            if home is None:
                rest.append((i, x, t))
            else:
                taken.setdefault(home[0], {}).setdefault(home[1], []).append((i, x, t))

        def sums(group):
            f = np.array([2 ** (-cfg.decay_factor * (now - t)) for _, _, t in group])
            xs = np.array([x for _, x, _ in group])
            return len(group), f.sum(), (f[:, None] * xs).sum(0), (f[:, None] * xs * xs).sum(0)

        for k, rings in taken.items():
            total, full = list(live[k]), False
            for ring in sorted(rings):
                n, w, s, q = sums(rings[ring])
                trial = [total[0], total[1] + n, total[2] + w, total[3] + s, total[4] + q, *total[5:]]
                # the radius is judged with every ring up to here, taken or not
                total = trial
                full = full or radius(trial[2], trial[3], trial[4]) > cfg.epsilon
                if full:
                    rest += rings[ring]
                else:
                    live[k] = trial
        cells = {}
        side = 2 * cfg.epsilon / math.sqrt(2)
        for point in rest:
            cells.setdefault(tuple(np.floor(point[1] / side)), []).append(point)
        for group in cells.values():
            n, w, s, q = sums(group)
            live[min(p[0] for p in group)] = ["o", n, w, s, q, min(p[2] for p in group), now]
        for mc in live.values():
            if mc[0] == "o" and mc[2] >= cfg.core_weight:
                mc[0] = "p"
        if now - last_prune >= cfg.period:
            last_prune = now
            for k in list(live):
                mc = live[k]
                floor = (2 ** (-cfg.decay_factor * (now - mc[5] + cfg.period)) - 1) / (2 ** (-cfg.decay_factor * cfg.period) - 1)
                if mc[2] < (cfg.core_weight if mc[0] == "p" else floor):
                    del live[k]
    return live, held, seen


def as_frame(spark, batches):
    rows = [(k, b, i, [float(v) for v in x]) for k, bs in batches.items() for b, pts in enumerate(bs) for i, x in pts]
    return spark.createDataFrame(rows, "k string, b bigint, pt_id bigint, features array<double>")


def test_update_against_a_walk(spark):
    rng = np.random.default_rng(6)
    streams, start = {}, 0
    for key, sizes in {"a": [40, 60, 500, 30], "b": [10, 12, 25, 5], "c": [3, 3, 0, 4]}.items():
        streams[key] = []
        for n in sizes:
            centre = np.array([(-2.0, 0.0), (2.0, 0.5)])[rng.integers(0, 2, n)]
            xy = centre + rng.normal(0, 0.6, (n, 2))
            streams[key].append([(start + i, tuple(p)) for i, p in enumerate(xy)])
            start += n
    points = as_frame(spark, streams).cache()
    clusterer = OnlineClusterer(CFG, ["k"])
    state = clusterer.empty_state(spark, points)
    for b in range(4):
        state = cut_lineage(clusterer.update(state, points.where(F.col("b") == b)))
    rows = state.collect()
    for key, batches in streams.items():
        live, held, seen = walk([b for b in batches if b], CFG)
        mine = {r["mc_id"]: r for r in rows if r["k"] == key and r["status"] in ("p", "o")}
        assert set(mine) == set(live)
        for i, mc in live.items():
            r = mine[i]
            assert (r["status"], r["n"]) == (mc[0], mc[1])
            # a stream without points in the last batch is faded only when it is read
            f = 2 ** (-CFG.decay_factor * (mc[6] - r["t_last"]))
            assert r["w"] * f == pytest.approx(mc[2]) and [v * f for v in r["cf1"]] == pytest.approx(list(mc[3]))
        assert {r["mc_id"] for r in rows if r["k"] == key and r["status"] == "buffer"} == {p[0] for p in held}
        assert [r["n"] for r in rows if r["k"] == key and r["status"] == "clock"] == [seen]


def test_epsilon_holds_wherever_the_origin_is(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1.0, (300, 2))
    shifts = {"here": np.array([0.0, 0.0]), "there": np.array([300.0, 50.0])}
    rows = [(k, 0, i, [float(a), float(b)]) for k, by in shifts.items() for i, (a, b) in enumerate(base + by)]
    points = spark.createDataFrame(rows, "k string, b int, pt_id bigint, features array<double>")
    state = spark.createDataFrame(
        [(k, 1, "p", 100.0, [float(100 * v) for v in by], [float(100 * (v * v + 0.02)) for v in by]) for k, by in shifts.items()],
        "k string, mc_id bigint, status string, w double, cf1 array<double>, cf2 array<double>")
    taken = {(r["k"], r["pt_id"]) for r in absorb(points, state, 0.22, ["k"]).where("mc_id is not null").collect()}
    here, there = ({i for k, i in taken if k == side} for side in shifts)
    assert here == there and 0 < len(here) < 300
    cfg = OnlineConfig(epsilon=0.5, n_samples_init=50)
    clusterer = OnlineClusterer(cfg, ["k"])
    for b in (points.where("pt_id < 150"), points.where("pt_id >= 150")):
        state = cut_lineage(clusterer.update(state if "n" in state.columns else clusterer.empty_state(spark, points), b))
        for r in state.where("status in ('p', 'o')").collect():
            assert radius(r["w"], r["cf1"], r["cf2"]) <= cfg.epsilon + 1e-6
    with pytest.raises(Exception, match="coordinates"):
        clusterer.update(state, points.withColumn("features", F.array(F.lit(0.0), F.lit(0.0), F.lit(9.0)))).count()


def shown(state):
    """Rows of a state without what depends on the order of sums, and the sums."""
    rows = sorted(state.collect(), key=lambda r: (r["k"], r["status"], r["mc_id"]))
    return [(r["k"], r["status"], r["mc_id"], r["n"], r["t_created"], r["t_last"]) for r in rows], [
        v for r in rows for v in (r["w"], *r["cf1"], *r["cf2"])]


def test_runs_of_batches_against_updates(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows, start = [], 0
    for key, sizes in {"a": [20, 30, 90, 0, 60, 25, 70], "b": [10, 12, 4, 5, 0, 0, 3], "c": [1, 0, 2, 0, 0, 3, 0]}.items():
        for b, n in enumerate(sizes):
            xy = np.array([(-2.0, 0.0), (2.0, 0.5)])[rng.integers(0, 2, n)] + rng.normal(0, 0.6, (n, 2))
            rows += [(key, b + 3, start + i, [float(v) for v in p], float(40 * b + i // 9) if i % 7 else None) for i, p in enumerate(xy)]
            start += n
    timed = spark.createDataFrame(rows, "k string, batch_id bigint, pt_id bigint, features array<double>, t double").cache()
    calls = []
    plain = OnlineClusterer.update
    monkeypatch.setattr(OnlineClusterer, "update", lambda *a: calls.append(1) or plain(*a))
    cfg = OnlineConfig(epsilon=0.5, n_samples_init=30, stream_speed=10, decay_factor=0.05)
    for points in (timed, timed.drop("t")):
        clusterer = OnlineClusterer(cfg, ["k"])
        expected = clusterer.empty_state(spark, points)
        for b in range(3, 10):
            expected = cut_lineage(clusterer.update(expected, points.where(F.col("batch_id") == b)))
        keys, sums = shown(expected)
        assert {"p", "o", "buffer", "clock"} == {k[1] for k in keys}
        for rows_at_once in (1 << 18, 200):
            monkeypatch.setattr(online, "RUN_ROWS", rows_at_once)
            calls.clear()
            mine, totals = shown(run_batches(clusterer, points, 3, 9))
            # One job a run, none a batch.
            assert not calls and mine == keys and totals == pytest.approx(sums)
    # Larger batches, and points without a coordinate, are for the update.
    monkeypatch.setattr(online, "RUN_ROWS", 80)
    assert shown(run_batches(clusterer, points, 3, 9))[0] == keys and len(calls) == 7
    monkeypatch.setattr(online, "RUN_ROWS", 1 << 18)
    calls.clear()
    lost = points.withColumn("features", F.when(F.col("pt_id") != 4, F.col("features")).otherwise(F.array(F.lit(None).cast("double"), F.lit(1.0))))
    run_batches(clusterer, lost, 3, 4)
    assert len(calls) == 2


def test_a_run_with_one_name_twice_is_left_to_updates(spark):
    rows = [("k", 1, 5, [0.0, 0.0]), ("k", 1, 6, [0.1, 0.0]), ("k", 2, 5, [9.0, 9.0]), ("k", 2, 7, [9.1, 9.0])]
    points = spark.createDataFrame(rows, "k string, batch_id bigint, pt_id bigint, features array<double>").cache()
    clusterer = OnlineClusterer(OnlineConfig(epsilon=0.5, n_samples_init=1), ["k"])
    expected = clusterer.empty_state(spark, points)
    for b in (1, 2):
        expected = cut_lineage(clusterer.update(expected, points.where(F.col("batch_id") == b)))
    assert shown(run_batches(clusterer, points, 1, 2)) == shown(expected)


def scenario_batches():
    """Four streams: steady, drifting, a cluster comes and another goes, growing noise."""
    def batch(rng, centres, per, noise):
        centres = np.asarray(centres, dtype=float)
        xy = centres[:, None, :] + rng.normal(0, 0.5, (len(centres), per, 2))
        lost = rng.uniform(-8, 8, (int(per * len(centres) * noise), 2))
        return np.vstack([xy.reshape(-1, 2), lost])

    out = {}
    rng = np.random.default_rng(42)
    out["steady"] = [batch(rng, [(-4, 0), (0, 4), (4, 0)], 60, 0.02) for _ in range(8)]
    rng = np.random.default_rng(1)
    base = np.array([(-3.0, 0.0), (0.0, 3.0), (3.0, 0.0)])
    out["drift"] = [batch(rng, base + np.array([0.2 * s, 0.1 * s]), 50, 0.03) for s in range(6)]
    rng = np.random.default_rng(7)
    two, new = [(-3, 0), (3, 0)], (0, 4)
    out["change"] = [batch(rng, two if s < 3 else [*two, new] if s < 6 else [two[0], new], 60, 0.02) for s in range(9)]
    rng = np.random.default_rng(9)
    out["noise"] = [batch(rng, [(-4, -2), (4, 2)], 60, n) for n in (0.0, 0.05, 0.1, 0.2, 0.3)]
    return out


def test_scenarios(spark):
    start, streams = 0, {}
    for key, batches in scenario_batches().items():
        streams[key] = []
        for xy in batches:
            streams[key].append([(start + i, tuple(p)) for i, p in enumerate(xy)])
            start += len(xy)
    points = as_frame(spark, streams).cache()
    # The bounds below are those of the form with vector lengths.
    clusterer = OnlineClusterer(OnlineConfig(radius_form="norms"), ["k"])
    state = clusterer.empty_state(spark, points)
    counts, snapshots = {k: [] for k in streams}, []
    for b in range(9):
        state = cut_lineage(clusterer.update(state, points.where(F.col("b") == b)))
        active = clusterer.clusters(state).where("status = 'active'").select("k", "mc_id", "centroid").collect()
        for key, batches in streams.items():
            if b < len(batches):
                mine = [r for r in active if r["k"] == key]
                counts[key].append(len(mine))
                if key == "drift":
                    snapshots += [(b + 1, r["mc_id"], r["centroid"]) for r in mine]
    steady = counts["steady"][3:]
    assert min(steady) > 0 and max(abs(c - np.median(steady)) for c in steady) <= 3
    change = counts["change"]
    assert np.mean(change[3:6]) > np.mean(change[:3]) and np.mean(change[6:]) <= np.mean(change[3:6]) + 1
    assert max(counts["noise"]) <= max(counts["noise"][:2]) + 6
    snaps = spark.createDataFrame(snapshots, "step bigint, cluster_id bigint, centroid array<double>")
    means = [r[1] for r in per_cluster_drift(snaps).groupBy("step").agg(F.avg("distance").alias("d")).where("d is not null").collect()]
    assert len(means) >= 3 and max(means) > min(means)


def test_macro_clusters(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.9, 0.0]), (3, [1.8, 0.0]), (7, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "mc_id bigint, centroid array<double>")
    for bound in (10, None):
        got = {r["mc_id"]: r["macro"] for r in macro_clusters(df, 0.5, group_bound=bound).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 7: 7}


def test_config():
    assert OnlineConfig.from_dict({"epsilon": 1.0, "other": 2}).epsilon == 1.0
    assert OnlineConfig().configured(mu=None, x=1) == OnlineConfig()
    assert OnlineConfig().period == 233
    for bad in ({"beta": 0.4}, {"epsilon": 0}, {"decay_factor": 0}, {"stream_speed": 0}):
        with pytest.raises(ValueError):
            OnlineConfig(**bad)
