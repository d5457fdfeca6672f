"""A run of mini-batches of one stream, folded one after the other over arrays.

Mini-batches of a stream follow one another: the next starts from the state the last one left. Where they are small, a job
for each costs far more than its points, so a task takes a run of bounded length and the state of its stream.
The rules are those of ``OnlineClusterer.update``, which the tests compare batch by batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Micro-clusters compared with a mini-batch at a time.
AT_ONCE = 1 << 10
#: Status of a row that says the run is void: two micro-clusters got one name, or a sum left the range of doubles.
CLASH = "clash"


@dataclass
class Live:
    """Micro-clusters as arrays, ordered by name."""

    mc_id: np.ndarray
    potential: np.ndarray
    n: np.ndarray
    w: np.ndarray
    cf1: np.ndarray
    cf2: np.ndarray
    t_created: np.ndarray
    t_last: np.ndarray

    def take(self, rows: np.ndarray) -> Live:
        return Live(*[v[rows] for v in vars(self).values()])

    def with_more(self, more: Live) -> Live:
        both = Live(*[np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(more).values())])
        return both.take(np.argsort(both.mc_id, kind="stable"))


def vectors(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), dims)


def halvings(elapsed: np.ndarray) -> np.ndarray:
    """2 to the power of -``elapsed``, by the same function as single numbers: a fresh point meets its floor to the last digit."""
    values, of = np.unique(elapsed, return_inverse=True)
    return np.array([2.0 ** -v for v in values.tolist()])[of.reshape(-1)] if len(values) else elapsed


def squared_radius(w: np.ndarray, cf1: np.ndarray, cf2: np.ndarray, form: str) -> np.ndarray:
    w = w[..., None]
    if form == "norms":
        spread = np.sqrt((cf2 * cf2).sum(-1)) / w[..., 0] - (np.sqrt((cf1 * cf1).sum(-1)) / w[..., 0]) ** 2
    else:
        spread = (cf2 / w - (cf1 / w) ** 2).sum(-1)
    return np.maximum(spread, 0.0)


def nearest(at: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, index) of the nearest centre, ties to the first."""
    best, index = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    for first in range(0, len(centres), AT_ONCE):
        part = centres[first: first + AT_ONCE]
        dist = np.sqrt(sum((at[:, None, i] - part[None, :, i]) ** 2 for i in range(at.shape[1])))
        column = dist.argmin(axis=1)
        value = dist[np.arange(len(at)), column]
        nearer = value < best
        best[nearer], index[nearer] = value[nearer], column[nearer] + first
    return best, index


def absorbed(at: np.ndarray, live: Live, epsilon: float, form: str) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``live`` that takes each point or -1, distance to it), as ``assign.absorb``; without a potential one none takes."""
    taker, length = np.full(len(at), -1), np.zeros(len(at))
    if not live.potential.any():
        return taker, length
    for rows in (np.flatnonzero(live.potential), np.flatnonzero(~live.potential)):
        open_ = np.flatnonzero(taker < 0)
        if len(rows) and len(open_):
            x = at[open_]
            dist, index = nearest(x, live.cf1[rows] / live.w[rows][:, None])
            near = rows[index]
            merged = squared_radius(live.w[near] + 1, live.cf1[near] + x, live.cf2[near] + x * x, form)
            fits = np.sqrt(merged) <= epsilon
            taker[open_[fits]], length[open_[fits]] = near[fits], dist[fits]
    return taker, length


def totals(group: np.ndarray, size: int, f: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, w, cf1, cf2) of points by ``group``, numbers from 0 to ``size``."""
    add = lambda v: np.bincount(group, v, size)
    columns = range(at.shape[1])
    return (np.bincount(group, minlength=size), add(f), np.stack([add(f * at[:, i]) for i in columns], axis=1),
            np.stack([add(f * at[:, i] * at[:, i]) for i in columns], axis=1))


def stepped(live: Live, ids: np.ndarray, at: np.ndarray, t: np.ndarray, now: float, prune: bool, cfg, rings: int) -> Live:
    """``live`` after a mini-batch of points."""
    fading = halvings(cfg.decay_factor * (now - live.t_last))
    live = Live(live.mc_id, live.potential, live.n, live.w * fading, live.cf1 * fading[:, None], live.cf2 * fading[:, None],
                live.t_created, np.full(len(live.w), now))
    f = halvings(cfg.decay_factor * (now - t))
    taker, dist = absorbed(at, live, cfg.epsilon, cfg.radius_form)
    left = taker < 0
    inside = np.flatnonzero(~left)
    if len(inside):
        ring = np.floor(dist[inside] / (cfg.epsilon / rings)).astype(np.int64)
        size = len(live.w)
        W, S, Q, full = live.w.copy(), live.cf1.copy(), live.cf2.copy(), np.zeros(size, bool)
        gain = [np.zeros(size, np.int64), np.zeros(size), np.zeros_like(live.cf1), np.zeros_like(live.cf2)]
        for of in np.unique(ring):
            mine = inside[ring == of]
            new = totals(taker[mine], size, f[mine], at[mine])
            hit = new[0] > 0
            # The radius is judged with every ring up to here, taken or not.
            W[hit], S[hit], Q[hit] = W[hit] + new[1][hit], S[hit] + new[2][hit], Q[hit] + new[3][hit]
            full[hit] |= np.sqrt(squared_radius(W[hit], S[hit], Q[hit], cfg.radius_form)) > cfg.epsilon
            kept = hit & ~full
            for total, more in zip(gain, new):
                total[kept] += more[kept]
            left[mine] = full[taker[mine]]
        live.n, live.w, live.cf1, live.cf2 = live.n + gain[0], live.w + gain[1], live.cf1 + gain[2], live.cf2 + gain[3]
    rest = np.flatnonzero(left)
    if len(rest):
        side = 2 * cfg.epsilon / math.sqrt(at.shape[1])
        cells, of = np.unique(np.floor(at[rest] / side) + 0.0, axis=0, return_inverse=True)
        of, size = of.reshape(-1), len(cells)
        n, w, cf1, cf2 = totals(of, size, f[rest], at[rest])
        first, born = np.full(size, np.iinfo(np.int64).max), np.full(size, np.inf)
        np.minimum.at(first, of, ids[rest])
        np.minimum.at(born, of, t[rest])
        live = live.with_more(Live(first, np.zeros(size, bool), n, w, cf1, cf2, born, np.full(size, now)))
    live.potential = live.potential | (live.w >= cfg.core_weight)
    if prune:
        top = halvings(cfg.decay_factor * (now - live.t_created + cfg.period)) - 1
        floor = top / (2.0 ** (-cfg.decay_factor * cfg.period) - 1)
        live = live.take(np.flatnonzero(live.w >= np.where(live.potential, cfg.core_weight, floor)))
    return live


def folded(points: pa.Table, state: pa.Table, cfg, dims: int, timed: bool, rings: int, clock_id: int) -> dict[str, list]:
    """State columns, without keys, of one stream after the mini-batches ``__b`` of ``points`` (pt_id, features, t) in turn."""
    status = np.array(state["status"].to_pylist(), dtype=object)
    column = {c: state[c].to_numpy() for c in ("mc_id", "n", "w", "t_created", "t_last")}
    mine = np.flatnonzero((status == "p") | (status == "o"))
    held, clock = np.flatnonzero(status == "buffer"), np.flatnonzero(status == "clock")
    body = lambda c, rows: vectors(state[c].take(pa.array(rows)), dims)
    live = Live(column["mc_id"][mine], status[mine] == "p", column["n"][mine], column["w"][mine], body("cf1", mine), body("cf2", mine),
                column["t_created"][mine], column["t_last"][mine])
    live = live.take(np.argsort(live.mc_id, kind="stable"))
    waiting = (column["mc_id"][held], body("cf1", held), column["t_created"][held])
    seen, warm, last_prune, last = (0, False, None, None) if not len(clock) else (
        int(column["n"][clock[0]]), column["w"][clock[0]] > 0, float(column["t_created"][clock[0]]), float(column["t_last"][clock[0]]))
    clash = len(np.unique(live.mc_id)) < len(live.mc_id)
    ids, at, when, number = points["pt_id"].to_numpy(), vectors(points["features"], dims), points["t"].to_numpy(), points["__b"].to_numpy()
    order = np.lexsort((ids, number))
    for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []:
        seen += len(part)
        t = when[part]
        latest = np.nanmax(t) if not np.isnan(t).all() else None
        if latest is None and last is not None and timed:
            now = last
        else:
            now = max(float(seen // cfg.stream_speed) if latest is None else float(latest), last or 0.0)
        warm = warm or seen >= cfg.n_samples_init
        last_prune = now if last_prune is None else last_prune
        prune = now - last_prune >= cfg.period
        batch = (np.concatenate([waiting[0], ids[part]]), np.concatenate([waiting[1], at[part]]),
                 np.concatenate([waiting[2], np.where(np.isnan(t), now, t)]))
        if warm:
            try:
                with np.errstate(divide="raise", invalid="raise", over="raise"):
                    live, waiting = stepped(live, *batch, now, prune, cfg, rings), tuple(v[:0] for v in batch)
            except FloatingPointError:
                clash = True
            clash = clash or bool((np.diff(live.mc_id) == 0).any())
            if clash:
                break
        else:
            waiting = batch
        last, last_prune = now, now if prune else last_prune
    one, ticks = len(waiting[0]), int(last is not None)
    out = {
        "mc_id": [*live.mc_id, *waiting[0], *[clock_id] * ticks],
        "status": [*np.where(live.potential, "p", "o").tolist(), *["buffer"] * one, *["clock"] * ticks],
        "n": [*live.n, *[1] * one, *[seen] * ticks], "w": [*live.w, *[1.0] * one, *[float(warm)] * ticks],
        "cf1": [*live.cf1, *waiting[1], *[[]] * ticks], "cf2": [*live.cf2, *(waiting[1] * waiting[1]), *[[]] * ticks],
        "t_created": [*live.t_created, *waiting[2], *[last_prune] * ticks], "t_last": [*live.t_last, *waiting[2], *[last] * ticks],
    }
    if clash:
        out = {c: [*v, {"status": CLASH, "cf1": [], "cf2": []}.get(c)] for c, v in out.items()}
    return out
