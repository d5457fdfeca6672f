"""Registered queries: assignment, online micro-clusters, offline clustering."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from murmura.functions.durable import cut_lineage
from murmura.functions.ordering import ordered_index
from murmura.operators import offline as O
from murmura.operators.blocks import dealt
from murmura.operators.assign import absorb, nearest_centroid, squared_radius
from murmura.operators.online import (
    OnlineClusterer, OnlineConfig, centre, fade, macro_clusters, run_batches, to_clusters,
)
from murmura.operators.quality import centroids
from murmura.plans.quality import r6
from murmura.plans.registry import query
from murmura.plans.views import BATCH, CLUSTERS, PTS, clusters, event_points, featured, pts

EPS = 15.0
LABELS = 5


@query("nearest_centroid", f"""WITH {PTS}, c AS (SELECT batch_id + 1 AS batch_id, label, avg(x) AS cx, avg(y) AS cy FROM pts WHERE label <> -1 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY label) - 1 AS pos FROM c),
d AS (SELECT p.batch_id, p.pt_id, r.pos, r.label, sqrt((p.x - r.cx) * (p.x - r.cx) + (p.y - r.cy) * (p.y - r.cy)) AS d FROM pts p LEFT JOIN r ON p.batch_id = r.batch_id)
SELECT batch_id, pt_id, coalesce(arg_min(pos, (d, pos)), -1) AS label, arg_min(label, (d, pos)) AS mc_id, round(min(d), 6) AS distance FROM d GROUP BY 1, 2""")
def _nearest_centroid(spark, sf):
    points = featured(pts(spark, sf))
    before = centroids(points, dims=2).select(
        (F.col("batch_id") + 1).alias("batch_id"), F.col("label").alias("mc_id"), "centroid"
    )
    near = nearest_centroid(points, before, ["batch_id"], bound=LABELS, dims=2)
    return near.select("batch_id", "pt_id", "label", "mc_id", r6("distance"))


# Micro-clusters of the batch before, two labels potential, the rest outliers.
ABSORB_EPS = 30.0
PREVIOUS = """c AS (SELECT batch_id + 1 AS batch_id, label AS mc_id, CASE WHEN label < 2 THEN 'p' ELSE 'o' END AS status,
  CAST(count(*) AS DOUBLE) AS w, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS qx, sum(y * y) AS qy,
  avg(x) AS mx, avg(y) AS my FROM pts WHERE label <> -1 GROUP BY 1, 2),
ss AS (SELECT c.batch_id, c.mc_id, sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS ss
  FROM c JOIN pts p ON p.batch_id + 1 = c.batch_id AND p.label = c.mc_id GROUP BY 1, 2)"""


@query("absorb", f"""WITH {PTS}, {PREVIOUS},
d AS (SELECT p.batch_id, p.pt_id, c.mc_id, c.status, sqrt((p.x - sx / w) * (p.x - sx / w) + (p.y - sy / w) * (p.y - sy / w)) AS d,
        (ss + w / (w + 1) * ((x - mx) * (x - mx) + (y - my) * (y - my))) / (w + 1) AS r2
      FROM pts p LEFT JOIN c ON p.batch_id = c.batch_id LEFT JOIN ss ON ss.batch_id = c.batch_id AND ss.mc_id = c.mc_id),
f AS (SELECT *, row_number() OVER (PARTITION BY batch_id, pt_id, status ORDER BY d, mc_id) AS rn, sqrt(greatest(r2, 0)) <= {ABSORB_EPS} AS fits FROM d),
n AS (SELECT batch_id, pt_id, max(CASE WHEN status = 'p' AND fits THEN mc_id END) AS p, max(CASE WHEN status = 'o' AND fits THEN mc_id END) AS o,
      max(CASE WHEN status = 'p' AND fits THEN d END) AS dp, max(CASE WHEN status = 'o' AND fits THEN d END) AS d_o FROM f WHERE rn = 1 GROUP BY 1, 2)
SELECT batch_id, pt_id, coalesce(p, o) AS mc_id, round(CASE WHEN p IS NOT NULL THEN dp ELSE d_o END, 6) AS distance FROM n""")
def _absorb(spark, sf):
    points = featured(pts(spark, sf))
    x, y = F.col("x"), F.col("y")
    before = points.where("label <> -1").groupBy(
        (F.col("batch_id") + 1).alias("batch_id"), F.col("label").alias("mc_id")
    ).agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.array(F.sum(x), F.sum(y)).alias("cf1"),
        F.array(F.sum(x * x), F.sum(y * y)).alias("cf2"),
    ).withColumn("status", F.when(F.col("mc_id") < 2, "p").otherwise("o"))
    taken = absorb(points, before, ABSORB_EPS, ["batch_id"], bound=LABELS, dims=2)
    return taken.select("batch_id", "pt_id", "mc_id", r6("distance"))


# One update of an empty state, each batch being a stream of its own; time is in minutes.
CONFIG = OnlineConfig(epsilon=EPS, n_samples_init=1)
SIDE = 2 * EPS / math.sqrt(2)
UPDATE = PTS + f""", tp AS (SELECT *, floor(epoch_us(ts) / CAST(60000000 AS DOUBLE)) AS t FROM pts),
tn AS (SELECT *, max(t) OVER (PARTITION BY batch_id) AS now FROM tp),
fp AS (SELECT *, pow(CAST(2 AS DOUBLE), CAST(-{CONFIG.decay_factor} AS DOUBLE) * (now - t)) AS f,
       floor(x / CAST({SIDE!r} AS DOUBLE)) AS gx, floor(y / CAST({SIDE!r} AS DOUBLE)) AS gy FROM tn),
mc AS (SELECT batch_id, gx, gy, min(pt_id) AS mc_id, count(*) AS n, sum(f) AS w, sum(f * x) AS sx, sum(f * y) AS sy,
       sum(f * x * x) AS qx, sum(f * y * y) AS qy, min(t) AS t_created, max(now) AS t_last FROM fp GROUP BY batch_id, gx, gy),
ms AS (SELECT *, CASE WHEN w >= {CONFIG.core_weight} THEN 'p' ELSE 'o' END AS status FROM mc)"""


def _updated(spark, sf):
    minutes = F.floor(F.unix_micros("ts") / F.lit(60e6)).cast("double")
    points = featured(pts(spark, sf)).withColumn("t", minutes)
    clusterer = OnlineClusterer(CONFIG, ["batch_id"], micro_clusters=BATCH)
    return clusterer, clusterer.fit(points)


@query("micro_cluster_update", f"""WITH {UPDATE}, sp AS (SELECT m.batch_id, m.gx, m.gy, sum(f * ((x - sx / w) * (x - sx / w) + (y - sy / w) * (y - sy / w))) AS ss
  FROM ms m JOIN fp USING (batch_id, gx, gy) GROUP BY 1, 2, 3)
SELECT batch_id, mc_id, status, n, round(w, 6) AS w, round(sx / w, 6) AS cx, round(sy / w, 6) AS cy,
round(sqrt(ss / w), 4) AS radius, t_created, t_last FROM ms JOIN sp USING (batch_id, gx, gy)""")
def _micro_cluster_update(spark, sf):
    _, state = _updated(spark, sf)
    # Columns made from w come first: a select that renames w would lend them the new one.
    shaped = state.where("status in ('p', 'o')").withColumns({
        "centre": centre(), "r2": squared_radius(F.col("w"), F.col("cf1"), F.col("cf2"))
    })
    return shaped.select(
        "batch_id", "mc_id", "status", "n", r6("w"), F.round(F.get("centre", F.lit(0)), 6).alias("cx"),
        F.round(F.get("centre", F.lit(1)), 6).alias("cy"), F.round(F.sqrt("r2"), 4).alias("radius"),
        "t_created", "t_last",
    )


@query("mc_to_clusters", f"""WITH {UPDATE} SELECT batch_id, CASE WHEN status = 'p' THEN 'active' ELSE 'decayed' END || '-' || mc_id AS id,
round(sx / w, 6) AS cx, round(sy / w, 6) AS cy, n AS size, round(w * pow(CAST(2 AS DOUBLE), CAST(-0.6 AS DOUBLE)), 6) AS density,
CASE WHEN status = 'p' THEN 'active' ELSE 'decayed' END AS status FROM ms""")
def _mc_to_clusters(spark, sf):
    _, state = _updated(spark, sf)
    later = fade(state.where("status in ('p', 'o')"), F.col("t_last") + 60, CONFIG.decay_factor)
    return to_clusters(later, ["batch_id"]).select(
        "batch_id", "id", F.round(F.get("centroid", F.lit(0)), 6).alias("cx"),
        F.round(F.get("centroid", F.lit(1)), 6).alias("cy"), "size", r6("density"), "status",
    )


@query("mc_prune", f"""WITH {UPDATE}, later AS (SELECT *, w * pow(CAST(2 AS DOUBLE), CAST(-1 AS DOUBLE)) AS w1, t_last + 100 AS now FROM ms)
SELECT batch_id, mc_id, status, round(w1, 6) AS w FROM later
WHERE CASE WHEN status = 'p' THEN w1 >= {CONFIG.core_weight}
  ELSE w1 >= (pow(CAST(2 AS DOUBLE), CAST(-{CONFIG.decay_factor} AS DOUBLE) * (now - t_created + {CONFIG.period})) - 1)
             / CAST({2.0 ** (-CONFIG.decay_factor * CONFIG.period) - 1!r} AS DOUBLE) END""")
def _mc_prune(spark, sf):
    clusterer, state = _updated(spark, sf)
    later = fade(state.where("status in ('p', 'o')"), F.col("t_last") + 100, CONFIG.decay_factor)
    return later.where(clusterer.prune_rule(F.col("t_last"))).select("batch_id", "mc_id", "status", r6("w"))


STREAM_BATCH = 2500


def _stream(spark, sf):
    """All events as one stream, cut into mini-batches of a fixed size."""
    numbered = ordered_index(event_points(spark, sf), ["ts", "pt_id"], out="seq")
    cut = numbered.withColumn("batch_id", F.floor((F.col("seq") - 1) / F.lit(STREAM_BATCH)).cast("bigint") + 1)
    return cut_lineage(dealt(featured(cut).select("pt_id", "features", "seq", "batch_id"), ["pt_id"]))


@query("micro_clusters")
def _micro_clusters(spark, sf):
    points = _stream(spark, sf)
    config = OnlineConfig(epsilon=EPS)
    timed = points.withColumn("t", F.floor((F.col("seq") - 1) / F.lit(config.stream_speed)).cast("double"))
    last = points.agg(F.max("batch_id")).first()[0]
    clusterer = OnlineClusterer(config)
    state = run_batches(clusterer, timed, 1, last)
    return clusterer.clusters(state)


@query("mc_warmup")
def _mc_warmup(spark, sf):
    """Each user is a stream; those with fewer events than the warm-up have no active cluster yet."""
    points = featured(event_points(spark, sf)).select("user_id", "pt_id", "features")
    clusterer = OnlineClusterer(OnlineConfig(epsilon=EPS, n_samples_init=70), ["user_id"], micro_clusters=1024)
    state = clusterer.fit(points)
    return state.groupBy("user_id").agg(
        F.max(F.when(F.col("status") == "clock", F.col("n"))).alias("seen"),
        F.count_if(F.col("status") == "buffer").alias("held"),
        F.count_if(F.col("status") == "p").alias("active"),
    )


@query("macro_clusters", f"""WITH RECURSIVE {CLUSTERS},
near AS (SELECT a.batch_id, a.label AS a, b.label AS b FROM clusters a JOIN clusters b ON a.batch_id = b.batch_id
         AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) <= 20),
reach AS (SELECT batch_id, a, b FROM near UNION SELECT r.batch_id, r.a, n.b FROM reach r JOIN near n ON r.batch_id = n.batch_id AND r.b = n.a)
SELECT batch_id, a AS mc_id, min(b) AS macro FROM reach GROUP BY 1, 2""")
def _macro_clusters(spark, sf):
    rows = clusters(spark, sf).select("batch_id", F.col("label").alias("mc_id"), "centroid")
    return macro_clusters(rows, 10.0, ["batch_id"], group_bound=LABELS).select("batch_id", "mc_id", "macro")


# --- offline -------------------------------------------------------------------------------

NEAR = """pairs AS (SELECT a.batch_id, a.pt_id, b.pt_id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM pts a JOIN pts b ON a.batch_id = b.batch_id AND a.pt_id <> b.pt_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, pt_id ORDER BY d, other) AS rn FROM pairs) WHERE rn <= 5),
core AS (SELECT batch_id, pt_id, max(d) AS core FROM near GROUP BY 1, 2)"""


@query("core_distance", f"WITH {PTS}, {NEAR} SELECT batch_id, pt_id, round(core, 6) AS core FROM core")
def _core_distance(spark, sf):
    return O.core_distances(featured(pts(spark, sf)), k=5, group_bound=BATCH).select("batch_id", "pt_id", r6("core"))


ALL_NEAR = """d AS (SELECT p.pt_id, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM pts p JOIN pts q ON p.pt_id <> q.pt_id)"""


@query("core_distance_all", f"WITH {PTS}, {ALL_NEAR} SELECT pt_id, round(list_max(min(d, 5)), 6) AS core FROM d GROUP BY 1")
def _core_distance_all(spark, sf):
    """All points as one group, searched through a tree of boxes."""
    return O.core_distances(featured(pts(spark, sf)), [], k=5).select("pt_id", r6("core"))


# Every fifth point is a centre, far more than fit an array.
EVERY = 5


@query("nearest_of_many", f"""WITH {PTS}, c AS (SELECT pt_id AS mc_id, x, y, row_number() OVER (ORDER BY pt_id) - 1 AS label FROM pts WHERE pt_id % {EVERY} = 0),
d AS (SELECT p.pt_id, c.mc_id, c.label, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS d FROM pts p, c WHERE p.pt_id % {EVERY} <> 0)
SELECT pt_id, arg_min(label, (d, mc_id)) AS label, arg_min(mc_id, (d, mc_id)) AS mc_id, round(min(d), 6) AS distance FROM d GROUP BY 1""")
def _nearest_of_many(spark, sf):
    """Points without keys and their nearest of very many centres."""
    points = featured(pts(spark, sf))
    centres = points.where(F.col("pt_id") % EVERY == 0).select(F.col("pt_id").alias("mc_id"), F.col("features").alias("centroid"))
    near = nearest_centroid(points.where(F.col("pt_id") % EVERY != 0), centres, dims=2)
    return near.select("pt_id", "label", "mc_id", r6("distance"))


@query("mutual_reach", f"""WITH {PTS}, {NEAR} SELECT DISTINCT n.batch_id, least(n.pt_id, n.other) AS a, greatest(n.pt_id, n.other) AS b,
round(greatest(n.d, p.core, q.core), 6) AS w FROM near n JOIN core p ON n.batch_id = p.batch_id AND n.pt_id = p.pt_id
JOIN core q ON n.batch_id = q.batch_id AND n.other = q.pt_id""")
def _mutual_reach(spark, sf):
    return O.mutual_reachability(featured(pts(spark, sf)), k=5, group_bound=BATCH).select("batch_id", "a", "b", r6("w"))


@query("mst_edges")
def _mst_edges(spark, sf):
    return O.mst_edges(featured(pts(spark, sf)), k=5, group_bound=BATCH)


CUT = 9.0


@query("density_cut", f"""WITH RECURSIVE {PTS}, {NEAR},
dense AS (SELECT * FROM core WHERE core <= {CUT}),
link AS (SELECT p.batch_id, p.pt_id AS a, p.other AS b FROM pairs p JOIN dense s ON p.batch_id = s.batch_id AND p.pt_id = s.pt_id
         JOIN dense t ON p.batch_id = t.batch_id AND p.other = t.pt_id WHERE p.d <= {CUT}),
reach AS (SELECT batch_id, pt_id AS a, pt_id AS b FROM dense UNION SELECT r.batch_id, r.a, l.b FROM reach r JOIN link l ON r.batch_id = l.batch_id AND r.b = l.a)
SELECT p.batch_id, p.pt_id, r.component FROM pts p LEFT JOIN (SELECT batch_id, a, min(b) AS component FROM reach GROUP BY 1, 2) r
ON p.batch_id = r.batch_id AND p.pt_id = r.a""")
def _density_cut(spark, sf):
    return O.density_cut(featured(pts(spark, sf)), CUT, k=5, group_bound=BATCH).select("batch_id", "pt_id", "component")


@query("offline_cluster")
def _offline_cluster(spark, sf):
    return O.offline_cluster(featured(pts(spark, sf)), min_cluster_size=5, group_bound=BATCH)


@query("offline_result")
def _offline_result(spark, sf):
    points = featured(pts(spark, sf))
    labels = O.offline_cluster(points, min_cluster_size=5, group_bound=BATCH)
    return O.offline_result(points, labels, group_bound=BATCH).select(
        "batch_id", "model_name", "n_samples", "number_of_clusters", r6("noise_ratio"), r6("silhouette_score"),
        "min_size", r6("mean_size"), "max_size",
    )
