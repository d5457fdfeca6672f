"""Registered queries: metrics, sizes, centroids, purity."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.operators import quality as Q
from murmura.operators.silhouette import silhouette
from murmura.plans.registry import query
from murmura.plans.views import BATCH, CLUSTERS, EMB, PTS, clusters, emb, featured, pts
from murmura.operators.clusters import average_density, cluster_summary


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# Mean silhouette of labelled 2-D points ``p(batch_id, pt_id, label, x, y)``; ``name`` goes before the names of the tables.
def silhouette_sql(source: str, where: str, clustered: str = "TRUE", dist: str | None = None, name: str = "") -> str:
    dist = dist or "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
    return f"""{name}p AS (SELECT * FROM {source} WHERE {where}),
{name}d AS (SELECT a.batch_id, a.pt_id, a.label AS la, b.label AS lb, avg({dist}) AS m
      FROM {name}p a JOIN {name}p b ON a.batch_id = b.batch_id AND a.pt_id <> b.pt_id GROUP BY 1, 2, 3, 4),
{name}ab AS (SELECT batch_id, pt_id, la, min(CASE WHEN la = lb THEN m END) AS a, min(CASE WHEN la <> lb THEN m END) AS b
       FROM {name}d GROUP BY 1, 2, 3),
{name}s AS (SELECT batch_id, la, a, CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM {name}ab),
{name}sil AS (SELECT batch_id,
               CASE WHEN count(DISTINCT CASE WHEN {clustered} THEN la END) >= 2 AND count(a) > 0
                    THEN avg(s) END AS silhouette_score
        FROM {name}s GROUP BY 1)"""


EMB_DIST = "list_distance(a.features, b.features)"


@query("batch_metrics", f"""WITH {PTS}, {silhouette_sql('pts', 'label <> -1')}
SELECT c.batch_id, 'offline' AS model_name, n_samples, number_of_clusters, round(noise_ratio, 6) AS noise_ratio,
       round(silhouette_score, 6) AS silhouette_score, ts_us
FROM (SELECT batch_id, epoch_us(max(ts)) AS ts_us, count(*) AS n_samples, count(DISTINCT CASE WHEN label <> -1 THEN label END) AS number_of_clusters,
             avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END) AS noise_ratio FROM pts GROUP BY 1) c
LEFT JOIN sil ON c.batch_id = sil.batch_id""")
def _batch_metrics(spark, sf):
    points = featured(pts(spark, sf))
    return Q.batch_metrics(points, "offline", group_bound=BATCH).select(
        "batch_id", "model_name", "n_samples", "number_of_clusters", r6("noise_ratio"), r6("silhouette_score"),
        F.unix_micros("ts").alias("ts_us"),
    )


@query("silhouette", f"""WITH {EMB}, {silhouette_sql('emb', 'label <> -1', dist=EMB_DIST)}
SELECT batch_id, round(silhouette_score, 6) AS silhouette_score FROM sil""")
def _silhouette(spark, sf):
    return silhouette(emb(spark, sf)).select("batch_id", r6("silhouette_score"))


@query("silhouette_ui", f"""WITH {PTS}, {silhouette_sql('pts', 'TRUE', 'la <> -1')}
SELECT batch_id, round(silhouette_score, 6) AS silhouette_score FROM sil""")
def _silhouette_ui(spark, sf):
    return silhouette(featured(pts(spark, sf)), noise="as_cluster", group_bound=BATCH).select(
        "batch_id", r6("silhouette_score")
    )


@query("silhouette_sq", f"""WITH {PTS}, {silhouette_sql('pts', 'label <> -1', dist='((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))')}
SELECT batch_id, round(silhouette_score, 6) AS silhouette_score FROM sil""")
def _silhouette_sq(spark, sf):
    from murmura.operators.silhouette import silhouette_squared

    return silhouette_squared(featured(pts(spark, sf))).select("batch_id", r6("silhouette_score"))


@query("cluster_count", f"""WITH {PTS} SELECT batch_id, count(DISTINCT CASE WHEN label <> -1 THEN label END) AS number_of_clusters
FROM pts GROUP BY 1""")
def _cluster_count(spark, sf):
    return Q.cluster_count(pts(spark, sf))


@query("noise_ratio", f"""WITH {PTS} SELECT batch_id, round(avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_ratio
FROM pts GROUP BY 1""")
def _noise_ratio(spark, sf):
    return Q.noise_ratio(pts(spark, sf)).select("batch_id", r6("noise_ratio"))


@query("cluster_sizes", f"""WITH {PTS} SELECT batch_id, CAST(min(c) AS DOUBLE) AS min_size, round(avg(c), 6) AS mean_size,
CAST(max(c) AS DOUBLE) AS max_size FROM
(SELECT batch_id, label, count(*) AS c FROM pts WHERE label <> -1 GROUP BY 1, 2) GROUP BY 1""")
def _cluster_sizes(spark, sf):
    return Q.cluster_sizes(pts(spark, sf)).select("batch_id", "min_size", r6("mean_size"), "max_size")


@query("centroids", f"""WITH {PTS} SELECT batch_id, label, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n
FROM pts WHERE label <> -1 GROUP BY 1, 2""")
def _centroids(spark, sf):
    c = Q.centroids(featured(pts(spark, sf)), dims=2)
    return c.select(
        "batch_id", "label", F.round(F.get("centroid", F.lit(0)), 6).alias("cx"),
        F.round(F.get("centroid", F.lit(1)), 6).alias("cy"), "n",
    )


@query("centroids_nd", f"""WITH {EMB}, u AS (SELECT batch_id, label, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS dim
FROM emb WHERE label <> -1)
SELECT batch_id, label, CAST(dim AS BIGINT) AS dim, round(avg(v), 6) AS v FROM u GROUP BY 1, 2, 3""")
def _centroids_nd(spark, sf):
    c = Q.centroids(emb(spark, sf))
    return c.select("batch_id", "label", F.posexplode("centroid").alias("dim", "v")).select(
        "batch_id", "label", F.col("dim").cast("bigint").alias("dim"), r6("v")
    )


@query("purity", f"""WITH {PTS}, c AS (SELECT batch_id, label, user_id % 10 AS truth, count(*) AS n FROM pts WHERE label <> -1 GROUP BY 1, 2, 3)
SELECT batch_id, round(sum(b) / CAST(sum(n) AS DOUBLE), 6) AS purity
FROM (SELECT batch_id, label, max(n) AS b, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1""")
def _purity(spark, sf):
    labelled = pts(spark, sf).withColumn("truth", F.col("user_id") % 10)
    return Q.purity(labelled).select("batch_id", r6("purity"))


# Less than most clusters of a batch hold, so that parts are compared.
PART = 64


@query("points_by_label", f"""WITH {PTS}, r AS (SELECT batch_id, label, pt_id,
CAST(floor((row_number() OVER (PARTITION BY batch_id, label ORDER BY pt_id) - 1) / {PART}) AS BIGINT) AS part FROM pts)
SELECT batch_id, label, part, count(*) AS n, string_agg(CAST(pt_id AS VARCHAR), ',' ORDER BY pt_id) AS pt_ids FROM r GROUP BY 1, 2, 3""")
def _points_by_label(spark, sf):
    laid = Q.points_by_label(featured(pts(spark, sf)), part_rows=PART)
    return laid.select(
        "batch_id", "label", "part", F.size("points").cast("bigint").alias("n"),
        F.array_join(F.transform("points", lambda p: p["pt_id"].cast("string")), ",").alias("pt_ids"),
    )


@query("unique_batch_id", f"""WITH {PTS} SELECT user_id, CASE WHEN count(DISTINCT batch_id) = 1 THEN min(batch_id) END AS batch_id
FROM pts GROUP BY 1""")
def _unique_batch_id(spark, sf):
    return Q.unique_batch_id(pts(spark, sf), ["user_id"])


@query("count_stability", f"""WITH {PTS}, c AS (SELECT batch_id, label, count(DISTINCT user_id) AS number_of_clusters FROM pts WHERE batch_id > 3 GROUP BY 1, 2),
m AS (SELECT label, median(number_of_clusters) AS median_count FROM c GROUP BY 1)
SELECT c.label, round(CAST(any_value(median_count) AS DOUBLE), 6) AS median_count, round(avg(number_of_clusters), 6) AS mean_count,
       round(CAST(max(abs(number_of_clusters - median_count)) AS DOUBLE), 6) AS max_deviation
FROM c JOIN m ON c.label = m.label GROUP BY 1""")
def _count_stability(spark, sf):
    counts = pts(spark, sf).select("batch_id", "label", "user_id").distinct().groupBy("batch_id", "label").agg(
        F.count(F.lit(1)).alias("number_of_clusters")
    )
    return Q.count_stability(counts, ["label"]).select(
        "label", r6("median_count"), r6("mean_count"), r6("max_deviation")
    )


@query("cluster_summary", f"""WITH {CLUSTERS}, noise AS (SELECT batch_id, count(*) AS noise FROM pts WHERE label = -1 GROUP BY 1)
SELECT c.batch_id, count(*) AS total_clusters, CAST(sum(size) AS BIGINT) AS total_points, round(avg(density), 6) AS avg_density,
       round(any_value(coalesce(noise, 0)) / CAST(sum(size) + any_value(coalesce(noise, 0)) AS DOUBLE), 6) AS noise_ratio
FROM clusters c LEFT JOIN noise n ON c.batch_id = n.batch_id GROUP BY 1""")
def _cluster_summary(spark, sf):
    noise = pts(spark, sf).where("label = -1").groupBy("batch_id").agg(F.count(F.lit(1)).alias("noise_points"))
    return cluster_summary(clusters(spark, sf), ["batch_id"], noise).select(
        "batch_id", "total_clusters", "total_points", r6("avg_density"), r6("noise_ratio")
    )


@query("avg_density", f"""WITH {CLUSTERS} SELECT batch_id, round(avg(CASE WHEN status = 'active' THEN density END), 6) AS avg_density
FROM clusters GROUP BY 1""")
def _avg_density(spark, sf):
    return average_density(clusters(spark, sf), ["batch_id"]).select("batch_id", r6("avg_density"))
