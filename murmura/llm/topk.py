"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are ordered by length and cut into buckets of equal size, queries into blocks. A first pass meets every
query with the longest vectors only, which gives it a threshold: its k-th best score so far. A bucket whose longest
vector times the query's length stays below the threshold is never sent that query. For the rest the
bucket's local threshold, threshold / (query length * longest), is a cosine: where it is high, a
vector's strongest query coordinate must lie in a narrow range (coordinate pruning); where it is low,
vectors are cut by length alone. What is left is verified by its exact integer product.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmura.functions.durable import cut_lineage
from murmura.functions.ordering import ordered_index

BUCKET = 512
BLOCK = 512
COSINE = 0.4
_EXACT = 2.0**52


def integer_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(scale * x) of every component; vectors null or with a null or non-finite component are left out."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(
        F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("bigint")).alias("v"))


def _norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; through doubles where no partial sum can leave their exact range."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < _EXACT:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if most >= 2.0**62:
        raise OverflowError("inner products leave 64 bits")
    return q @ v.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _meet(k: int):
    """The k best candidates of one bucket for each query sent to it, pruned by the local cosine threshold."""

    def meet(key, queries: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(queries) or not len(bucket):
            return empty
        ids, v = bucket["id"].to_numpy(), _matrix(bucket["v"])
        length = np.sqrt(bucket["norm2"].to_numpy())
        longest = length.max()
        unit = v / np.maximum(length, 1e-300)[:, None]
        out = []
        q = _matrix(queries["v"])
        qids, qlen = queries["id"].to_numpy(), np.sqrt(queries["norm2"].to_numpy())
        # A double's rounding may not cost a candidate: thresholds give way a little.
        floor = queries["floor"].to_numpy(dtype=float)
        floor = floor - 1e-9 * np.abs(floor) - 1e-6
        cosine = np.where(qlen * longest > 0, floor / np.maximum(qlen * longest, 1e-300), -1.0)
        steep = (cosine >= COSINE) & (qlen > 0)
        plain = np.flatnonzero(~steep)
        if len(plain):
            # Length pruning: the bucket is in order of length, so what can count is a prefix.
            need = np.where(qlen[plain] > 0, floor[plain] / np.maximum(qlen[plain], 1e-300), -np.inf).min()
            live = np.flatnonzero(length >= need)
            scores = _products(q[plain], v[live]) if len(live) else np.zeros((len(plain), 0), np.int64)
            for n, p in enumerate(plain):
                out.append((p, live, scores[n]))
        for p in np.flatnonzero(steep):
            # Coordinate pruning: with f the strongest query coordinate and c the cosine needed, x must hold
            # f x + sqrt((1 - f f)(1 - x x)) >= c.
            strong = int(np.abs(q[p]).argmax())
            f = q[p, strong] / qlen[p]
            x = unit[:, strong]
            most = f * x + np.sqrt(np.maximum(0, 1 - f * f) * np.maximum(0, 1 - x * x))
            live = np.flatnonzero(most * length * qlen[p] >= floor[p])
            out.append((p, live, _products(q[p][None, :], v[live])[0] if len(live) else np.zeros(0, np.int64)))
        rows = []
        for p, live, score in out:
            mine = (ids[live] != qids[p]) & (score >= math.floor(floor[p]) if floor[p] > -np.inf else True)
            near, score = ids[live][mine], score[mine]
            best = _best(near, score, k)
            rows.append((np.full(len(best), qids[p]), near[best], score[best]))
        a, b, c = (np.concatenate(x) for x in zip(*rows, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    return meet


_HIT = "query_id bigint, vec_id bigint, score bigint"


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(
    rows: DataFrame, query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
    bucket: int = BUCKET, seeds: int = 2,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where ``query`` holds.

    Score is the inner product of floor(scale * x); ties go to the smaller id. Rows with a null id, and vectors null, empty or with null
    or non-finite components take no part; vectors meet those of their own width, a search for each width (of rows of one id with several
    widths, each width answers). Of rows that share an id each is a candidate of its own, and none meets its own id; one of them asks.
    Products beyond 64 bits raise. Buckets and thresholds decide only what is skipped, never the answer.
    """
    whole = integer_vectors(rows, scale, id_col, vector_col)
    widths = sorted(w for (w,) in whole.select(F.size("v")).where(F.size("v") > 0).distinct().collect())
    if not widths:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    flagged = integer_vectors(rows.withColumn(id_col, F.when(query, F.col(id_col))), scale, id_col, vector_col)
    found = [_of_width(whole, flagged, width, k, bucket, seeds) for width in widths]
    return reduce(DataFrame.unionByName, found)


def _of_width(whole: DataFrame, flagged: DataFrame, width: int, k: int, bucket: int, seeds: int) -> DataFrame:
    same = F.size("v") == width
    vectors = whole.where(same).withColumn("norm2", _norm2(F.col("v"))).withColumn("less", -F.col("norm2"))
    vectors = cut_lineage(ordered_index(vectors, ["less", "id"], out="place", rows_per_bucket=4 * bucket).select(
        F.floor((F.col("place") - 1) / bucket).cast("bigint").alias("bucket"), "id", "v", "norm2"))
    queries = cut_lineage(flagged.where(same).select("id", "v", _norm2(F.col("v")).alias("norm2")).dropDuplicates(["id"]))
    lengths = vectors.groupBy("bucket").agg(F.sqrt(F.max("norm2")).alias("longest"))

    def met(sent: DataFrame, candidates: DataFrame) -> DataFrame:
        # A bucket with its queries is bounded work: queries come in blocks.
        blocked = sent.withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        blocks = blocked.select("bucket", "block").distinct()
        copied = candidates.join(blocks, "bucket")
        left = blocked.select(F.col("bucket").alias("qb"), F.col("block").alias("qk"), "id", "v", "norm2", "floor")
        right = copied.select(F.col("bucket").alias("vb"), F.col("block").alias("vk"), "id", "v", "norm2")
        return left.groupBy("qb", "qk").cogroup(right.groupBy("vb", "vk")).applyInPandas(_meet(k), _HIT)

    n = queries.count()
    blocks = F.lit(max(1, -(-n // BLOCK))).cast("bigint")
    first = queries.select(
        "id", "v", "norm2", F.lit(float("-inf")).alias("floor"), blocks.alias("blocks"),
        F.explode(F.array(*[F.lit(b).cast("bigint") for b in range(seeds)])).alias("bucket"))
    seeded = cut_lineage(_ranked(met(first, vectors.where(F.col("bucket") < seeds)), k))
    floors = seeded.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    armed = cut_lineage(queries.join(floors, "id", "left").select(
        "id", "v", "norm2", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), blocks.alias("blocks")))
    # The bucket a query need not go beyond: buckets come in falling length, so one bound per query says it.
    sent = armed.join(
        lengths.where(F.col("bucket") >= seeds),
        F.sqrt("norm2") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("floor"))
    rest = met(sent, vectors.where(F.col("bucket") >= seeds))
    both = seeded.select("query_id", "vec_id", "score").unionByName(rest)
    return _ranked(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
