"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets in words share the whole corpus by weight, none above ``max_repeat`` times its source.
Blocks of ``block`` words are the seats: sources receive them by highest quotients target / (2 s + 1),
and each source's seats go by the same rule to its shards, in proportion to their words. A shard is a bounded
number of documents in a seeded order, laid end to end and cut into blocks; a quota of q over b
blocks takes every block q div b times and the first q mod b once more. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmura.functions.durable import cut_lineage, release
from murmura.functions.ordering import ordered_index
from murmura.llm.rows import WORD

SHARD_DOCS = 512
FAN = 1024
_PROBES = 64


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(source, rank, weight, docs, source_size, target) of (source, size): sources by code point, null last."""
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    per = per.select("*", F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__name"))
    ranked = ordered_index(cut_lineage(per), ["__null", "__name"], out="rank")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = cut_lineage(ranked.select(
        "source", "rank", F.get(cycle, ((F.col("rank") - 1) % len(weights)).cast("int")).cast("bigint").alias("weight"),
        "docs", "source_size", (F.col("source_size") * max_repeat).alias("cap")))
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight, capped = int(whole[0] or 0), int(whole[1] or 1), 0
    rest, count = total, -1
    # The excess of sources above their cap is shared anew until none is above.
    while True:
        below = F.col("cap").cast("decimal(38,0)") * F.lit(weight) < F.col("weight").cast("decimal(38,0)") * F.lit(rest)
        got = ranked.agg(
            F.count_if(below), F.coalesce(F.sum(F.when(below, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~below, F.col("weight"))), F.lit(0)),
        ).first() if total else (0, 0, weight)
        if int(got[0]) == count or not int(got[2]) or not total:
            break
        count, capped, weight = int(got[0]), int(got[1]), int(got[2])
        rest = total - capped
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(weight))
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), share) if total else F.lit(0.0)).drop("cap")


def _seats(votes: Column, divisor: Column) -> Column:
    return F.floor(votes / divisor + 0.5)


def highest_quotients(sources: DataFrame, seats: int, votes: str = "target", order: str = "rank") -> DataFrame:
    """``sources`` with ``quota``: ``seats`` given one by one to the highest votes / (2 s + 1), ties by ``order``."""
    top = sources.agg(F.max(votes), F.sum(votes), F.count(F.lit(1))).first()
    if not seats or not top[1]:
        return sources.withColumn("quota", F.lit(0).cast("bigint"))
    # Many divisors are tried in one pass; the seats they give fall as they grow.
    low, high = top[1] / (seats + top[2]), 2.0 * top[0] + 1.0
    low_n = None
    while True:
        ratio = (high / low) ** (1 / (_PROBES + 1))
        tried = sorted({low * ratio**k for k in range(1, _PROBES + 1)} - {low, high})
        tried = [d for d in tried if low < d < high]
        if not tried or low_n == seats:
            break
        sums = sources.agg(*[F.sum(_seats(F.col(votes), F.lit(d))).alias(f"d{k}") for k, d in enumerate(tried)]).first()
        for d, n in zip(tried, sums, strict=True):
            if n > seats:
                low = d
            else:
                high, low_n = d, int(n)
                break
        if ratio - 1 < 1e-15:
            break
    quota = _seats(F.col(votes), F.lit(high)).cast("bigint")
    given = sources.withColumn("quota", quota)
    left = seats - int(given.agg(F.sum("quota")).first()[0])
    if left <= 0:
        return given
    nearest = ordered_index(
        given.withColumn("__less", -F.col(votes) / (2 * F.col("quota") + 1)), ["__less", order], out="__place")
    return nearest.withColumn("quota", F.col("quota") + (F.col("__place") <= left).cast("bigint")).drop("__place", "__less")


def _share(votes: Column, seats: Column) -> Column:
    """Sainte-Lague within one array of votes (doubles), as an array of seats."""
    total = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v)

    def given(d: Column) -> Column:
        return F.aggregate(votes, F.lit(0).cast("bigint"), lambda a, v: a + _seats(v, d).cast("bigint"))

    start = F.struct(
        (total / (seats + F.size(votes))).alias("lo"), (F.lit(2.0) * F.array_max(votes) + 1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        more = given(mid) > seats
        return F.struct(F.when(more, mid).otherwise(s["lo"]).alias("lo"), F.when(more, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, halve)["hi"]


def _quotas(shards: DataFrame, sources: DataFrame) -> DataFrame:
    """(rank, shard, quota) of (rank, shard, words), through a tree of at most FAN children a node."""
    levels = [shards.select("rank", F.col("shard").alias("node"), F.col("words").cast("double").alias("votes"))]
    most = int(shards.agg(F.max("shard")).first()[0] or 0) + 1
    for _ in range(max(1, math.ceil(math.log(max(most, 2), FAN))) - 1):
        levels.append(cut_lineage(levels[-1].groupBy("rank", F.floor(F.col("node") / FAN).cast("bigint").alias("node")).agg(
            F.sum("votes").alias("votes"))))
    given = sources.select("rank", F.lit(0).cast("bigint").alias("up"), F.col("quota").alias("seats"))
    for nodes in reversed(levels):
        parts = nodes.groupBy("rank", F.floor(F.col("node") / FAN).cast("bigint").alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("node", "votes"))).alias("parts"))
        shared = parts.join(given, ["rank", "up"]).withColumn(
            "hi", F.when(F.aggregate("parts.votes", F.lit(0.0), lambda a, v: a + v) > 0, _share(F.col("parts.votes"), F.col("seats"))))
        seated = shared.select("rank", "seats", F.transform("parts", lambda p: F.struct(
            (-p["votes"] / (2 * F.coalesce(_seats(p["votes"], F.col("hi")), F.lit(0)) + 1)).alias("less"),
            p["node"].alias("node"),
            F.coalesce(_seats(p["votes"], F.col("hi")), F.lit(0)).cast("bigint").alias("q"))).alias("parts"))
        rest = F.col("seats") - F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["q"])
        given = seated.select("rank", F.posexplode(F.sort_array("parts")).alias("place", "p"), rest.alias("rest")).select(
            "rank", F.col("p.node").alias("up"),
            (F.col("p.q") + ((F.col("place") < F.col("rest")) & (F.col("p.less") < 0)).cast("bigint")).alias("seats"))
        given = cut_lineage(given)
    return given.select("rank", F.col("up").alias("shard"), F.col("seats").alias("quota"))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, block: int = 4, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(id_col, size, source_size, target, taken), one row per row of ``docs``.

    ``size`` counts the words of the text (null: 0); ``taken`` the words the mix takes of the document,
    repeats counted, at most ``max_repeat`` times its size. A source's taken words differ from its target by
    less than a block per seat rounding and by the short last blocks of its shards. A null source is a source of
    its own; sources without words have target 0; equal rows share a shard and may swap their
    taken words. The order within shards depends on ``seed`` and the ids alone, so reruns agree. An empty table gives no rows.
    """
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("__doc"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("place")))
    sources = cut_lineage(source_targets(sized, weights, max_repeat))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    quotas = cut_lineage(highest_quotients(sources, int(total) // block))
    shard = F.pmod("place", F.ceil(F.col("docs") / SHARD_DOCS)).cast("bigint")
    dealt = cut_lineage(sized.join(
        quotas.select(F.col("source").alias("s"), "rank", "docs", "source_size", "target"),
        F.col("source").eqNullSafe(F.col("s"))).select(
        "__doc", "size", "source_size", "target", "rank", shard.alias("shard"), F.xxhash64(F.lit(seed + 1), "place").alias("place")))
    release(sized)
    shards = cut_lineage(dealt.groupBy("rank", "shard").agg(F.sum("size").alias("words")))
    per_shard = _quotas(shards, quotas).join(shards, ["rank", "shard"]).withColumn(
        "blocks", F.ceil(F.col("words") / block)).select(
        "rank", "shard", "blocks", F.least("quota", F.col("blocks") * max_repeat).alias("quota")).select(
        "rank", "shard",
        F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("bigint").alias("passes"),
        F.when(F.col("blocks") > 0, (F.col("quota") % F.col("blocks")) * block).otherwise(0).cast("bigint").alias("more"))
    order = Window.partitionBy("rank", "shard").orderBy("place", "__doc", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(order)
    placed = dealt.withColumn("end", end).join(per_shard, ["rank", "shard"])
    extra = F.greatest(F.lit(0), F.least("end", "more") - (F.col("end") - F.col("size")))
    return placed.select(
        F.col("__doc").alias(id_col), "size", "source_size", "target",
        (F.col("passes") * F.col("size") + extra).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every document as often as the mix takes it, a started pass rounded to the nearest whole."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    taken = mix_sources(docs, **options).groupBy(F.col(id_col).alias("__doc")).agg(
        F.sum("taken").alias("__taken"), F.sum("size").alias("__size"))
    # Rows that share an id share what was taken of it; a document without words stays once.
    copies = F.when(F.coalesce(F.col("__size"), F.lit(0)) == 0, 1).otherwise(
        F.round(F.col("__taken") / F.col("__size"))).cast("int")
    joined = docs.join(taken, F.col(id_col).eqNullSafe(F.col("__doc")), "left")
    return joined.withColumn("__copies", F.array_repeat(F.lit(0), copies)).withColumn(
        "__copy", F.explode("__copies")).select(*[docs[c] for c in docs.columns])
