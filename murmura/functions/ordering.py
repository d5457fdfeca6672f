"""Global order over distributed rows without a single-task window.

``ordered_index`` numbers rows by cutting the order at sampled boundaries. The
boundaries are literals in the plan, so a recomputed task sees the same cut, and
the sample only decides how even the buckets are, never which number a row gets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_BUCKET = 1 << 18
MAX_BUCKETS = 1 << 16
_BUCKET = "__bucket"


def ordered_index(
    df: DataFrame,
    order_by: Sequence[str],
    key: Sequence[str] = (),
    out: str = "rn",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add a 1-based dense position per ``key``. ``key + order_by`` must be unique."""
    columns = [*key, *order_by]
    total = df.count()
    buckets = min(MAX_BUCKETS, math.ceil(total / rows_per_bucket))
    if buckets <= 1:
        window = Window.partitionBy(*(key or [F.lit(0)])).orderBy(*order_by)
        return df.withColumn(out, F.row_number().over(window).cast("bigint"))

    me = F.struct(*columns)
    sampled = (
        df.select(*columns)
        .sample(False, min(1.0, 32 * buckets / total), seed=17)
        .orderBy(*columns)
        .select(F.to_json(me, {"ignoreNullFields": "false"}).alias("j"))
        .toPandas()["j"]
        .tolist()
    )
    step = max(1, len(sampled) // buckets)
    cuts = sampled[step::step]
    if not cuts:
        return ordered_index(df, order_by, key, out, total + 1)
    kind = df.select(me.alias("s")).schema["s"].dataType.simpleString()
    bounds = F.from_json(F.lit("[" + ",".join(cuts) + "]"), f"array<{kind}>")

    bucketed = df.withColumn(_BUCKET, _count_not_above(bounds, me, len(cuts)))
    parts = [*key, _BUCKET]
    counts = bucketed.groupBy(*parts).agg(F.count(F.lit(1)).alias("__cnt"))
    before = Window.partitionBy(*(key or [F.lit(0)])).orderBy(_BUCKET).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Only a key cut by a boundary starts a bucket at an offset, so there are at most
    # len(cuts) rows here whatever the number of keys.
    offsets = (
        counts.withColumn("__offset", F.sum("__cnt").over(before))
        .where(F.col("__offset") > 0)
        .select(*parts, "__offset")
    )
    numbered = bucketed.withColumn(
        out, F.row_number().over(Window.partitionBy(*parts).orderBy(*order_by)).cast("bigint")
    )
    return (
        numbered.join(F.broadcast(offsets), parts, "left")
        .withColumn(out, F.col(out) + F.coalesce("__offset", F.lit(0)))
        .select(*df.columns, out)
    )


def _count_not_above(bounds: Column, me: Column, size: int) -> Column:
    """How many sorted ``bounds`` are <= ``me``, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(bounds, mid) <= me)
        return F.struct(
            F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"),
        )

    rounds = math.ceil(math.log2(size + 1)) + 1
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)["lo"]


def fixed_batches(
    df: DataFrame,
    size: int,
    order_by: Sequence[str],
    key: Sequence[str] = (),
    out: str = "batch_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Cut the ordered rows into batches of ``size``, numbered from 1; the last may be short."""
    if size <= 0:
        raise ValueError(f"batch size must be greater than 0, got {size}")
    numbered = ordered_index(df, order_by, key, "__rn", rows_per_bucket)
    return numbered.withColumn(
        out, F.floor((F.col("__rn") - 1) / F.lit(size)).cast("bigint") + 1
    ).drop("__rn")


def affine_scan(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    maps: dict[str, tuple[Column, Column]],
    positions: int,
    chunk: int = 1024,
) -> DataFrame:
    """Running fold ``s[t] = a[t] * s[t-1] + b[t]`` per key, starting from 0.

    ``maps`` names each state and gives its (a, b); states are doubles. ``pos`` is an
    integer position from 0 up to less than ``positions``, and a row whose predecessor
    position is missing must have a = 0.
    Positions are cut into chunks of bounded length, each folded in one array; the
    composed maps of whole chunks are folded the same way one level up, and the carry
    comes back by an equi-join, so a key with most of the rows is spread over tasks.
    """
    names = list(maps)
    chunks = -(-positions // chunk)
    slot = f"__chunk_of_{chunks}"
    rows = df.withColumn(slot, F.floor(F.col(pos) / F.lit(chunk)).cast("bigint"))
    payload = F.struct(
        F.col(pos).alias("__p"),
        *[maps[n][0].cast("double").alias(f"a_{n}") for n in names],
        *[maps[n][1].cast("double").alias(f"b_{n}") for n in names],
        F.struct(*[c for c in df.columns if c not in (*keys, pos)]).alias("__row"),
    )
    grouped = rows.groupBy(*keys, slot).agg(F.sort_array(F.collect_list(payload)).alias("__rows"))

    # An empty typed array to append to, and the identity map to start from.
    state_fields = [f"a_{n}" for n in names] + [f"b_{n}" for n in names]
    state_type = "array<struct<" + ",".join(f"{f}:double" for f in state_fields) + ">>"

    def compose(acc: Column, row: Column) -> Column:
        last = F.element_at(acc, -1)
        first = F.size(acc) == 0
        return F.concat(acc, F.array(F.struct(
            *[F.when(first, row[f"a_{n}"]).otherwise(row[f"a_{n}"] * last[f"a_{n}"]).alias(f"a_{n}")
              for n in names],
            *[F.when(first, row[f"b_{n}"])
              .otherwise(row[f"a_{n}"] * last[f"b_{n}"] + row[f"b_{n}"]).alias(f"b_{n}")
              for n in names],
        )))

    folded = grouped.withColumn(
        "__prefix", F.aggregate("__rows", F.array().cast(state_type), compose)
    )
    if chunks > 1:
        last = F.element_at("__prefix", -1)
        tops = folded.select(
            *keys, slot, *[last[f].alias(f) for f in state_fields]
        )
        carried = affine_scan(
            tops, keys, slot,
            {n: (F.col(f"a_{n}"), F.col(f"b_{n}")) for n in names}, chunks, chunk,
        ).select(
            *keys, (F.col(slot) + 1).alias(slot),
            *[F.col(n).alias(f"__carry_{n}") for n in names],
        )
        folded = folded.join(carried, [*keys, slot], "left")
    else:
        folded = folded.withColumns({f"__carry_{n}": F.lit(0.0) for n in names})

    flat = folded.select(
        *keys, *[f"__carry_{n}" for n in names],
        F.explode(F.arrays_zip("__rows", "__prefix")).alias("__z"),
    )
    return flat.select(
        *keys, F.col("__z.__rows.__p").alias(pos), "__z.__rows.__row.*",
        *[
            (F.coalesce(F.col(f"__carry_{n}"), F.lit(0.0)) * F.col(f"__z.__prefix.a_{n}")
             + F.col(f"__z.__prefix.b_{n}")).alias(n)
            for n in names
        ],
    )
