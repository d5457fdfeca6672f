"""Spreading the all-against-all work of one group over many tasks.

A group (one batch of one stream) is cut into blocks of about ``block_rows`` points by a
hash of the point id. A task gets one pair of blocks, so its memory does not depend on the
group, and it hands back at most a few values per point, never the pairs. Where the caller
knows that no group has more than ``block_rows`` points (batches cut by count), the group is
one block and the points are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2048


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows hashed by ``keys`` over a fixed number of tasks.

    Block work is quadratic in the rows, so a task is heavy long before it is big. A fixed
    number keeps adaptive execution from merging such tasks by their bytes, and the grouping
    that follows needs no other shuffle.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def hashed_block(id_column: str, blocks: str):
    return F.pmod(F.xxhash64(id_column), F.col(blocks)).cast("int")


def with_blocks(points: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Add ``blocks`` (how many the group has) and ``block`` (where the point sits)."""
    sizes = points.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("bigint").alias("blocks")
    )
    if not keys:
        return points.withColumn("blocks", F.lit(sizes.first()[0])).withColumn("block", hashed_block("pt_id", "blocks"))
    return points.join(sizes, list(keys)).withColumn("block", hashed_block("pt_id", "blocks"))


def one_against_all(points: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Rows of every ordered block pair: (keys, block, other, is_target, ...).

    ``is_target`` false: the points asked about (of ``block``); true: the points of ``other``
    they are compared with. A point appears 2 * blocks times.
    """
    cut = with_blocks(points, keys, block_rows)
    all_blocks = F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))
    asked = cut.withColumn("other", F.explode(all_blocks)).withColumn("is_target", F.lit(False))
    targets = (
        cut.withColumnRenamed("block", "other")
        .withColumn("block", F.explode(all_blocks))
        .withColumn("is_target", F.lit(True))
    )
    return asked.unionByName(targets).drop("blocks")


def unordered_pairs(points: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Rows of every unordered block pair: (keys, block, other, ...), block <= other.

    A point appears ``blocks`` times.
    """
    cut = with_blocks(points, keys, block_rows)
    partner = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    return (
        cut.withColumn("__home", F.col("block"))
        .withColumn("__partner", partner)
        .withColumn("block", F.least("__home", "__partner"))
        .withColumn("other", F.greatest("__home", "__partner"))
        .drop("blocks", "__partner")
        .withColumnRenamed("__home", "home")
    )
