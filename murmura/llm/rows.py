"""Identity of rows for joins back to them, and numbers for distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmura.functions.durable import cut_lineage

KEY = ("__id", "__tag")


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def key_of(id_col: str, text_col: str) -> list[Column]:
    """Two columns of 64 bits that only equal rows share; ids may be of any type, null or repeated."""
    row = F.col(id_col).isNull(), F.col(id_col), text_of(text_col)
    return [F.xxhash64(F.lit(k), *row).alias(name) for k, name in enumerate(KEY)]


#: Whatever is free of ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def numbered(values: DataFrame, column: str, out: str) -> DataFrame:
    """The distinct ``values`` with dense numbers from 0: places in a table written once, shifted by the partitions before."""
    placed = cut_lineage(values.select(column).distinct().withColumn("__at", F.monotonically_increasing_id()))
    # One row a partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_lineage(placed.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", F.shiftright("__at", 33)).join(parts, "__part").select(
        column, (F.col("__before") + inside).cast("bigint").alias(out))
