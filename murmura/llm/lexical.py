"""Ranked lexical search, term at a time, with limited accumulators.

One pass over the documents counts their terms and keeps, per document, the frequencies of query terms (a fixed
bitmap of hashed query terms drops most others early; a join on the terms themselves is exact). Postings are
written by bands of document frequency. Bands are read from the rarest up: every document met gets an
accumulator, until what an item's remaining terms can add at most is below its k-th best partial score. From
then on no document without an accumulator can reach the top, so the item reads no more postings: survivors, the
accumulators that may still get there, are brought to their exact scores from the documents' own frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmura.functions.durable import cut_lineage, new_path, release, remove
from murmura.llm.rows import numbered
from murmura.llm.text import held, LOWER, Rolling, slices, small_batches

#: Bits of the filter of query terms; it is this large whatever the number of terms.
FILTER_BITS = 1 << 20
#: The first band holds terms in fewer documents than FIRST; each further one spans a factor of STEP.
FIRST = 512
STEP = 4
#: All bytes but digits, letters and those above ASCII.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _slots(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    return (Rolling(data).ranges(starts, ends) % np.uint64(bits)).astype(np.int64)


def _query_terms(bits: int):
    """(item, text) to (item, term, slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                data = LOWER[part.data]
                starts, ends, docs = part.words(OUTSIDE)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(part.first + docs)), held(data, starts, ends).cast(pa.binary()).cast(pa.string()),
                    pa.array(_slots(data, starts, ends, bits)),
                ], ["item", "term", "slot"])

    return run


def _profiles(wanted: np.ndarray):
    """(id, text) to (row, id, number of terms, some terms, their frequencies); the terms include all that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch.column(1)):
                data = LOWER[part.data]
                starts, ends, docs = part.words(OUTSIDE)
                keep = wanted[_slots(data, starts, ends, len(wanted))]
                coded = held(data, starts[keep], ends[keep]).dictionary_encode()
                size = max(1, len(coded.dictionary))
                cells, tf = np.unique(docs[keep] * size + coded.indices.to_numpy(), return_counts=True)
                offs = pa.array(np.concatenate([[0], np.cumsum(np.bincount(cells // size, minlength=part.n))]), pa.int32())
                terms = coded.dictionary.cast(pa.binary()).cast(pa.string()).take(pa.array(cells % size))
                yield pa.RecordBatch.from_arrays([
                    pa.array(number + np.arange(part.n)), batch.column(0)[part.first: part.first + part.n],
                    pa.array(np.bincount(docs, minlength=part.n), pa.int64()),
                    pa.ListArray.from_arrays(offs, terms), pa.ListArray.from_arrays(offs, pa.array(tf, pa.int64())),
                ], ["row", "__doc", "n", "terms", "tfs"])
                number += part.n

    return run


def _best(scores: DataFrame, k: int) -> DataFrame:
    """(item, the k-th best score, or the least where there are fewer, how many of k there are)."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    return scores.select("item", "score").withColumn("place", place).where(F.col("place") <= k).groupBy("item").agg(
        F.min("score").alias("kth"), F.count(F.lit(1)).alias("found"))


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", query_col: str = "text",
) -> DataFrame:
    """(item_col, rank, id_col, score): the ``k`` highest-scoring documents of each item, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of whatever is not ASCII, only A-Z lower-cased; a null text has none. A term
    weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))) and adds w * ((10^9 tf) div (1000 tf + 20 m)), m = 50 + ((50 n N) div L).
    Scores of 0 are not ranked. Every row of ``docs`` is a document, so repeated rows are ranked one after the other; null ids come last
    among equals. Rows of ``items`` with the same id are one item; those with a null id are left out. Other columns are not
    looked at. Without items, documents or common terms there are no rows.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text"))
    asked = items.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).alias("item"), F.col(query_col).cast("string").alias("__text"))
    kinds = rows.schema["__doc"].dataType.simpleString(), asked.schema["item"].dataType.simpleString()
    terms = cut_lineage(asked.mapInArrow(_query_terms(FILTER_BITS), f"item {kinds[1]}, term string, slot bigint").distinct())
    # At most FILTER_BITS numbers, however many terms there are.
    slots = terms.select("slot").distinct().toArrow()["slot"].to_numpy()
    wanted = np.zeros(FILTER_BITS, bool)
    wanted[slots] = True
    profiles = cut_lineage(rows.mapInArrow(
        _profiles(wanted), f"row bigint, __doc {kinds[0]}, n bigint, terms array<string>, tfs array<bigint>"))
    whole = profiles.where("n > 0").agg(F.count(F.lit(1)), F.sum(F.col("n").cast("decimal(38,0)"))).first()
    n_docs, length = int(whole[0]), int(whole[1] or 1)

    numbers = cut_lineage(numbered(terms, "term", "tid"))
    wide = "decimal(38,0)"
    m = (F.lit(50) + F.expr(f"(cast(50 * n as {wide}) * cast({n_docs} as {wide})) div cast({length} as {wide})")).alias("m")
    impact = F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)").alias("impact")

    def exploded(profile: DataFrame, *carried: str) -> DataFrame:
        """(carried, term, impact) of documents that hold some."""
        cells = profile.where(F.size("terms") > 0).select(*carried, m, F.explode(F.arrays_zip("terms", "tfs")).alias("c"))
        return cells.select(*carried, F.col("c.terms").alias("term"), F.col("c.tfs").alias("tf"), "m").select(*carried, "term", impact)

    stats = exploded(profiles).join(numbers, "term").groupBy("tid").agg(
        F.count(F.lit(1)).alias("df"), F.max("impact").alias("top"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("bigint")
    band = F.greatest(F.lit(0), F.floor(F.log(F.col("df") / F.lit(FIRST)) / F.log(F.lit(float(STEP)))) + 1).cast("int")
    vocabulary = cut_lineage(numbers.join(stats, "tid").select("term", "tid", weight.alias("w"), "top", band.alias("band")))
    path = new_path(spark, "postings")
    exploded(profiles, "row").join(vocabulary.select("term", "tid", "band"), "term").select(
        "tid", "row", "impact", "band").write.partitionBy("band").parquet(path)
    postings = spark.read.schema("tid bigint, row bigint, impact bigint, band int").parquet(path)
    wanted_terms = cut_lineage(terms.select("item", "term").join(vocabulary, "term").where("w > 0"))
    bounds = cut_lineage(wanted_terms.groupBy("item", "band").agg(F.sum(F.col("w") * F.col("top")).alias("bound")))
    # One number a band.
    bands = sorted(r[0] for r in bounds.select("band").distinct().collect())

    sums: DataFrame | None = None
    open_ = cut_lineage(bounds.select("item").distinct())
    finished: list[DataFrame] = []
    for b in bands:
        here = wanted_terms.where(F.col("band") == b).join(open_, "item", "left_semi").select("item", "tid", "w")
        part = postings.where(F.col("band") == b).join(here, "tid").groupBy("item", "row").agg(
            F.sum(F.col("w") * F.col("impact")).alias("score"))
        if sums is not None:
            part = sums.unionByName(part).groupBy("item", "row").agg(F.sum("score").alias("score"))
        scores = cut_lineage(part)
        rest = bounds.where(F.col("band") > b).groupBy("item").agg(F.sum("bound").alias("rest"))
        state = cut_lineage(open_.join(_best(scores, k), "item", "left").join(rest, "item", "left").withColumn(
            "rest", F.coalesce("rest", F.lit(0))))
        # A document without an accumulator gets no more than ``rest``.
        done = ((F.col("found") == k) & (F.col("rest") < F.col("kth"))) | (F.col("rest") == 0)
        ended = state.where(F.coalesce(done, F.lit(False)))
        survivors = scores.join(ended.select("item", "kth", "rest"), "item").where(
            F.col("score") + F.col("rest") >= F.col("kth")).select("item", "row", "score", F.lit(b).alias("last"))
        finished.append(cut_lineage(survivors))
        still = cut_lineage(state.join(ended.select("item"), "item", "left_anti").select("item"))
        left = cut_lineage(scores.join(still, "item", "left_semi"))
        release(scores, state, open_, *([sums] if sums is not None else []))
        sums, open_ = left, still
        if open_.isEmpty():
            break

    none = f"item {kinds[1]}, row bigint, score bigint, last int"
    partial = spark.createDataFrame([], none)
    for some in finished:
        partial = partial.unionByName(some)
    met = partial.select("item", "row", F.lit(0).cast("bigint").alias("score"), "last").join(profiles, "row")
    added = exploded(met, "item", "row", "last").join(
        wanted_terms.select("item", "term", "w", "band"), ["item", "term"]).where("band > last").select(
        "item", "row", (F.col("w") * F.col("impact")).alias("score"))
    exact = cut_lineage(partial.select("item", "row", "score").unionByName(added).groupBy("item", "row").agg(
        F.sum("score").alias("score")).where("score > 0"))
    # Written before it is joined: a row an item.
    best = cut_lineage(_best(exact, k))
    kept = exact.join(best, "item").where(F.col("score") >= F.col("kth")).select("item", "row", "score")
    named = cut_lineage(kept.join(profiles.select("row", "__doc"), "row"))
    release(exact, best, profiles, wanted_terms, bounds, vocabulary, numbers, terms, open_, *finished, *([sums] if sums is not None else []))
    remove(spark, path)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("__doc").asc_nulls_last()))
    return named.withColumn("rank", place).where(F.col("rank") <= k).select(
        F.col("item").alias(item_col), "rank", F.col("__doc").alias(id_col), "score")
