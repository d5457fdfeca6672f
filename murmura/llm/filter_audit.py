"""How five text filters overlap, in every order, from a sparse document-term matrix.

Texts are tokenised shard by shard: a shard of whole documents keeps its own dictionary of words (exact
bytes) and counts in compressed rows (CSR). The distinct words of all shards get dense global numbers, and
each shard's dictionary, not its documents, is joined with them: its columns are renumbered in place. Row sums and
nonzero counts of the matrix decide the filters on words; the others come from flags held beside the rows, and from the smallest
id of each text's digest. Documents are then counted by part and set of failed filters, 32 sets at most,
from which every step of all 120 orders follows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.durable import cut_lineage
from murmura.llm.rows import numbered
from murmura.llm.text import gathered, held, slices, small_batches

SHARD_BYTES = 12 << 20
FILTERS = "ABCDE"
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*|")] = True


def _row(values, kind: pa.DataType) -> pa.Array:
    """One list that holds all values."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _shards(limit: int):
    """(id, part, text) to shards of about ``limit`` bytes in CSR with a dictionary of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in gathered(batches, 2, limit):
            for part in slices(batch.column(2), limit):
                starts, ends, docs = part.words()
                coded = held(part.data, starts, ends).dictionary_encode()
                del starts, ends
                n_words = max(1, len(coded.dictionary))
                cells, counts = np.unique(docs * n_words + coded.indices.to_numpy(), return_counts=True)
                del docs
                rows = np.concatenate([[0], np.cumsum(np.bincount(cells // n_words, minlength=part.n))])
                raw = part.data.tobytes()
                digests = [hashlib.sha256(raw[a:b]).digest() for a, b in itertools.pairwise(part.offs.tolist())]
                # All three are rare, so their places are counted.
                upper, inner, symbols = (np.bincount(part.doc_of(np.flatnonzero(flags)), minlength=part.n) for flags in (
                    (part.data >= 65) & (part.data <= 90), (part.data & 0xC0) == 0x80, _SYMBOLS[part.data]))
                points = np.diff(part.offs) - inner
                ids, parts = (batch.column(k)[part.first: part.first + part.n] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), _row(ids, ids.type), _row(parts, parts.type), _row(digests, pa.binary()),
                    _row(100 * upper > 2 * points, pa.bool_()), _row(symbols > 0, pa.bool_()),
                    _row(rows, pa.int32()), shut(cells % n_words), shut(counts),
                    _row(coded.dictionary.cast(pa.binary()), pa.binary()),
                ], ["shard", "ids", "parts", "digests", "upper", "symbols", "row_ends", "cells", "counts", "words"])
                number += 1

    return run


def shut(values: np.ndarray) -> pa.Array:
    """One row of numbers as compressed 64-bit integers."""
    return pa.array([zstandard.ZstdCompressor(level=1).compress(values.astype("<i8").tobytes())], pa.binary())


def opened(value: pa.Scalar) -> np.ndarray:
    """The numbers of a compressed value."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value.as_py()), "<i8")


def _renumbered(shard: pa.Table, names: pa.Table) -> pa.Table:
    """Local columns of a shard to global ones, given as rows (local, column)."""
    cells = opened(shard["cells"][0])
    if len(cells):
        of = np.empty(len(names), np.int64)
        of[names["local"].to_numpy()] = names["column"].to_numpy()
        cells = of[cells]
    return shard.drop_columns(["cells"]).append_column("columns", shut(cells))


def term_matrix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """(shards, dictionary): the document-term matrix of whole texts, and (word, column).

    A shard is a block of rows: ``ids``, ``parts``, ``digests`` (SHA-256 of the text), flags ``upper`` and ``symbols``, and in CSR
    ``row_ends`` (one more than rows), ``columns`` (numbers of the dictionary) and ``counts``, both compressed (``opened``). Words are whatever is free of ASCII white
    space, case-sensitive, as bytes; a null text is empty, a null part the empty string. An empty table gives no shards.
    """
    rows = small_batches(docs).select(
        F.col(id_col).alias("__doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("__part"),
        F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["__doc"].dataType.simpleString()
    head = (f"shard bigint, ids array<{kind}>, parts array<string>, digests array<binary>, upper array<boolean>,"
            " symbols array<boolean>, row_ends array<int>")
    local = cut_lineage(rows.mapInArrow(_shards(SHARD_BYTES), f"{head}, cells binary, counts binary, words array<binary>"))
    entries = local.select(F.col("shard").alias("home"), F.posexplode("words").alias("local", "word"))
    dictionary = numbered(entries, "word", "column")
    # A word is once in a shard, so a frequent one has a row a shard; the dictionary is written, so the join may split them.
    names = entries.join(dictionary, "word").select("home", "local", "column")
    matrix = local.drop("words").groupBy("shard").cogroup(names.groupBy("home")).applyInArrow(
        _renumbered, f"{head}, counts binary, columns binary")
    return matrix, dictionary


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards to (id, part, digest, bits of the filters A to D that fail)."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, parts, digests, upper, symbols, ends = (batch.column(k)[row].values for k in range(6))
            ends = ends.to_numpy()
            total = np.concatenate([[0], np.cumsum(opened(batch.column(6)[row]))])
            words, distinct = total[ends[1:]] - total[ends[:-1]], np.diff(ends).astype(np.int64)
            bits = (words < 200) + 2 * (100 * distinct < 50 * words)
            bits = bits + 4 * upper.to_numpy(zero_copy_only=False) + 8 * symbols.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([ids, parts, digests, pa.array(bits, pa.int32())], ["__doc", "part", "digest", "bits"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id_col, part, failed), a row per row of ``docs``: bit k of ``failed`` is set where filter k of ABCDE fails.

    A: under 200 words. B: 100 * distinct words < 50 * words. C: 100 * [A-Z] > 2 * code points. D: holds any of
    ``#$%&*|``. E: the text is that of a smaller id of the whole table; a null id is no smaller one and has none.
    """
    matrix, _ = term_matrix(docs, id_col, text_col, part_col)
    kind = docs.schema[id_col].dataType.simpleString()
    flags = cut_lineage(matrix.select("ids", "parts", "digests", "upper", "symbols", "row_ends", "counts").mapInArrow(
        _decided, f"__doc {kind}, part string, digest binary, bits int"))
    # Written before it is joined, so that the join can split a text with very many copies.
    first = cut_lineage(flags.groupBy("digest").agg(
        F.min("__doc").alias("first"), F.max("__doc").alias("last")).where("first <> last").select("digest", "first"))
    later = F.coalesce(F.col("__doc") > F.col("first"), F.lit(False))
    return flags.join(first, "digest", "left").select(
        F.col("__doc").alias(id_col), "part", (F.col("bits") + F.when(later, 16).otherwise(0)).alias("failed"))


def _steps() -> Column:
    """All orders as rows (filter_order, step, bit of its filter, bits before it)."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def audit_filters(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part,
    all 120 orders of the filters and their 5 steps, zeros included.

    ``labels`` (id_col, quality, toxic): a document is good, or toxic, where any label of its id says 1; null ids have no label.
    Every row counts as a document, repeated ones too. Other columns are not looked at. An empty table gives no rows.
    """
    marks = cut_lineage(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).where("good or toxic"))
    failed = failures(docs, id_col, text_col, part_col)
    cells = failed.join(marks, F.col(id_col) == F.col("__id"), "left").groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # At most 32 rows a part, each counted in all steps before they are summed by part and step.
    rows = cut_lineage(cells).select("*", F.explode(_steps()).alias("s")).select("part", "failed", "n", "good", "toxic", "s.*")
    failed_here, failed_before = (F.col("failed").bitwiseAND(F.col(c)) != 0 for c in ("bit", "before"))

    def total(what: Column, counted: Column) -> Column:
        return F.sum(F.when(counted, what).otherwise(F.lit(0))).cast("bigint")

    here = failed_here & ~failed_before
    # Of the filters that a document fails, each comes first in an equal share of the orders.
    share = (F.col("n") * F.lit(120) / F.greatest(F.lit(1), F.bit_count("failed"))).cast("bigint")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(F.col("n"), ~failed_here & ~failed_before).alias("kept"),
        total(F.col("n"), here).alias("removed"),
        total(F.col("n"), failed_here & failed_before).alias("redundant"),
        total(F.col("n"), F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(F.col("good"), here).alias("good_lost"), total(F.col("toxic"), here).alias("toxic_lost"),
        total(share, failed_here).alias("shapley"))
