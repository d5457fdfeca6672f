"""Packing token pieces into sequences by the linear grouping scheme.

The plan is made from the histogram of piece lengths, which has no more entries than a sequence
has tokens whatever the corpus: large lengths are rounded up within groups of equal cardinality,
configurations of the few rounded sizes are optimised by a knapsack and used as often as the demand allows,
actual lengths take the rounded places, and small pieces go best-fit into what is left. The plan is a list of
runs of equal lengths; every piece finds its place from its length and its rank within the length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmura.llm.text import small_batches
from murmura.functions.durable import cut_lineage

CAPACITY = 2048
GROUPS = 512
END = 0
_BUCKET = 1024
_MOST_BUCKETS = 1 << 16
_tokenizers: dict = {}


#: How a byte-level vocabulary cuts text before merging (fixed with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _tokenizer(path: str):
    """The byte-level BPE of a tokenizers JSON file, run by tiktoken: the same ids in a quarter of the time."""
    if path not in _tokenizers:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        # Byte-level files write each byte as a printable character: itself, or one from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in special}
        _tokenizers[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _tokenizers[path]


def _pieces_of(path: str, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(path)
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encoder.encode_to_numpy(text.as_py() or "", allowed_special="all"), END).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((row, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            if out:
                row, *rest = (pa.array(c, pa.int64()) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), *rest], ["__doc", "piece", "start", "length", "ids_crc32"])

    return pieces


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__doc, piece, start, length, ids_crc32) of every document; only the first piece of a long one is short."""
    kind = small_batches(docs).schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")).mapInArrow(
        _pieces_of(tokenizer, capacity), f"__doc {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint")


def _best_configuration(sizes: list[int], demand: list[int], first: int, capacity: int) -> list[int]:
    """How often each size is used beside one of ``first`` so that the sequence is as full as can be."""
    room = capacity - sizes[first]
    full = np.zeros(room + 1, np.int64)
    choice = []
    for g, size in enumerate(sizes):
        taken = np.zeros(room + 1, np.int16)
        limit = demand[g] - (g == first)
        base = full
        for k in range(1, min(limit, room // size) + 1):
            tried = base[: room + 1 - k * size] + k * size
            better = tried > full[k * size:]
            if better.any():
                full = full.copy()
                full[k * size:][better] = tried[better]
                taken[k * size:][better] = k
        choice.append(taken)
    use, left = [0] * len(sizes), room
    for g in reversed(range(len(sizes))):
        k = int(choice[g][left])
        use[g] = k
        left -= k * sizes[g]
    use[first] += 1
    return use


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset) that place all pieces.

    The piece of rank r of a run lies in sequence first + (r - first rank) // per, at offset + ((r - first rank) % per) * length.
    """
    runs: list[tuple[int, ...]] = []
    ranks = dict.fromkeys(histogram, 0)
    sequences = 0
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, ranks[length], n, first, per, offset))
        ranks[length] += n

    large = sorted((length for length in histogram if length > capacity // 8), reverse=True)
    total = sum(histogram[length] for length in large)
    each = max(1, -(-total // groups))
    sizes: list[int] = []
    stock: list[list[list[int]]] = []
    held = each
    for length in large:
        n = histogram[length]
        while n:
            if held == each:
                sizes.append(length)
                stock.append([])
                held = 0
            take = min(n, each - held)
            stock[-1].append([length, take])
            held += take
            n -= take
    demand = [sum(n for _, n in s) for s in stock]
    for first in range(len(sizes)):
        while demand[first]:
            use = _best_configuration(sizes, demand, first, capacity)
            times = min(demand[g] // k for g, k in enumerate(use) if k)
            slots = [g for g, k in enumerate(use) for _ in range(k)]
            # The actual lengths of every place, as (length, sequences) from the first one on.
            rows = []
            for g in slots:
                row, need = [], times
                while need:
                    length, n = stock[g][0]
                    take = min(n, need)
                    row.append((length, take))
                    need -= take
                    stock[g][0][1] -= take
                    if not stock[g][0][1]:
                        stock[g].pop(0)
                rows.append(row)
                demand[g] -= times
            edges = sorted({0, *(int(x) for row in rows for x in np.cumsum([n for _, n in row]))})
            at = [0] * len(rows)
            ends = [row[0][1] for row in rows]
            for a, b in zip(edges, edges[1:]):
                offset = 0
                for k, row in enumerate(rows):
                    while ends[k] <= a:
                        at[k] += 1
                        ends[k] += row[at[k]][1]
                    put(row[at[k]][0], b - a, sequences + a, 1, offset)
                    offset += row[at[k]][0]
                free[capacity - offset].append((sequences + a, b - a))
            sequences += times
    for length in sorted((x for x in histogram if x <= capacity // 8), reverse=True):
        n, room = histogram[length], length
        while n:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:
                per = capacity // length
                count = -(-n // per)
                free[capacity].append((sequences, count))
                sequences += count
                room = capacity
            first, count = free[room].pop()
            per = room // length
            whole = min(count, n // per)
            if whole:
                put(length, whole * per, first, per, capacity - room)
                free[room - per * length].append((first, whole))
                n -= whole * per
            if n and whole < count:
                put(length, n, first + whole, n, capacity - room)
                free[room - n * length].append((first + whole, 1))
                whole, n = whole + 1, 0
            if whole < count:
                free[room].append((first + whole, count - whole))
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def _place(runs: np.ndarray, whole: int):
    keys = (runs[:, 0] << 44) + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            k = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            run = runs[k]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(5)], pa.array(run[:, 3] + nth // run[:, 4]),
                 pa.array(run[:, 5] + nth % run[:, 4] * length)],
                ["__doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of ``token_pieces``) with sequence_id and offset; sequences are filled gapless from 0."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    spark = pieces.sparkSession
    if not histogram:
        return pieces.withColumn("sequence_id", F.lit(None).cast("bigint")).withColumn("offset", F.lit(None).cast("bigint"))
    shape = spark.createDataFrame(
        [(length, min(_MOST_BUCKETS, -(-n // _BUCKET))) for length, n in histogram.items()], "length bigint, buckets bigint")
    dealt = pieces.join(F.broadcast(shape), "length").select(
        *pieces.columns, F.pmod(F.xxhash64("__doc", "piece"), "buckets").alias("bucket"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "bucket").count().select(
        "length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("__doc", "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("nth", F.row_number().over(within)).join(starts, ["length", "bucket"]).select(
        *pieces.columns, (F.col("before") + F.col("nth") - 1).cast("bigint").alias("rank"))
    runs = plan(histogram, capacity)
    kind = pieces.schema["__doc"].dataType.simpleString()
    return ranked.mapInArrow(
        _place(runs, capacity), f"__doc {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint,"
        " sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces in their sequences.

    A document is its token ids and a final 0; a null or empty text is that 0 alone. Equal rows are packed
    each; an empty table gives no rows; other columns are not looked at.
    """
    pieces = cut_lineage(token_pieces(docs, tokenizer, capacity, id_col, text_col))
    return pack(pieces, capacity).withColumnRenamed("__doc", id_col)
