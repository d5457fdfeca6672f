"""Removal of repeated passages: most-significant-digit passes over sampled suffixes.

A suffix is ordered only through its first ``width`` bytes, and only groups of equal suffixes
matter. Pass 1 takes as digit the smallest hashed ``gram`` among those of the first ``width`` bytes
(equal windows have the same one at the same place), so all suffixes around one place of the text
travel as one row: a run. Runs whose digit is met once are dropped. Pass 2 takes as digit the whole run: a
run met twice is repeated throughout. Digits shared by different runs go on with one run of every
kind: pass 3 takes the bytes that ``CHUNK`` neighbouring suffixes share, which drops those whose
common bytes are met once and settles those whose joint bytes are all alike; pass 4 takes the full
``width`` bytes of each suffix that is left. So all suffixes equal through ``width`` bytes are found and no
others (up to equal 64-bit hashes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions.durable import cut_lineage, release
from murmura.llm.rows import key_of, KEY, text_of
from murmura.llm.text import Rolling, signed, slices, small_batches

CHUNK = 16
_KEY = KEY
_PIECE = (*_KEY, "first")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with an identity of their own; equal rows share it, which no result depends on."""
    return docs.select(*key_of(id_col, text_col), text_of(text_col).alias("__text"), F.col(id_col).alias("__doc"))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    got, span = values, 1
    while 2 * span <= width:
        got = np.minimum(got[:-span], got[span:])
        span *= 2
    rest = width - span
    return np.minimum(got[:-rest], got[rest:]) if rest else got


def _runs(data: np.ndarray, offs: np.ndarray, width: int, gram: int):
    """(digit, run digit, document, first suffix, number of suffixes, digit's place) of every run."""
    if len(data) < width:
        return None
    rolling = Rolling(data)
    grams = rolling.windows(gram)
    place = np.arange(len(grams), dtype=np.uint64)
    bits = np.uint64(32)
    packed = ((grams >> bits) << bits) | place
    chosen = (sliding_min(packed, width - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(offs) >= width)
    valid[offs[long]] += 1
    valid[offs[long + 1] - width + 1] -= 1
    starts = np.flatnonzero(np.cumsum(valid)[: len(chosen)] > 0)
    if not len(starts):
        return None
    anchor = chosen[starts]
    doc = np.searchsorted(offs, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    first = starts[at]
    count = np.diff(np.concatenate([at, [len(starts)]]))
    place = (anchor[at] - first).astype(np.uint64)
    run = rolling.ranges(first, first + count - 1 + width) ^ (place * np.uint64(0x9E3779B97F4A7C15))
    return grams[anchor[at]], run, doc[at], first - offs[doc[at]], count, anchor[at] - first


def _runs_of(width: int, gram: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for part in slices(batch.column(2)):
                found = _runs(part.data, part.offs, width, gram)
                if found is None:
                    continue
                digit, run, doc, first, count, place = found
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(digit)), pa.array(signed(run)), pa.array(ids[part.first + doc]),
                    pa.array(tags[part.first + doc]), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)),
                    pa.array(place.astype(np.int32)),
                ], ["digit", "run", *_KEY, "first", "n", "place"])

    return runs


def _shut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, as they travel."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        text = batch.column(2).cast(pa.binary())
        shut = pa.array([pack.compress(t.as_buffer()) for t in text], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), shut], [*_KEY, "__doc", "__shut"])


def _open(value) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_py())


def _pieces_of(width: int):
    """The bytes under the asked runs."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = _open(batch.column(2)[row])
                asked = batch.column(3)[row].values
                first, count, place, sole = (asked.field(i) for i in range(4))
                n = len(asked)
                held = [data[a: a + c - 1 + width] for a, c in zip(first.to_pylist(), count.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, batch.column(0)[row].as_py(), np.int64)),
                    pa.array(np.full(n, batch.column(1)[row].as_py(), np.int64)),
                    first, count, place, sole, pa.array(held, pa.binary()),
                ], [*_PIECE, "n", "place", "sole", "bytes"])

    return pieces


def _chunks_of(width: int):
    """(core, joint, piece, chunk, its first suffix and number of suffixes, sole).

    Chunk c holds the suffixes that begin CHUNK * c to CHUNK * c + CHUNK - 1 bytes before the digit;
    ``core`` hashes the bytes that all of them would share, ``joint`` those that any that exist has.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            first, count, place = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4))
            for row in range(batch.num_rows):
                rolling = Rolling(np.frombuffer(batch.column(6)[row].as_buffer(), np.uint8))
                lowest, highest = place[row] - count[row] + 1, place[row]
                c = np.arange(lowest // CHUNK, highest // CHUNK + 1)
                core = rolling.ranges(place[row] - CHUNK * c, place[row] - (CHUNK * c + CHUNK - 1) + width)
                near, far = np.maximum(CHUNK * c, lowest), np.minimum(CHUNK * c + CHUNK - 1, highest)
                joint = rolling.ranges(place[row] - far, place[row] - near + width)
                salt = c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                shape = ((near << 20) + far).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                out.append([core ^ salt, joint ^ shape, np.full(len(c), row), c, first[row] + place[row] - far, far - near + 1])
            if not out:
                continue
            core, joint, row, c, begin, n = (np.concatenate(x) for x in zip(*out, strict=True))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(core)), pa.array(signed(joint)), *[batch.column(i).take(take) for i in (0, 1, 2)],
                pa.array(c.astype(np.int32)), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32)),
                batch.column(5).take(take),
            ], ["core", "joint", *_PIECE, "c", "begin", "n", "sole"])

    return chunks


def _suffixes_of(width: int):
    """Every suffix of the open chunks with the hash of its first ``width`` bytes."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                base = batch.column(2)[row].as_py()
                chunks = batch.column(5)[row].values
                begin, n = (chunks.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) - base
                rolling = Rolling(np.frombuffer(batch.column(4)[row].as_buffer(), np.uint8))
                out.append([rolling.ranges(at, at + width), np.full(len(at), row), at + base])
            if not out:
                continue
            suffix, row, at = (np.concatenate(x) for x in zip(*out, strict=True))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(suffix)), *[batch.column(i).take(take) for i in (0, 1)],
                pa.array(at.astype(np.int32)), batch.column(3).take(take),
            ], ["suffix", *_PIECE, "sole"])

    return suffixes


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the given ranges; touching ranges are one run."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return list(zip(starts[at].tolist(), ends[np.concatenate([at[1:] - 1, [len(ends) - 1]])].tolist(), strict=True))


def _cut(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                data = _open(batch.column(1)[row])
                spans = []
                if batch.column(2)[row].is_valid:
                    held = batch.column(2)[row].values
                    first = held.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    spans = merged(first, first + held.field(1).to_numpy(zero_copy_only=False) - 1 + width)
                digest, last = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(data[last:a])
                    last = b
                digest.update(data[last:])
                rows.append((len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest(),
                             [{"start": a, "end": b} for a, b in spans]))
            n_bytes, removed, n_spans, sha, spans = zip(*rows, strict=True) if rows else ((),) * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, span),
            ], ["__doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return cut


def repeated_passages(
    docs: DataFrame, width: int = 400, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_bytes, n_removed, n_spans, kept_sha256, spans).

    A byte is removed where a ``width``-byte string over it also starts elsewhere, in another row
    or in the same one. ``spans`` are the maximal removed byte ranges, end exclusive. A null text is
    empty; repeated rows are copies of each other; ids may be null or repeated; other columns are
    not looked at. An empty table gives no rows.
    """
    gram = gram or width // 2
    if not 0 < gram <= width:
        raise ValueError(f"gram must lie in 1..{width}, got {gram}")
    rows = _keyed(small_batches(docs), id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    runs = cut_lineage(rows.select(*_KEY, "__text").mapInArrow(
        _runs_of(width, gram), "digit bigint, run bigint, __id bigint, __tag bigint, first int, n int, place int"))

    # Counted keys are written before they are joined: a join dealt by the counting's own
    # shuffle could not split a frequent key.
    digits = cut_lineage(runs.groupBy("digit").agg(
        F.count(F.lit(1)).alias("c"), F.min("run").alias("lo"), F.max("run").alias("hi")
    ).where("c > 1").drop("c"))
    met = cut_lineage(runs.join(digits, "digit").select(
        *_PIECE, "n", "place", "digit", "run", F.col("lo").eqNullSafe(F.col("hi")).alias("alike")))
    release(runs)
    alike = met.where("alike").select(*_PIECE, "n")
    mixed = met.where(~F.col("alike"))
    kinds = cut_lineage(mixed.groupBy("digit", "run").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct(*_PIECE, "n", "place")).alias("one")))
    copied = mixed.join(kinds.where("c > 1").select("digit", "run"), ["digit", "run"]).select(*_PIECE, "n")

    asked = kinds.select("one.*", (F.col("c") == 1).alias("sole")).groupBy(*_KEY).agg(
        F.collect_list(F.struct("first", "n", "place", "sole")).alias("asked"))
    shut = rows.select(*_KEY, "__text", "__doc").mapInArrow(_shut, f"__id bigint, __tag bigint, __doc {kind}, __shut binary")
    # Copies of a row would give its runs twice; one of them stands for all.
    texts = shut.select(*_KEY, "__shut").join(asked, list(_KEY)).groupBy(*_KEY).agg(
        F.any_value("__shut").alias("__shut"), F.any_value("asked").alias("asked"))
    pieces = cut_lineage(texts.mapInArrow(
        _pieces_of(width), "__id bigint, __tag bigint, first int, n int, place int, sole boolean, bytes binary"))

    chunks = cut_lineage(pieces.mapInArrow(_chunks_of(width), "core bigint, joint bigint, __id bigint, __tag bigint,"
                         " first int, c int, begin int, n int, sole boolean"))
    cores = cut_lineage(chunks.groupBy("core").agg(
        F.count(F.lit(1)).alias("k"), F.max("sole").alias("s"), (F.min("joint") == F.max("joint")).alias("settled")
    ).where("k > 1 and s").select("core", "settled"))
    kept = cut_lineage(chunks.join(cores, "core").select(*_PIECE, "begin", "n", "sole", "settled"))
    settled = kept.where("settled and sole").select(*_KEY, F.col("begin").alias("first"), "n")
    open_ = kept.where("not settled").groupBy(*_PIECE).agg(F.collect_list(F.struct("begin", "n")).alias("chunks"))
    suffixes = cut_lineage(pieces.select(*_PIECE, "sole", "bytes").join(open_, list(_PIECE)).mapInArrow(
        _suffixes_of(width), "suffix bigint, __id bigint, __tag bigint, first int, sole boolean"))
    twice = cut_lineage(suffixes.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("k"), F.max("sole").alias("s")).where("k > 1 and s").select("suffix"))
    border = suffixes.where("sole").join(twice, "suffix").select(*_PIECE, F.lit(1).alias("n"))

    found = alike.unionByName(copied).unionByName(settled).unionByName(border)
    spans = found.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    return shut.join(spans, list(_KEY), "left").select("__doc", "__shut", "spans").mapInArrow(
        _cut(width), f"__doc {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string,"
        " spans array<struct<start:bigint,end:bigint>>").withColumnRenamed("__doc", id_col)
