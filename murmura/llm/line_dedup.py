"""Lines met in several documents, found by probing sharded minimal perfect hashes.

Texts are cut into blocks of whole documents; a block lists its distinct line keys once, as 128-bit hashes with
the number of its documents that hold them and the largest id. Summed over blocks they give all distinct
line hashes; a shard of them is one row: a minimal perfect hash (levels of bits, a key settles at the first level where no other
one falls on its bit) whose ranks index an array of fingerprints and one of counts. Blocks send their hashes, as
arrays, to the shards and get back the places of those to drop; no line travels. The fingerprint confirms
each answer. A shard with many probes is copied over as many tasks as its counted load asks for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions.durable import cut_lineage, release
from murmura.llm.text import mix, slices, small_batches

BLOCK_BYTES = 1 << 22
SHARD_KEYS = 1 << 16
PROBES = 1 << 20
_GAMMA = 2
_INNER = bytes(range(0x80, 0xC0))
_U = np.uint64


class PerfectHash:
    """Distinct 128-bit keys (h, f) to 0 .. n - 1, from levels of bits; other keys get any number, or -1."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        self.flags = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        self.ranks = np.cumsum(self.flags) - 1

    @staticmethod
    def _slots(h: np.ndarray, f: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h ^ mix(f + _U(level + 1))) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray, f: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(h):
            size = -(-_GAMMA * len(h) // 8) * 8
            at = cls._slots(h, f, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            flags = np.zeros(size, bool)
            flags[at[alone]] = True
            sizes.append(size)
            levels.append(flags)
            if len(sizes) > 200:
                raise ValueError("keys of a perfect hash must be distinct")
            h, f = h[~alone], f[~alone]
        return cls(sizes, np.packbits(np.concatenate(levels)).tobytes() if levels else b"")

    def bits(self) -> bytes:
        return np.packbits(self.flags).tobytes()

    def find(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(h), -1), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._slots(h[left], f[left], level, size)
            set_ = self.flags[at]
            out[left[set_]] = self.ranks[at[set_]]
            left, base = left[~set_], base + size
        return out


def _list(values, kind) -> pa.Array:
    """One row that holds all values."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _blocks_of(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, number = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch.column(1), BLOCK_BYTES):
                ids = batch.column(0)[part.first: part.first + part.n]
                raw, names = part.data.tobytes(), ids.to_pylist()
                seen: dict[bytes, int] = {}
                codes, n_lines, count, last = [], [], [], []
                for row in range(part.n):
                    lines, mine = raw[part.offs[row]: part.offs[row + 1]].split(b"\n"), set()
                    for line in lines:
                        key = line.strip().lower()
                        if len(key) < least or not key.isascii() and len(key.translate(None, _INNER)) < least:
                            codes.append(-1)
                            continue
                        code = seen.setdefault(key, len(seen))
                        codes.append(code)
                        mine.add(code)
                    n_lines.append(len(lines))
                    fresh = len(seen) - len(count)
                    count += [0] * fresh
                    last += [None] * fresh
                    name = names[row]
                    for code in mine:
                        count[code] += 1
                        if name is not None and (last[code] is None or name > last[code]):
                            last[code] = name
                both = np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in seen), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), _list(ids, ids.type), pa.array([pack.compress(raw)], pa.binary()),
                    _list(part.offs[1:] - part.offs[:-1], pa.int64()), _list(n_lines, pa.int32()), _list(codes, pa.int32()),
                    _list(both[:, 0], pa.int64()), _list(both[:, 1], pa.int64()), _list(count, pa.int32()), _list(last, ids.type),
                ], ["block", "ids", "shut", "sizes", "n_lines", "codes", "h", "f", "held", "last"])
                number += 1

    return run


def _shard_of(kind: pa.DataType, min_docs: int):
    """The keys of a shard to its row."""

    def build(table: pa.Table) -> pa.Table:
        h, f, docs, load = (table[c].to_numpy() for c in ("h", "f", "docs", "blocks"))
        h, f = h.view(np.uint64), f.view(np.uint64)
        perfect = PerfectHash.build(h, f)
        at = np.argsort(perfect.find(h, f))
        often = at[docs[at] >= min_docs]
        return pa.table({
            "shard": table["shard"].slice(0, 1).combine_chunks(), "load": pa.array([int(load.sum())], pa.int64()),
            "levels": _list(perfect.sizes, pa.int64()), "bits": pa.array([perfect.bits()], pa.binary()),
            "prints": pa.array([(f[at] >> _U(32)).astype(np.uint32).tobytes()], pa.binary()),
            "counts": pa.array([docs[at].astype(np.int64).tobytes()], pa.binary()),
            "holders": _list(table["holder"].combine_chunks().take(pa.array(often)), kind),
        })

    return build


def _probes_of(shards: int):
    """A block's hashes to one row for each shard that they fall in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h, f = (batch.column(k)[row].values.to_numpy() for k in (1, 2))
                shard = h % shards
                order = np.argsort(shard, kind="stable")
                which, first = np.unique(shard[order], return_index=True)
                offs = pa.array(np.concatenate([first, [len(h)]]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(which, pa.int64()), pa.array(np.full(len(which), batch.column(0)[row].as_py()), pa.int64()),
                    *[pa.ListArray.from_arrays(offs, pa.array(x[order], t))
                      for x, t in ((np.arange(len(h)), pa.int32()), (h, pa.int64()), (f, pa.int64()))],
                ], ["shard", "block", "at", "h", "f"])

    return run


def _answers_of(kind: pa.DataType, min_docs: int):
    """(probes, the shard) to (block, places found often, their holders)."""

    def answer(probes: pa.Table, index: pa.Table) -> pa.Table:
        probes = probes.combine_chunks()
        names = ["block", "at", "holders"]
        if not probes.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(kind))], names)
        perfect = PerfectHash(index["levels"][0].values.to_pylist(), index["bits"][0].as_py())
        prints = np.frombuffer(index["prints"][0].as_py(), np.uint32)
        often = np.frombuffer(index["counts"][0].as_py(), np.int64) >= min_docs
        held = index["holders"][0].values
        at, h, f = (probes[c].combine_chunks() for c in ("at", "h", "f"))
        h, f = (x.flatten().to_numpy().view(np.uint64) for x in (h, f))
        rank = perfect.find(h, f)
        if len(rank) and (rank.min() < 0 or (prints[rank] != (f >> _U(32)).astype(np.uint32)).any()):
            raise ValueError("a line is not in the shard of its hash")
        hit = np.flatnonzero(often[rank])
        which = (np.cumsum(often) - 1)[rank[hit]]
        lengths = np.bincount(np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())[hit], minlength=len(at))
        offs = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        out = pa.table([
            probes["block"], pa.ListArray.from_arrays(offs, at.flatten().take(pa.array(hit))),
            pa.ListArray.from_arrays(offs, held.take(pa.array(which))),
        ], names)
        return out.filter(pa.array(lengths > 0))

    return answer


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their answers to (id, lines, dropped, kept text) of every document."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in range(batch.num_rows):
            raw = unpack.decompress(batch.column(1)[row].as_py())
            ids, sizes, n_lines, codes = (batch.column(k)[row].values for k in (0, 2, 3, 4))
            holder: dict[int, object] = {}
            if batch.column(5)[row].is_valid:
                for some in batch.column(5)[row].as_py():
                    holder.update(zip(some["at"], some["holders"], strict=True))
            codes, sizes, n_lines = codes.to_pylist(), sizes.to_pylist(), n_lines.to_pylist()
            at, line, dropped, kept = 0, 0, [], []
            for name, size, n in zip(ids.to_pylist(), sizes, n_lines, strict=True):
                text, mine = raw[at: at + size], codes[line: line + n]
                at, line = at + size, line + n
                stay = [code not in holder or holder[code] is None or holder[code] == name for code in mine]
                dropped.append(n - sum(stay))
                if dropped[-1]:
                    text = b"\n".join(part for part, s in zip(text.split(b"\n"), stay, strict=True) if s)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ], ["__doc", "n_lines", "n_dropped", "kept"])


def dedup_lines(
    docs: DataFrame, least: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_lines, n_dropped, kept), a row per row of ``docs``; ``kept`` is the text without its dropped lines.

    Lines are cut at \\n. Keys (ASCII white space stripped at both ends, A-Z lower-cased) of at least ``least`` code points that
    at least ``min_docs`` rows hold lose their lines, but for the rows of the largest id among them, which keep all of theirs. A
    null or empty text is one empty line. Every row counts as a document, repeated ones too. A null id is
    never the largest; a key that only rows with null ids hold stays. Other columns are not
    looked at. An empty table gives no rows.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text"))
    field = rows.schema["__doc"]
    kind = field.dataType.simpleString()
    blocks = cut_lineage(rows.mapInArrow(_blocks_of(least), (
        f"block bigint, ids array<{kind}>, shut binary, sizes array<bigint>, n_lines array<int>, codes array<int>,"
        f" h array<bigint>, f array<bigint>, held array<int>, last array<{kind}>")))
    keys = cut_lineage(blocks.select(F.explode(F.arrays_zip("h", "f", "held", "last")).alias("k")).select("k.*").groupBy("h", "f").agg(
        F.sum("held").cast("bigint").alias("docs"), F.count(F.lit(1)).alias("blocks"), F.max("last").alias("holder")))
    shards = max(1, math.ceil(keys.count() / SHARD_KEYS))
    arrow = _arrow_type(field)
    index = cut_lineage(keys.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInArrow(
        _shard_of(arrow, min_docs), (
            "shard bigint, load bigint, levels array<bigint>, bits binary, prints binary, counts binary,"
            f" holders array<{kind}>")))
    copies = index.select("shard", F.ceil(F.col("load") / F.lit(PROBES)).alias("copies"))
    probes = blocks.select("block", "h", "f").mapInArrow(
        _probes_of(shards), "shard bigint, block bigint, at array<int>, h array<bigint>, f array<bigint>")
    probes = probes.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("block"), "copies")).drop("copies")
    spread = index.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).drop("copies")
    found = probes.groupBy("shard", "copy").cogroup(spread.groupBy("shard", "copy")).applyInArrow(
        _answers_of(arrow, min_docs), f"block bigint, at array<int>, holders array<{kind}>")
    answers = cut_lineage(found.groupBy("block").agg(F.collect_list(F.struct("at", "holders")).alias("found")))
    release(keys, index)
    # One plan at every size: blocks are dealt by number.
    return blocks.join(answers.hint("merge"), "block", "left").select("ids", "shut", "sizes", "n_lines", "codes", "found").mapInArrow(
        _cut, f"__doc {kind}, n_lines bigint, n_dropped bigint, kept string").withColumnRenamed("__doc", id_col)


def _arrow_type(field) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)
