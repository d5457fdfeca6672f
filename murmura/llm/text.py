"""Words, hashes and per-document sums over whole Arrow batches of text.

A batch is seen as one byte buffer with document offsets; everything is computed for all bytes of
the buffer at once. Slices keep the working memory of a task bounded whatever the batch holds;
only a single document longer than ``SLICE_BYTES`` is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Modulus and base of a second polynomial: products of two residues fit 64 bits, and powers of two have no part in it.
_PRIME = (1 << 31) - 1
_BASE2 = 1_220_703_125
_U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with at most BATCH_ROWS rows in an Arrow batch of its session, so that rows of long texts or sets fit a worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(conf.get(name, "10000"))
    if held <= 0 or held > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA3B195354A39B70D)
    return x ^ (x >> _U(32))


_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)
_powers2 = np.ones(1, np.uint64)
_inverses2 = np.ones(1, np.uint64)


def _residues(base: int, size: int) -> np.ndarray:
    """base ** 0, 1, .. modulo _PRIME, by doubling."""
    out = np.ones(size, np.uint64)
    have = 1
    while have < size:
        more = min(have, size - have)
        out[have: have + more] = out[:more] * _U(pow(base, have, _PRIME)) % _U(_PRIME)
        have += more
    return out


def _grow(n: int) -> None:
    global _powers, _inverses, _powers2, _inverses2
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers, _inverses = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        _powers[0] = _inverses[0] = 1
        np.cumprod(_powers, out=_powers)
        np.cumprod(_inverses, out=_inverses)
        _powers2, _inverses2 = _residues(_BASE2, size), _residues(pow(_BASE2, -1, _PRIME), size)


class Rolling:
    """Hash of any byte range of a buffer in constant time, as two polynomials over prefix sums.

    One is taken modulo 2^64 and one modulo a prime: strings made to be equal under every odd base modulo 2^64 differ in the other.
    """

    def __init__(self, data: np.ndarray):
        _grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * _powers[: len(data)], out=self.sums[1:])
        self.more = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * _powers2[: len(data)], out=self.more[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        first = (self.sums[ends] - self.sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64)
        return self._both(first, (self.more[ends] - self.more[starts]) % _U(_PRIME) * _inverses2[starts])

    @staticmethod
    def _both(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix(first ^ (second % _U(_PRIME) * _U(_BASE)))

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from every position that has so many left."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        first = (self.sums[width:] - self.sums[:n]) * _inverses[:n]
        return self._both(first, (self.more[width:] - self.more[:n]) % _U(_PRIME) * _inverses2[:n])


class Slice:
    """Some consecutive documents: ``data`` (bytes), ``offs`` (len n + 1), rows ``first`` onward."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int):
        self.data, self.offs, self.first, self.n = data, offs, first, len(offs) - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per document, the number of flagged bytes."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, "right") - 1

    def words(self, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the words: runs free of ASCII white space, or of other bytes flagged in ``outside``."""
        inside = ~outside[self.data]
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.offs] = True
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return starts, ends, self.doc_of(starts)


def held(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings at ascending ranges that do not overlap."""
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    offs = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    return pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))])


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column, nulls as empty, in slices of at most ``limit`` bytes or one document."""
    column = column.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Slice(data[offs[first]: offs[last]], offs[first: last + 1] - offs[first], first)
        first = last


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches joined or cut so that their texts take about ``limit`` bytes."""
    waiting, size = [], 0
    for batch in batches:
        first = 0
        for part in slices(batch.column(column), limit):
            if waiting and size + len(part.data) > limit:
                waiting.append(batch.slice(first, part.first - first))
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, size, first = [], 0, part.first
            size += len(part.data)
        waiting.append(batch.slice(first))
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def shingles(word_hashes: np.ndarray, docs: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``size`` words; a shorter document is one run of all its words."""
    if not len(docs):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(docs, minlength=n_docs)
    n = max(0, len(docs) - size + 1)
    folded = np.zeros(n, np.uint64)
    for k in range(size):
        folded = mix(folded ^ word_hashes[k: k + n]) + _U(k + 1)
    whole = docs[:n] == docs[size - 1: size - 1 + n]
    out, owner = folded[whole], docs[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
        rest = []
        for d in short:
            h = np.zeros(1, np.uint64)
            for k in range(counts[d]):
                h = mix(h ^ word_hashes[begins[d] + k: begins[d] + k + 1]) + _U(k + 101)
            rest.append(h)
        out, owner = np.concatenate([out, *rest]), np.concatenate([owner, short])
    return out, owner


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
