"""Similarity join on word n-grams with signature trees.

A document is the set of its shingles; equal sets are one class. Shingles have a global order, by hash, with those
known to be frequent (from a sample; any order is right) last. Classes as similar as asked share one of the first
shingles in that order, so these lead them to common buckets. First every class of a bucket is compared with
the bucket's smallest one, and what links is contracted, so that a group of near copies costs comparisons in proportion to
its size. Buckets that still hold several components become signature trees: leaves are classes, nodes hold the
OR of token bitmaps, the range of set sizes and the first place of the bucket's shingle, and a dual traversal drops pairs of
nodes whose largest possible overlap is too small. Pairs are verified on the sets themselves, in rounds: first the most promising
partners of every class, then, in buckets that hold several components even so, more of them, at last all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.durable import cut_lineage, release
from murmura.llm.rows import text_of, WORD
from murmura.llm.text import LOWER, mix, Rolling, shingles, signed, Slice, slices, small_batches
from murmura.operators.components import components

SAMPLED = 32
FREQUENT = 1 << 16
LEAVES = 256
FAN = 16
#: Earlier buckets a class names beside each of its own, so that few pairs are found twice; never what is found.
EARLIER = 8
#: Partners that a class names in a pair of blocks, by rounds; at last all.
PARTNERS = (4, 32, None)
#: Bits of a node, and bits of a class, by which pairs of classes are judged.
_BITS = 512
_WIDE = 2048
_STEP = 1.04


def _sets(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a slice as (documents, hashes), by document and hash."""
    starts, ends, docs = part.words()
    hashes, owner = shingles(Rolling(LOWER[part.data]).ranges(starts, ends), docs, part.n, size)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def _identity(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes, set ids): a set's id mixes the sum of its mixed shingles with its size; its last 8 bits are the size class."""
    sizes = np.bincount(owner, minlength=n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(0x5851F42D4C957F2D)))])
    ends = np.cumsum(sizes)
    ids = mix((total[ends] - total[ends - sizes]) ^ sizes.astype(np.uint64))
    return sizes, (ids & ~np.uint64(255)) | _size_class(sizes).astype(np.uint64)


def _sampled(ids: np.ndarray) -> np.ndarray:
    """One set in SAMPLED, whatever its size: by bits of the id above the size class."""
    return (ids >> np.uint64(8)) % np.uint64(SAMPLED) == 0


def _size_class(sizes: np.ndarray) -> np.ndarray:
    """Sizes by factors of _STEP, the largest together."""
    return np.minimum(255, np.log(np.maximum(sizes, 1)) / math.log(_STEP)).astype(np.int64)


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (as bytes) of ``size`` bytes, a power of two as before."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def _bitmaps(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """A bitmap for every set, of at least four bits a shingle and _WIDE bits."""
    out, at = [], 0
    for n in sizes.tolist():
        width = max(_WIDE, 1 << (4 * n - 1).bit_length() if n else _WIDE)
        flags = np.zeros(width, bool)
        flags[(hashes[at: at + n] % np.uint64(width)).astype(np.int64)] = True
        out.append(np.packbits(flags))
        at += n
    return out


def _listed(owner: np.ndarray, values: np.ndarray, n: int, kind=None) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))


def _identified(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                owner, hashes = _sets(part, size)
                sizes, ids = _identity(owner, hashes, part.n)
                some = _sampled(ids)[owner]
                wide = _bitmaps(hashes, sizes)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k)[part.first: part.first + part.n] for k in (0, 2)], pa.array(sizes, pa.int64()), pa.array(signed(ids)),
                    _listed(owner[some], signed(hashes[some]), part.n, pa.int64()),
                    pa.array([_folded(w, _WIDE // 8).tobytes() for w in wide], pa.binary()),
                    pa.array([w.tobytes() for w in wide], pa.binary()),
                ], ["__doc", "__tag", "n", "set_id", "sample", "bits", "wide"])

    return run


def _first(size: int, percent: int, frequent: np.ndarray, rank: np.ndarray):
    """(set_id, first shingles) of every set that is not empty, once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                owner, hashes = _sets(part, size)
                sizes, ids = _identity(owner, hashes, part.n)
                late = np.zeros(len(hashes), np.int64)
                if len(frequent):
                    k = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
                    late = np.where(frequent[k] == hashes, rank[k] + 1, 0)
                order = np.lexsort((hashes, late, owner))
                begins = np.cumsum(sizes) - sizes
                place = np.arange(len(owner)) - begins[owner]
                asked = sizes - (-(-percent * sizes // 100)) + 1
                take = np.zeros(part.n, bool)
                take[np.unique(ids, return_index=True)[1]] = True
                take &= sizes > 0
                keep = (place < asked[owner]) & take[owner]
                rows = np.flatnonzero(take)
                renumbered = np.cumsum(take) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(ids)[rows]),
                    _listed(renumbered[owner[order][keep]], signed(hashes[order][keep]), len(rows), pa.int64()),
                ], ["set_id", "first"])

    return run


def _shut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        text = batch.column(1).cast(pa.binary()).fill_null(b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([pack.compress(t.as_buffer()) for t in text], pa.binary())], ["__doc", "__shut"])


def _packed(size: int):
    """Compressed texts to (set_id, n, the set as ascending 64-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                texts = [unpack.decompress(t.as_py()) for t in batch.column(0)[a: a + 256]]
                for part in slices(pa.array(texts, pa.binary()).cast(pa.string())):
                    owner, hashes = _sets(part, size)
                    sizes, ids = _identity(owner, hashes, part.n)
                    ends = np.cumsum(sizes)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(signed(ids)), pa.array(sizes, pa.int64()),
                        pa.array([hashes[e - s: e].tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary()),
                    ], ["set_id", "n", "packed"])

    return run


def _unpack(held) -> np.ndarray:
    return np.frombuffer(held.as_buffer(), np.uint64)


def _linked(percent: int):
    """(a, b, set a, set b) to the linked (a, b, shared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = [], None, None
            for row in range(batch.num_rows):
                a = batch.column(0)[row].as_py()
                if a != last:
                    last, left = a, _unpack(batch.column(2)[row])
                right = _unpack(batch.column(3)[row])
                both = np.concatenate([left, right])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(left) + len(right) - shared):
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], ["a", "b"])

    return run


def _bounded(percent: int):
    """The pairs (a, b, na, nb, wide bitmaps) that sizes and bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(i).to_numpy() for i in (2, 3)]
            lack = np.zeros((2, batch.num_rows), np.int64)
            for row in range(batch.num_rows):
                one, two = (np.frombuffer(batch.column(i)[row].as_buffer(), np.uint8) for i in (4, 5))
                width = min(len(one), len(two))
                one, two = _folded(one, width).view(np.uint64), _folded(two, width).view(np.uint64)
                lack[0, row] = np.bitwise_count(one & ~two).sum()
                lack[1, row] = np.bitwise_count(two & ~one).sum()
            most = np.minimum(sizes[0] - lack[0], sizes[1] - lack[1])
            fine = pa.array(100 * most >= percent * (sizes[0] + sizes[1] - most))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(fine) for i in (0, 1)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, known: DataFrame, rows: DataFrame, kind: str, size: int, percent: int) -> DataFrame:
    """Those of the pairs that reach the similarity.

    Only the texts of classes in pairs that are left are fetched, once a class.
    """
    one = known.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
    two = known.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
    left = cut_lineage(pairs.join(one, "a").join(two, "b").where(
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "na", "nb", "wa", "wb").mapInArrow(
        _bounded(percent), "a bigint, b bigint"))
    ends = left.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    reps = known.join(ends, "set_id", "left_semi").select(F.col("rep").alias("__rep")).distinct()
    shut = rows.mapInArrow(_shut, f"__doc {kind}, __shut binary")
    sets = cut_lineage(shut.join(reps, F.col("__doc").eqNullSafe(F.col("__rep"))).select("__shut").mapInArrow(
        _packed(size), "set_id bigint, n bigint, packed binary"))
    both = left.join(sets.select(F.col("set_id").alias("a"), F.col("packed").alias("pa")), "a").join(
        sets.select(F.col("set_id").alias("b"), F.col("packed").alias("pb")), "b")
    links = cut_lineage(both.select("a", "b", "pa", "pb").mapInArrow(_linked(percent), "a bigint, b bigint"))
    release(left, sets)
    return links


class _Tree:
    """A signature tree over the leaves of a block, ordered by size; ``levels`` go from the leaves up.

    A node is (smallest size, largest size, OR of the bitmaps below, AND of them, first place of the bucket's shingle).
    """

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray, ids: np.ndarray, place: np.ndarray):
        self.order = order = np.lexsort((ids, n))
        self.ids, self.comp, self.n, self.wide = ids[order], comp[order], n[order], bits[order]
        narrow = np.bitwise_or.reduce(self.wide.reshape(len(n), -1, _BITS // 64), axis=1)
        level = (n[order], n[order], narrow, narrow, place[order])
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), FAN)
            level = (np.minimum.reduceat(level[0], at), np.maximum.reduceat(level[1], at),
                     np.bitwise_or.reduceat(level[2], at, axis=0), np.bitwise_and.reduceat(level[3], at, axis=0),
                     np.minimum.reduceat(level[4], at))
            self.levels.append(level)


def _possible(one: tuple, two: tuple, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether nodes a and b may hold a linked pair, by size ranges and the largest overlap the bitmaps allow.

    Every leaf of a node has its AND bits; each of them that no leaf of the other node has stands for a shingle at least
    that is not shared. Nor is what comes before the bucket's shingle: a linked pair that shares an earlier one is found in
    the bucket of the first it shares.
    """
    low1, high1, any1, all1, place1 = (x[a] for x in one)
    low2, high2, any2, all2, place2 = (x[b] for x in two)
    lack1 = np.bitwise_count(all1 & ~any2).sum(axis=1, dtype=np.int64)
    lack2 = np.bitwise_count(all2 & ~any1).sum(axis=1, dtype=np.int64)
    overlap = np.minimum(high1 - np.maximum(lack1, place1), high2 - np.maximum(lack2, place2))
    sized = (100 * high1 >= percent * low2) & (100 * high2 >= percent * low1)
    return sized & (100 * overlap >= percent * (low1 + low2 - overlap))


def _met_before(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether leaves a and b name a common earlier bucket: the first that they share finds them."""
    met = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 15):
        x, y = a[k: k + (1 << 15)], b[k: k + (1 << 15)]
        equal = one[0][x][:, :, None] == two[0][y][:, None, :]
        met[k: k + len(x)] = (equal & one[1][x][:, :, None] & two[1][y][:, None, :]).any(axis=(1, 2))
    return met


def _likeness(left: _Tree, right: _Tree, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(most shingles shared, all shingles then) that the wide bitmaps of leaves a and b allow."""
    shared = np.empty(len(a), np.int64)
    for k in range(0, len(a), 1 << 14):
        x, y = a[k: k + (1 << 14)], b[k: k + (1 << 14)]
        one, two = left.wide[x], right.wide[y]
        shared[k: k + len(x)] = np.minimum(
            left.n[x] - np.bitwise_count(one & ~two).sum(axis=1, dtype=np.int64),
            right.n[y] - np.bitwise_count(two & ~one).sum(axis=1, dtype=np.int64))
    return shared, left.n[a] + right.n[b] - shared


def _foremost(owner: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the first ``most`` of their owner in ``order``."""
    by = order[np.argsort(owner[order], kind="stable")]
    sorted_ = owner[by]
    first = np.zeros(len(owner), bool)
    first[by] = np.arange(len(by)) - np.searchsorted(sorted_, sorted_) < most
    return first


def _traversed(percent: int, most: int | None):
    """Pairs of blocks of one bucket to the class pairs that no bound rules out; with ``most``, to the most alike of each class.

    Where some are left to a later round, the pair of blocks is named beside.
    """

    def tree(block) -> _Tree:
        ids, comp, n, bits, place, earlier = (block.field(i) for i in range(6))
        raw = np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(len(ids), -1)
        held = _Tree(n.to_numpy(), raw, comp.to_numpy(), ids.to_numpy(), place.to_numpy())
        named, given = np.zeros((len(ids), EARLIER), np.int64), np.zeros((len(ids), EARLIER), bool)
        for row, at in enumerate(held.order.tolist()):
            some = earlier[at].values.to_numpy()
            named[row, : len(some)], given[row, : len(some)] = some, True
        held.earlier = named, given
        return held

    def met(left: _Tree, right: _Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
        x, y = len(left.levels) - 1, len(right.levels) - 1
        a, b = (v.ravel() for v in np.meshgrid(np.arange(len(left.levels[x][0])), np.arange(len(right.levels[y][0])), indexing="ij"))
        while True:
            if same:
                a, b = a[a <= b], b[a <= b]
            fine = _possible(left.levels[x], right.levels[y], a, b, percent)
            a, b = a[fine], b[fine]
            if x == y == 0:
                return a, b
            # Both sides go down one level, to all children of each node pair.
            if x:
                x -= 1
                kids = a[:, None] * FAN + np.arange(FAN)
                fits = kids < len(left.levels[x][0])
                b, a = np.repeat(b, fits.sum(axis=1)), kids[fits]
            if y:
                y -= 1
                kids = b[:, None] * FAN + np.arange(FAN)
                fits = kids < len(right.levels[y][0])
                a, b = np.repeat(a, fits.sum(axis=1)), kids[fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, later = [np.zeros((0, 2), np.int64)], []
            for row in range(batch.num_rows):
                left, same = tree(batch.column(0)[row].values), batch.column(2)[row].as_py()
                right = left if same else tree(batch.column(1)[row].values)
                a, b = met(left, right, same)
                new = left.comp[a] != right.comp[b]
                a, b = a[new], b[new]
                shared, united = _likeness(left, right, a, b)
                new = 100 * shared >= percent * united
                new[new] = ~_met_before(left.earlier, right.earlier, a[new], b[new])
                a, b, alike = a[new], b[new], shared[new] / united[new]
                if most is not None and len(a) > most:
                    order = np.lexsort((b, a, -alike))
                    # In one block a class can be on either side.
                    first = _foremost(a, order, most) | _foremost(b, order, most)
                    if not first.all():
                        later.append([batch.column(i)[row].as_py() for i in (3, 4, 5)])
                    a, b = a[first], b[first]
                ids = np.stack([left.ids[a], right.ids[b]], axis=1)
                ids.sort(axis=1)
                found.append(ids)
            pairs = np.unique(np.concatenate(found), axis=0)
            none = [None] * len(pairs)
            yield pa.RecordBatch.from_arrays([
                *[pa.array(pairs[:, i].tolist() + [None] * len(later), pa.int64()) for i in (0, 1)],
                *[pa.array(none + [x[i] for x in later], pa.int64()) for i in range(3)],
            ], ["a", "b", "s", "block", "block2"])

    return run


def _component_of(ids: DataFrame, links: DataFrame) -> DataFrame:
    return components(ids.select(F.col("set_id").alias("node")), links).select(
        F.col("node").alias("set_id"), F.col("component").alias("comp"))


def jaccard_groups(
    docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_shingles, component_id), a row per row of ``docs``.

    Two documents are linked where 100 * shared >= percent * united shingles; ``component_id`` is the smallest id reachable
    over links. A text of fewer than ``size`` words is one shingle of all of them; a null text and one without words
    are linked with nothing and name themselves. Rows with a null id link like others but name no
    component unless all of it is null. Repeated rows are of one class. An empty table gives no rows.
    """
    grouped = _grouped(docs, size, percent, id_col, text_col)
    names = grouped.where("n > 0").groupBy("comp").agg(F.min("__doc").alias("component_id"))
    return grouped.join(names, "comp", "left").select(
        F.col("__doc").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("__doc")).alias("component_id"))


def _tag(id_col: str, text_col: str) -> Column:
    """With the id, what only rows of equal text share; tells a null id from others."""
    return F.xxhash64(F.col(id_col).isNull(), text_of(text_col))


def _grouped(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(__doc, __tag, n, set_id, comp), a row per row of ``docs``; comp is null where there are no words."""
    kind = small_batches(docs).schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text"), _tag(id_col, text_col).alias("__tag"))
    classes = cut_lineage(rows.mapInArrow(
        _identified(size), f"__doc {kind}, __tag bigint, n bigint, set_id bigint, sample array<bigint>, bits binary, wide binary"))
    seen = classes.where(F.size("sample") > 0).select("set_id", F.explode("sample").alias("s")).distinct().groupBy("s").count()
    often = seen.where("count >= 4").orderBy(F.desc("count"), "s").limit(FREQUENT).collect()
    held = np.array([(r[0], r[1]) for r in often], np.int64).reshape(-1, 2)
    frequent = held[:, 0].astype(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    frequent, rank = frequent[order], held[:, 1][order]

    firsts = rows.select("__text").mapInArrow(_first(size, percent, frequent, rank), "set_id bigint, first array<bigint>")
    postings = firsts.select("set_id", F.posexplode("first").alias("place", "s"))
    # Written before it is joined, so that the join has shuffles of its own and can split a frequent shingle.
    buckets = cut_lineage(postings.groupBy("s").agg(
        F.min("set_id").alias("leader"), F.max("set_id").alias("other")).where("leader <> other").drop("other"))
    members = cut_lineage(postings.join(buckets, "s"))
    met = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("c")).select("set_id")
    known = cut_lineage(classes.where("n > 0").groupBy("set_id").agg(
        F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide"),
        F.min("__doc").alias("rep")).join(met, "set_id", "left_semi"))

    # Size classes, in the ids, drop most chance meetings before anything is fetched for them.
    apart = math.ceil(math.log(100 / percent) / math.log(_STEP)) + 1
    near = (F.abs(F.col("set_id").bitwiseAND(255) - F.col("leader").bitwiseAND(255)) <= apart)
    stars = members.where((F.col("set_id") != F.col("leader")) & near).groupBy(
        F.col("leader").alias("a"), F.col("set_id").alias("b")).agg(F.count(F.lit(1)).alias("c")).select("a", "b")
    tried = cut_lineage(stars)
    links = _verified(tried, known, rows, kind, size, percent)
    comps = cut_lineage(_component_of(known, links))

    split = cut_lineage(members.select("s", "set_id", "place").distinct().join(comps, "set_id"))
    mixed = cut_lineage(split.groupBy("s").agg(
        F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(
        "c > 2 and lo <> hi").select("s", F.ceil(F.col("c") / LEAVES).alias("blocks")))
    inside = cut_lineage(split.drop("comp").join(mixed, "s"))
    # A class has no more buckets here than shingles. What two share outside of these is already linked or compared.
    leads = inside.groupBy("set_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("place", "s"))), 1, EARLIER).alias("lead"))
    earlier = F.transform(F.filter("lead", lambda x: x["place"] < F.col("place")), lambda x: x["s"])
    inside = inside.join(leads, "set_id").select(
        "s", "set_id", "place", F.pmod(F.xxhash64("set_id"), "blocks").alias("block"), earlier.alias("earlier"))
    spent = [buckets, members, split, mixed]
    asked = None
    for most in PARTNERS:
        leaves = inside if asked is None else inside.join(asked.select("s").distinct(), "s", "left_semi")
        nodes = cut_lineage(leaves.join(comps, "set_id").join(known.select("set_id", "n", "bits"), "set_id").groupBy("s", "block").agg(
            F.collect_list(F.struct("set_id", "comp", "n", "bits", "place", "earlier")).alias("held")))
        other = nodes.select("s", F.col("block").alias("block2"), F.col("held").alias("held2"))
        meeting = nodes.join(other, "s").where("block <= block2")
        if asked is not None:
            meeting = meeting.join(asked, ["s", "block", "block2"], "left_semi")
        found = cut_lineage(meeting.select(
            "held", "held2", (F.col("block") == F.col("block2")).alias("same"), "s", "block", "block2").mapInArrow(
            _traversed(percent, most), "a bigint, b bigint, s bigint, block bigint, block2 bigint"))
        # Written once distinct: the optimizer would join what every bucket says of a pair.
        more = cut_lineage(found.where("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        links = links.unionByName(_verified(more, known, rows, kind, size, percent))
        tried = tried.unionByName(more)
        comps = cut_lineage(_component_of(known, links))
        asked = found.where("s is not null").select("s", "block", "block2")
        spent += [nodes, found, more]
        if not asked.limit(1).count():
            break
    final = comps
    release(known, *spent)

    return classes.select("__doc", "__tag", "n", "set_id").join(final, "set_id", "left").withColumn(
        "comp", F.when(F.col("n") > 0, F.coalesce("comp", "set_id")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group, of the smallest id, or of none where all are null; rows without words all stay.

    Of rows that share this id, those of one text count, and one of them stays.
    """
    # Of every component one (id, tag): rows are told apart, not ids. All but one of its rows go before the join.
    first = F.min(F.struct(F.col("__doc").isNull().alias("none"), "__doc", "__tag")).alias("m")
    stay = _grouped(docs, size, percent, id_col, text_col).where("n > 0").groupBy("comp").agg(first)
    name = F.coalesce(F.col("m.__doc").cast("string"), F.lit(""))
    stay = cut_lineage(stay.select(name.alias("__key"), F.col("m.__tag").alias("__tag")))
    worded = text_of(text_col).rlike(WORD)
    single = docs.where(worded).select(
        *docs.columns, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__key"), _tag(id_col, text_col).alias("__tag"),
    ).dropDuplicates(["__key", "__tag"]).join(stay, ["__key", "__tag"], "left_semi")
    return single.select(*docs.columns).union(docs.where(~worded))
