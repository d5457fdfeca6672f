"""Quality rules: counts with fixed limits, then a calibrated hashed n-gram classifier.

The classifier is a logistic regression over hashed words, word pairs and byte 4-grams, fitted on a
bounded sample of the labelled rows and calibrated on a part of it that was not fitted. Texts are
counted and scored in Arrow batches, whole, in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions.durable import cut_lineage, release
from murmura.llm.features import Profile, calibrate, fit, sigmoid
from murmura.llm.text import slices, small_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, profile: Profile) -> np.ndarray:
        return sigmoid(self.slope * profile.logits(self.weights, self.bias) + self.shift)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(target, place, tag, text) to (target, place, tag, slots, values)."""
    for batch in batches:
        for part in slices(batch.column(3)):
            held = Profile(part).vectors()
            span = slice(part.first, part.first + part.n)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i)[span] for i in range(3)],
                pa.array([s.astype(np.int32) for s, _ in held], pa.list_(pa.int32())),
                pa.array([v.astype(np.float32) for _, v in held], pa.list_(pa.float32())),
            ], ["target", "place", "tag", "slots", "values"])


def fit_scorer(rows: DataFrame, sample: int, seed: int = 11) -> Scorer | None:
    """A scorer fitted on (target, place, text), at most ``sample`` rows; None without both classes.

    ``place`` is a seeded hash; every fifth row by it calibrates; of equal places the smallest hashes of the text come first,
    and where an id repeats, more than half of the sample from one side of 0.5 only where the other side has fewer. The
    vectors of the sample alone come to the driver: each has at most DIM slots, so ``sample`` bounds their size.
    """
    tagged = rows.select("target", "place", F.xxhash64("text").alias("tag"), "text")
    vectors = cut_lineage(tagged.mapInArrow(_vectors, "target double, place bigint, tag bigint, slots array<int>, values array<float>"))
    sides = vectors.select((F.col("target") >= 0.5).alias("side")).groupBy("side").count().collect()
    held = vectors
    if sum(n for _, n in sides) > sample:
        # Half of each side, and more of one only where the other has fewer.
        most = {side: max(sample // 2, sample - sum(m for other, m in sides if other != side)) for side, _ in sides}
        picked = [
            vectors.where((F.col("target") >= 0.5) == F.lit(side)).orderBy("place", "tag").limit(most[side]) for side, _ in sorted(sides)]
        held = reduce(DataFrame.unionByName, picked)
    held = held.toArrow()
    release(vectors)
    if not held.num_rows:
        return None
    order = np.lexsort((held["tag"].to_numpy(), held["place"].to_numpy()))
    target = held["target"].to_numpy()[order]
    slots_, values_ = (held[c].combine_chunks() for c in ("slots", "values"))
    slots = [slots_[int(k)].values.to_numpy() for k in order]
    values = [values_[int(k)].values.to_numpy() for k in order]
    if not 0 < target.round().sum() < len(target):
        return None
    fitted = np.arange(len(target)) % 5 != 0
    if not 0 < target[fitted].round().sum() < fitted.sum():
        fitted[:] = True
    pick = np.flatnonzero(fitted)
    weights, bias = fit([slots[k] for k in pick], [values[k] for k in pick], target[pick])
    rest = np.flatnonzero(~fitted) if (~fitted).any() else pick
    logits = np.array([bias + (weights[slots[k]] * values[k]).sum() for k in rest])
    slope, shift = calibrate(logits, target[rest].round())
    return Scorer(weights.astype(np.float32), float(bias), slope, shift) if slope > 0 else Scorer(weights.astype(np.float32), float(bias))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, label: str, id_col: str, text_col: str) -> DataFrame:
    """(target, place, text) of at most ``sample`` labelled documents, half of each class where there are enough."""
    place = F.xxhash64(F.lit(11), "doc_id")
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(label).cast("double").alias("target")).select("doc_id", "target", place.alias("place"))
    picked = None
    for value in (0.0, 1.0):
        half = known.where(F.col("target") == value).orderBy("place", "doc_id").limit(sample // 2)
        picked = half if picked is None else picked.unionByName(half)
    # At most ``sample`` rows of three numbers.
    picked = F.broadcast(picked.withColumnRenamed("doc_id", "__labelled"))
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"))
    return texts.join(picked, F.col("__doc") == F.col("__labelled")).select("target", "place", "text")


def profiled(columns: Callable[[Profile], list[pa.Array]], names: list[str]):
    """A map over Arrow batches (__doc, text): __doc and what ``columns`` makes of each profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                doc = batch.column(0)[part.first: part.first + part.n]
                yield pa.RecordBatch.from_arrays([doc, *columns(Profile(part))], ["__doc", *names])

    return run


def quality_rules(
    docs: DataFrame, labels: DataFrame, sample: int = 2000, threshold: float = 0.5, min_words: int = 50,
    max_repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score, kept).

    ``quality_score`` is the calibrated probability of label 1, learned from at most ``sample`` rows of ``labels`` (doc_id,
    quality); null where both classes cannot be learned, and the rules alone then decide. A null text has no words and fails. Repeated
    rows get equal answers; an empty table gives no rows; clashing extra columns are not looked at.
    """
    scorer = fit_scorer(labelled_sample(docs, labels, sample, "quality", id_col, text_col), sample)

    def columns(p: Profile) -> list[pa.Array]:
        quality = pa.nulls(p.n, pa.float64()) if scorer is None else pa.array(scorer.probability(p), pa.float64())
        return [*[pa.array(getattr(p, c), pa.int64()) for c in COUNTS], quality]

    kind = small_batches(docs).schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")).mapInArrow(
        profiled(columns, [*COUNTS, "quality_score"]),
        f"__doc {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", quality_score double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return counted.select(
        F.col("__doc").alias(id_col), *COUNTS, failed.alias("base_failed"), "quality_score",
        (~failed & (F.coalesce(F.col("quality_score"), F.lit(1.0)) >= threshold)).alias("kept"))
