"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on each document. Votes are counted by pattern over all
documents (never more patterns than 3 to the power of the labellers), and expectation maximisation on those
counts estimates how often each labeller is right. The posteriors of a bounded sample train a hashed linear scorer,
which scores every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions.durable import cut_lineage
from murmura.llm.features import Profile
from murmura.llm.quality_rules import fit_scorer, profiled
from murmura.llm.text import small_batches

GOOD, BAD, NONE = 1, 0, -1
LABELLERS = ("length", "word_length", "symbols", "symbol_chars", "symbol_words", "dup_lines", "repeats", "dup_count", "marks", "short_lines")


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE))


def votes(p: Profile) -> np.ndarray:
    """(documents, labellers): the vote of every labeller; ratios of empty texts count as 0."""
    words = np.maximum(p.n_words, 1)
    mean = p.word_chars / words
    symbols, marks = p.n_symbols / words, p.n_marks / words
    dup = p.n_dup_lines / np.maximum(p.n_lines, 1)
    repeats = p.n_repeat_words / words
    per_line = p.n_words / np.maximum(p.n_lines, 1)
    # Clean counts say little, so most labellers only ever vote bad.
    none = np.zeros(p.n, bool)
    return np.stack([
        _vote(p.n_words >= 50, p.n_words < 20),
        _vote((mean >= 3) & (mean <= 8), (mean < 2) | (mean > 12)),
        _vote(none, symbols > 0.1),
        _vote(none, p.n_symbols > 0.05 * p.word_chars),
        _vote(none, p.n_symbol_words > 0.2 * words),
        _vote(none, dup > 0.3),
        _vote(none, repeats > 0.3),
        _vote(none, p.n_dup_lines >= 3),
        _vote((marks > 0.02) & (marks < 0.4), marks > 0.6),
        _vote(per_line >= 8, per_line < 3),
    ], axis=1)


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns with their counts: (prior of good, shares [class, labeller, vote], posteriors of the patterns).

    A share is how often a labeller casts a vote (bad, good or none) on documents of a class, so what a
    labeller's silence says is learned too. It begins with: the more call a document bad, the worse it is.
    """
    cast = np.stack([patterns == v for v in (BAD, GOOD, NONE)], axis=2).astype(float)
    posterior = np.clip(0.95 - 0.4 * cast[:, :, 0].sum(1), 0.02, 0.95)
    shares, prior = np.full((2, patterns.shape[1], 3), 1 / 3), 0.5
    for _ in range(rounds):
        prior = (counts @ posterior + 1) / (counts.sum() + 2)
        said = np.zeros((2, len(counts)))
        for c, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            shares[c] = (np.einsum("p,plv->lv", weight, cast) + 1) / (weight.sum() + 3)
            said[c] = np.log(prior if c else 1 - prior) + np.einsum("plv,lv->p", cast, np.log(shares[c]))
        posterior = 1 / (1 + np.exp(np.clip(said[0] - said[1], -40, 40)))
    return prior, shares, posterior


def _coded(p: Profile) -> np.ndarray:
    return ((votes(p) + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)


def _scored(scorer):
    def columns(p: Profile) -> list[pa.Array]:
        score = pa.nulls(p.n, pa.float64()) if scorer is None else pa.array(scorer.probability(p), pa.float64())
        return [pa.array(p.n_words, pa.int64()), pa.array(_coded(p), pa.int64()), score]

    return columns


def classify_quality(
    docs: DataFrame, sample: int = 2000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_words, votes, posterior, score, kept), a row per row of ``docs``.

    ``votes`` lists +1 (good), 0 (bad), -1 (none) by labeller, ``posterior`` is what they say together, ``score`` the trained scorer's
    calibrated probability of good, and ``kept`` whether score (the posterior, where only one class was seen) reaches
    ``threshold``. A null text is empty; equal rows get equal answers; an empty table gives no rows.
    """
    kind = small_batches(docs).schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text"))
    voted = cut_lineage(rows.select(F.xxhash64(F.lit(11), "__doc", "__text").alias("__doc"), "__text").mapInArrow(
        profiled(lambda p: [pa.array(_coded(p), pa.int64())], ["code"]), "__doc bigint, code bigint"))
    seen = voted.groupBy("code").count().collect()  # 3 ** labellers rows at most
    base = 3 ** np.arange(len(LABELLERS))
    codes = np.array([r[0] for r in seen], np.int64)
    patterns = codes[:, None] // base % 3 - 1 if len(codes) else np.zeros((0, len(LABELLERS)), np.int64)
    posterior = accuracies(patterns, np.array([r[1] for r in seen], float))[2] if len(codes) else np.zeros(0)
    # A map literal of bounded size, from vote pattern to posterior.
    table = F.create_map(*[F.lit(x) for c, p in zip(codes.tolist(), posterior.tolist(), strict=True) for x in (c, p)]) if len(codes) else None

    def said(code):
        return F.element_at(table, code) if table is not None else F.lit(None).cast("double")

    picked = None
    for clear in (said(F.col("code")) >= 0.9, said(F.col("code")) <= 0.1):
        half = voted.where(clear).groupBy("__doc").agg(F.max(said(F.col("code"))).alias("target")).orderBy("__doc").limit(sample // 2)
        picked = half if picked is None else picked.unionByName(half)
    picked = F.broadcast(picked.withColumnRenamed("__doc", "place"))  # at most ``sample`` rows of two numbers
    chosen = rows.withColumn("place", F.xxhash64(F.lit(11), "__doc", "__text"))
    scorer = fit_scorer(chosen.join(picked, "place").select("target", "place", F.col("__text").alias("text")), sample)
    scored = rows.mapInArrow(
        profiled(_scored(scorer), ["n_words", "code", "score"]), f"__doc {kind}, n_words bigint, code bigint, score double")
    listed = F.array(*[(F.floor(F.col("code") / int(b)) % 3 - 1).cast("int") for b in base])
    return scored.select(
        F.col("__doc").alias(id_col), "n_words", listed.alias("votes"), said(F.col("code")).alias("posterior"), "score",
        (F.coalesce(F.col("score"), said(F.col("code")), F.lit(0.0)) >= threshold).alias("kept"))
