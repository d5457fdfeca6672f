"""Counts, ratios and hashed n-grams of whole texts, for a batch at a time, and a linear model over them."""

from __future__ import annotations

import numpy as np

from murmura.llm.text import LOWER, Rolling, Slice, mix, shingles

DIM = 1 << 14
_HALF = DIM // 2
_GRAM = 4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".!?,;:"]] = True


def _repeats(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each (document, hash) occurs more than once, and whether earlier: two flags per entry."""
    joint = mix(hashes ^ mix(docs.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(joint, kind="stable")
    held = joint[order]
    same = np.zeros(len(held), bool)
    same[1:] = held[1:] == held[:-1]
    later = np.zeros(len(held), bool)
    later[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    both = np.zeros(len(held), bool)
    both[order] = twice
    return np.stack([both, later])


class Profile:
    """Per document of a slice: words, characters in words, symbols, repeated lines and words, and more."""

    def __init__(self, part: Slice):
        n, data = part.n, part.data
        rolling = Rolling(data)
        starts, ends, docs = part.words()
        self.hashes, self.docs = rolling.ranges(starts, ends), docs
        self.n_words = np.bincount(docs, minlength=n)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        in_word = np.cumsum(inside)[: len(data)] > 0
        self.word_chars = part.sums(in_word & ((data & 0xC0) != 0x80))
        self.n_symbols = part.sums(_SYMBOL[data])
        before = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        self.n_symbol_words = np.bincount(docs[before[ends] > before[starts]], minlength=n)
        self.n_marks = part.sums(_MARK[data])
        cut = np.zeros(len(data) + 1, bool)
        cut[part.offs] = True
        breaks = np.flatnonzero(data == 10)
        begin = np.unique(np.concatenate([part.offs[:-1], breaks + 1]))
        begin = begin[begin < len(data)]
        stop = np.concatenate([begin[1:], [len(data)]])
        stop = np.where((stop > begin) & (data[stop - 1] == 10), stop - 1, stop) if len(begin) else stop
        # Starts of their own: in ``inside`` the first word of a text and the last of the text before may cancel out.
        begun = np.zeros(len(data), np.int64)
        begun[starts] = 1
        words_before = np.concatenate([[0], np.cumsum(begun)])
        lined = words_before[stop] > words_before[begin]
        begin, stop = begin[lined], stop[lined]
        line_docs = part.doc_of(begin)
        self.n_lines = np.bincount(line_docs, minlength=n)
        later = _repeats(rolling.ranges(begin, stop), line_docs)[1] if len(begin) else np.zeros(0, bool)
        self.n_dup_lines = np.bincount(line_docs[later], minlength=n)
        self.n_repeat_words = np.zeros(n, np.int64)
        if len(docs) >= 3:
            at = np.flatnonzero(docs[2:] == docs[:-2])
            h = self.hashes
            three = mix(mix(mix(h[at]) + h[at + 1]) + h[at + 2])
            twice = at[_repeats(three, docs[at])[0]]
            covered = np.zeros(len(docs), bool)
            for k in range(3):
                covered[twice + k] = True
            self.n_repeat_words = np.bincount(docs[covered], minlength=n)
        # Hashed n-grams: words and word pairs below, byte 4-grams above; each half sums to 1 per document.
        lower = LOWER[data]
        self.low = Rolling(lower)
        self.word_slots = self.low.ranges(starts, ends)
        self.part, self.n = part, n

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, slot, share of the document's n-grams of that kind) for every n-gram."""
        pairs, pair_docs = shingles(self.word_slots, self.docs, self.n, 2)
        words = np.concatenate([self.word_slots, pairs])
        word_docs = np.concatenate([self.docs, pair_docs])
        grams = self.low.windows(_GRAM)
        gram_docs = self.part.doc_of(np.arange(len(grams)))
        whole = np.arange(len(grams)) + _GRAM <= self.part.offs[gram_docs + 1] if len(grams) else np.zeros(0, bool)
        grams, gram_docs = grams[whole], gram_docs[whole]
        docs = np.concatenate([word_docs, gram_docs])
        slot = np.concatenate([words % np.uint64(_HALF), grams % np.uint64(_HALF) + np.uint64(_HALF)]).astype(np.int64)
        of_words = np.bincount(word_docs, minlength=self.n)
        of_grams = np.bincount(gram_docs, minlength=self.n)
        share = np.concatenate([1 / of_words[word_docs], 1 / of_grams[gram_docs]])
        return docs, slot, share

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        docs, slot, share = self.slots()
        return bias + np.bincount(docs, weights[slot] * share, minlength=self.n)

    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per document its slots in order and their sums."""
        docs, slot, share = self.slots()
        joint, back = np.unique(docs * DIM + slot, return_inverse=True)
        sums = np.bincount(back, share)
        bounds = np.searchsorted(joint // DIM, np.arange(self.n + 1))
        return [(joint[a:b] % DIM, sums[a:b]) for a, b in zip(bounds, bounds[1:])]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(slots: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, steps: int = 120, decay: float = 1e-5):
    """Logistic regression by Adam on all rows at once; the classes weigh the same. Returns (weights, bias)."""
    sizes = np.array([len(s) for s in slots])
    row = np.repeat(np.arange(len(slots)), sizes)
    slot, value = np.concatenate(slots), np.concatenate(values)
    share = np.clip(target.mean(), 1e-9, 1 - 1e-9)
    importance = target / share + (1 - target) / (1 - share)
    importance = importance / importance.sum()
    w, bias = np.zeros(DIM), 0.0
    m, v, mb, vb = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    for t in range(1, steps + 1):
        error = (sigmoid(bias + np.bincount(row, w[slot] * value, minlength=len(slots))) - target) * importance
        g = np.bincount(slot, error[row] * value, minlength=DIM) + decay * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 1.0 / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= 0.1 * rate * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, bias


def calibrate(logits: np.ndarray, target: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt scaling on rows not fitted: p = sigmoid(a * logit + b), targets drawn in by the class counts."""
    ones = target.sum()
    soft = np.where(target > 0, (ones + 1) / (ones + 2), 1 / (len(target) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * logits + b)
        q = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - soft) * logits).sum(), (p - soft).sum()])
        h = np.array([[(q * logits * logits).sum() + 1e-6, (q * logits).sum()], [(q * logits).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return a, b
