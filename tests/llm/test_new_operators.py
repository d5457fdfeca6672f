"""Filter audit, ranked search and line dedup against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmura.llm import filter_audit, lexical, line_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, row bigint, block string, part int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(3)


def some_docs(seed=2, n=70):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéñxyz") for _ in range(rng.randint(1, 8))) for _ in range(150)] + ["The", "THE", "a#b", "x$", "A1", "1"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(25)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            text = "\n".join(rng.choice([x, f" \t{x}\r", x.upper(), "", "short"]) for x in rng.choices(lines, k=rng.randint(1, 12)))
        else:
            text = " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.choice([0, 1, 30, 210, 400])))
        rows.append((i, text, "aa", rng.choice(["s1", "s2", None, "", "é"])))
    copies = [(n + k, rows[k % 5][1], "aa", "s1") for k in range(20)]
    # Null texts and ids, repeated rows and ids, copies, texts of white space, long ones, one above the size of a slice.
    return rows + copies + [
        (n + 30, None, None, None), (None, rows[3][1], "aa", "s1"), (None, "only a null id holds this line\nx", "aa", "s1"), rows[5], rows[5], (7, "other text of one id", "bb", "s2"),
        (n + 31, " \n\n", "aa", "s1"), (n + 32, "é" * 30_000, "aa", "s1"), (n + 33, "\n", "aa", "s2"),
        (n + 34, " ".join(rng.choices(words, k=400_000)), "aa", "s2"), (n + 35, "x" + "\n".join(lines) * 3, "aa", "s1"),
    ]


@pytest.fixture(scope="module")
def rows():
    return some_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_failures(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, _, source in rows:
        t = t or ""
        w = WORD.findall(t)
        yield i, source or "", "".join(k for k, fails in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i)) if fails)


def test_failures_and_matrix(docs, rows, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 3000)
    got = filter_audit.failures(docs).collect()
    expected = Counter((i, part, sum(1 << "ABCDE".index(k) for k in f)) for i, part, f in plain_failures(rows))
    assert Counter(tuple(r) for r in got) == expected

    shards, dictionary = filter_audit.term_matrix(docs)
    words = {r["column"]: bytes(r["word"]).decode() for r in dictionary.collect()}
    assert sorted(words) == list(range(len(words)))
    counted = Counter()
    for s in shards.collect():
        for k, name in enumerate(s["ids"]):
            a, b = s["row_ends"][k: k + 2]
            columns, counts = (filter_audit.opened(pa.scalar(bytes(s[c])))[a:b].tolist() for c in ("columns", "counts"))
            counted[(name, frozenset(zip([words[c] for c in columns], counts, strict=True)))] += 1
    assert counted == Counter((i, frozenset(Counter(WORD.findall(t or "")).items())) for i, t, *_ in rows)


def test_audit_filters(spark, docs, rows):
    marks = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (72, 1, 1), (73, None, 1), (None, 1, 1), (500, 1, 1), (5, 1, 0)]
    labels = spark.createDataFrame([(*m, "clash") for m in marks], "doc_id bigint, quality int, toxic int, part string")
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    failed = list(plain_failures(rows))
    expected = {}
    for part in {p for _, p, _ in failed}:
        mine = [(i, f) for i, p, f in failed if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, k in enumerate(order):
                before = set(order[:step])
                here = [i for i, f in mine if k in f and not before & set(f)]
                shapley[k] += len(here)
                expected[(part, "".join(order), step + 1)] = [
                    sum(not (before | {k}) & set(f) for _, f in mine), len(here),
                    sum(k in f and bool(before & set(f)) for _, f in mine), sum(f == k for _, f in mine),
                    sum(i in good for i in here), sum(i in toxic for i in here)]
        for (p, order, step), values in expected.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    got = {tuple(r)[:3]: list(r)[3:] for r in filter_audit.audit_filters(docs, labels).collect()}
    assert got == expected


def plain_search(rows, items, k):
    docs = [(i, TERM.findall((t or "").translate(FOLD))) for i, t, *_ in rows]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    n_docs, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(TERM.findall((text or "").translate(FOLD)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in docs:
            m = 50 + 50 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in terms if t in c)
            if score > 0:
                scored.append((score, i))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(item, r, i, s) for r, (s, i) in enumerate(scored[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("first", "step", "bits", "k"), [(512, 4, 1 << 20, 5), (1, 2, 1 << 20, 3), (2, 3, 64, 50)])
def test_search(spark, docs, rows, monkeypatch, first, step, bits, k):
    monkeypatch.setattr(lexical, "FIRST", first)
    monkeypatch.setattr(lexical, "STEP", step)
    monkeypatch.setattr(lexical, "FILTER_BITS", bits)
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(WORD.findall(rows[j][1]) or [""], k=8))) for i, j in enumerate(range(0, 60, 4))]
    items += [(3, "The the one-two THE"), (None, rows[3][1]), (90, None), (91, ""), (92, "nowhere"), (93, rows[4][1]), (93, rows[4][1])]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, score int, rank int")
    assert Counter(tuple(r) for r in lexical.search(docs, table, k).collect()) == plain_search(rows, items, k)


def test_search_stops_adding_accumulators(spark, monkeypatch):
    """A rare term that k documents hold settles an item of common ones; copies of the text are ranked by id."""
    monkeypatch.setattr(lexical, "FIRST", 4)
    rows = [(i, "common words everywhere " * (1 + i % 3) + ("rare" if i % 50 == 0 else ""), None, None) for i in range(200)]
    read = []
    best = lexical._best
    monkeypatch.setattr(lexical, "_best", lambda scores, k: read.append(scores.count()) or best(scores, k))
    items = [(1, "rare common words everywhere")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter(tuple(r) for r in lexical.search(frame(spark, rows), table, 3).collect())
    assert got == plain_search(rows, items, 3)
    assert read[0] == 4 and max(read) == 4


def plain_lines(rows, least=20, min_docs=3):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(FOLD) for x in (t or "").split("\n")] for _, t, *_ in rows]
    count, last = Counter(), {}
    for (i, *_), mine in zip(rows, keys):
        for key in set(mine):
            count[key] += 1
            if i is not None:
                last[key] = max(i, last.get(key, i))
    out = Counter()
    for (i, t, *_), mine in zip(rows, keys):
        stay = [len(key) < least or count[key] < min_docs or key not in last or last[key] == i for key in mine]
        kept = [x for x, s in zip((t or "").split("\n"), stay) if s]
        out[(i, len(mine), len(mine) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize(("block", "keys", "probes"), [(1 << 22, 1 << 16, 1 << 20), (400, 5, 3)])
def test_dedup_lines(docs, rows, monkeypatch, block, keys, probes):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", keys)
    monkeypatch.setattr(line_dedup, "PROBES", probes)
    got = Counter(tuple(r) for r in line_dedup.dedup_lines(docs).collect())
    assert got == plain_lines(rows)
    assert sum(dropped for _, _, dropped, _ in got) > 20


def test_dedup_lines_with_text_ids(spark):
    rows = [(name, f"a line that many documents hold\nown {name}", None, None) for name in ("b", "a", "é", "c", None)]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    assert Counter(tuple(r) for r in line_dedup.dedup_lines(table).collect()) == plain_lines(rows)


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 70_000):
        h, f = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        h[: n // 2] = h[0] if n else 0
        perfect = line_dedup.PerfectHash(*(lambda p: (p.sizes, p.bits()))(line_dedup.PerfectHash.build(h, f)))
        assert sorted(perfect.find(h, f)) == list(range(n))
        assert sum(perfect.sizes) < 6 * n + 64


def test_empty_tables(spark, empty, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert not filter_audit.audit_filters(empty, labels).collect()
    assert filter_audit.audit_filters(docs, labels).agg(F.sum("good_lost")).first()[0] == 0
    assert not lexical.search(empty, spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).collect()
    assert not lexical.search(docs, items).collect()
    assert not line_dedup.dedup_lines(empty).collect()
