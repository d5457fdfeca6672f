from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmura.llm import jaccard, language, mixture, packing, pii, quality_rules, suffix_dedup, topk, warc, weak_labels
from murmura.llm.features import Profile
from murmura.llm.text import slices

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, rank bigint, size string, place int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """(doc_id, text, lang, source) with columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, 0, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(3)


def some_docs(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(80)]
                  for lang, letters in (("aa", "abcdeimo"), ("bb", "bkzruyt"))}
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        words = [rng.choice(vocabulary[lang]) for _ in range(rng.choice([0, 1, 3, 40, 120, 200]))]
        rows.append((i, " ".join(words), lang, rng.choice(["s1", "s2", "s2", None, "é"])))
    for i in range(n, n + 15):
        old = rng.choice(rows[:n])
        words = (old[1] or "").split()
        for _ in range(rng.choice([0, 1, 2])):
            if words:
                words[rng.randrange(len(words))] = "new"
        rows.append((i, " ".join(words), old[2], old[3]))
    rows += [(n + 20, None, None, None), (None, rows[3][1], "aa", "s1"), rows[5], rows[5], (n + 21, "x" * 30_000, "aa", "s1"),
             (n + 22, "Ünï 9 çode\n\t\x0b" * 40, "bb", "s3"), (n + 23, " \n", "aa", "s1")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeated_passages(docs, rows):
    width = 40
    data = [(t or "").encode() for _, t, *_ in rows]
    count = Counter(d[p:p + width] for d in data for p in range(len(d) - width + 1))
    expected = Counter()
    for (i, *_), d in zip(rows, data):
        covered = np.zeros(len(d), bool)
        for p in range(len(d) - width + 1):
            if count[d[p:p + width]] > 1:
                covered[p:p + width] = True
        kept = np.frombuffer(d, np.uint8)[~covered].tobytes()
        starts = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        expected[(i, len(d), int(covered.sum()), starts, hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.repeated_passages(docs, width).drop("spans").collect()
    assert Counter(tuple(r) for r in got) == expected


def linked_components(rows, size, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(fold))
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        least[find(k)].append(i)
    names = {k: min([i for i in v if i is not None], default=None) for k, v in least.items()}
    return Counter((i, len(sets[k]), names[find(k)] if sets[k] else i) for k, (i, *_) in enumerate(rows))


@pytest.mark.parametrize(("size", "percent", "leaves"), [(4, 85, 256), (3, 50, 4)])
def test_jaccard_groups(docs, rows, monkeypatch, size, percent, leaves):
    monkeypatch.setattr(jaccard, "LEAVES", leaves)
    monkeypatch.setattr(jaccard, "SAMPLED", 2)
    got = jaccard.jaccard_groups(docs, size, percent).collect()
    assert Counter(tuple(r) for r in got) == linked_components(rows, size, percent)


def test_jaccard_of_a_family_round_the_threshold(spark, monkeypatch):
    """Many variants of one text, some linked and some not, share most of their buckets."""
    monkeypatch.setattr(jaccard, "LEAVES", 16)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in rng.choice(len(words), rng.integers(0, 9), replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in jaccard.jaccard_groups(docs, 4, 85).collect())
    assert got == linked_components(rows, 4, 85)
    assert len({c for *_, c in got}) > 10


def test_sample_takes_sets_of_every_size():
    for size in (5, 20, 147, 1000):
        hashes = np.random.default_rng(size).integers(0, 1 << 63, 2000 * size).astype(np.uint64)
        _, ids = jaccard._identity(np.repeat(np.arange(2000), size), hashes, 2000)
        assert 30 < jaccard._sampled(ids).sum() < 100


def test_keep_one_leaves_one_of_each_group(docs, rows):
    kept = [r.doc_id for r in jaccard.keep_one(docs).collect()]
    groups = linked_components(rows, 5, 80)
    assert set(kept) >= {i for i, n, c in groups if i == c}
    assert not {i for i, n, c in groups if i != c and i is not None} & set(kept)


def test_keep_one_decides_by_row(spark):
    words = [f"word{k}" for k in range(60)]
    near, alone, nameless = " ".join(words[:30]), " ".join(words[30:45]), " ".join(words[45:])
    rows = [(1, near, None, None)] * 3 + [(2, near + " more", None, None)] * 2 + [(2, alone, None, None)] * 4
    rows += [(None, nameless, None, None)] * 3 + [(None, nameless + " more", None, None), (None, near, None, None)]
    rows += [(5, " ", None, None)] * 2 + [(None, None, None, None)] * 2
    got = Counter((r.doc_id, r.text) for r in jaccard.keep_one(frame(spark, rows)).collect())
    spare = [k for k in got if k[0] is None and k[1] in (nameless, nameless + " more")]
    assert len(spare) == 1 and got.pop(spare[0]) == 1
    assert got == {(1, near): 1, (2, alone): 1, (5, " "): 2, (None, None): 2}


def test_mix_sources(docs, rows):
    got = mixture.mix_sources(docs).collect()
    again = mixture.mix_sources(docs).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(s for s in sizes if s is not None) + [None]
    target = dict.fromkeys(names, 0.0)
    rest, open_ = sum(sizes.values()), set(names)
    while open_:
        weight = {s: names.index(s) % 3 + 1 for s in open_}
        share = rest / sum(weight.values())
        over = {s for s in open_ if 3 * sizes[s] < share * weight[s]}
        if not over:
            target.update({s: share * weight[s] for s in open_})
            break
        target.update({s: 3 * sizes[s] for s in over})
        rest -= sum(3 * sizes[s] for s in over)
        open_ -= over
    by_source = defaultdict(Counter)
    source_of = {i: s for i, _, _, s in rows}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[source_of[r.doc_id]])
        by_source[source_of[r.doc_id]]["taken"] += r.taken
    for s in names:
        assert abs(by_source[s]["taken"] - target[s]) <= 12


def test_shares_are_sainte_lague(spark):
    votes = {k: v for k, v in enumerate([53_000.0, 24_000.0, 23_000.0, 10.0, 0.0])}
    frame_ = spark.createDataFrame([(k, v) for k, v in votes.items()], "rank bigint, target double")
    for seats in (0, 1, 7, 50):
        given = Counter()
        for _ in range(seats):
            given[max(votes, key=lambda k: (votes[k] / (2 * given[k] + 1), -k))] += 1
        got = {r.rank: r.quota for r in mixture.highest_quotients(frame_, seats).collect()}
        assert got == {k: given[k] for k in votes}


def test_mixed_documents_keep_columns(docs):
    out = mixture.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 6


TEXTS = [
    "mail me: a.b@c.d_e@f.gh! or x@y, ip 1.2.3.4.5 and 300.1.1.1 card 4111 1111 1111 1111 no 4111 1111 1111 1112",
    "call +1 (234) 555-6789 or +12 now; é+44 20 7946 0958é 1.1.1.1", "", "a" * 5000 + "1" * 5000, "+" * 300 + "1-2" * 50,
]


def spans_of(text):
    def luhn(x):
        total = 0
        for k, c in enumerate(reversed(x)):
            v = int(c) * (1 + k % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    def digits(x):
        return re.sub("[^0-9]", "", x)

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


def test_fixed_shapes(spark):
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], None, None), (0, TEXTS[0], None, None), (99, None, None, None)]
    for r in pii.personal_data(frame(spark, rows)).collect():
        text = TEXTS[0] if r.doc_id is None else "" if r.doc_id == 99 else TEXTS[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(spans_of(text).encode()).hexdigest()
        assert r.spans == spans_of(text)


def test_contexts_discover_identifiers(spark):
    rng = random.Random(5)
    rows = [(i, f'id {i}: token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end', None, None) for i in range(8)]
    rows += [(8, 'here token = "Zq81xkP0" and lot Zq99999', None, None), (9, "lot A1234567 is plain", None, None)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got[8].spans == "id:14:22" and got[9].spans == ""
    masked = {r.doc_id: r.text for r in pii.masked(frame(spark, rows)).collect()}
    assert masked[8] == 'here token = "<ID>" and lot Zq99999' and masked[9] == "lot A1234567 is plain"


def test_contexts_of_every_seed_shape(spark):
    """Seeds that hold no token, contexts with grouped digits only, and a chain of patterns longer than two rounds."""
    seeds = {"mail": "{}@example.com", "host": "10.20.30.{}", "dial": "+44 20 79{} 0958"}
    names = ["jane.doe", "ann", "bo.lee", "carl", "dee"]
    rows = []
    for k in range(5):
        for word, shape in seeds.items():
            rows.append((len(rows), f"write the {word}: {shape.format(names[k] if word == 'mail' else 10 + k)} please", None, None))
    rows += [(100, "write the mail: ab12cd34 please", None, None), (101, "write the host: 123-45-6789 please", None, None),
             (102, "write the dial: 020 7946 0958 please", None, None), (103, "on page: 123-45-6789x or 12 34 please", None, None)]
    # Link j is trusted once the value that it shares with link j - 1 is known.
    for j in range(4):
        said = [f"10.9.{j}.{k}" for k in range(4)] + ["10.9.9.9" if j == 0 else f"w{j - 1}00000", f"w{j}00000"]
        rows += [(200 + 10 * j + k, f"see chain{'abcd'[j]} ref: {v} end", None, None) for k, v in enumerate(said)]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got[100] == "id:16:24" and got[101] == "id:16:27" and got[102] == "id:16:29" and got[103] == ""
    assert [got[205 + 10 * j] for j in range(4)] == ["id:16:23"] * 4


def test_packing_matches_the_tokenizer(docs, rows):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    capacity = 64
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), capacity).collect()
    expected = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for held in filled.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything_tightly(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 3000).astype(int), 1, 2048)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    runs = packing.plan(histogram)
    load, count = Counter(), Counter()
    for length, _, n, first, per, offset in runs.tolist():
        count[length] += n
        for r in range(n):
            load[first + r // per] += length
    assert count == Counter(histogram) and max(load.values()) <= 2048
    assert len(load) <= -(-lengths.sum() // 2048) * 1.03 + 2


def test_language(spark):
    rows = some_docs(7, 300)
    got = language.identify_language(frame(spark, rows)).collect()
    lang = {i: (t, want) for i, t, want, _ in rows}
    right = total = 0
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        text, want = lang[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und"
        elif r.held_out and len(text) > 100 and r.doc_id is not None and r.doc_id < 300:
            total += 1
            right += r.lang_pred == want
    assert total > 10 and right >= 0.95 * total


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    rows = []
    for k in range(70):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)]
        rows += [(10 * k + m, " ".join(rng.choice(words) for _ in range(60)), f"l{k:02}", None) for m in range(3 if k < 65 else 2)]
    got = {tuple(r) for r in language.identify_language(frame(spark, rows), held_out=1000).collect()}
    want = {i: lang for i, _, lang, _ in rows}
    assert all(r[2] == want[r[0]] for r in got if not r[1]) and len(got) == len(rows)
    assert got == {tuple(r) for r in language.identify_language(frame(spark, rows), held_out=1000, at_once=7).collect()}


def test_phrases_are_the_greedy_longest_matches():
    samples = [b"abracadabra banana", b"mississippi river"]
    table = language.parser_table(samples)
    texts = [b"abra banan", b"rivers miss", b"zzz", b""]
    offs = np.cumsum([0, *map(len, texts)])
    got = language.phrases(np.frombuffer(b"".join(texts), np.uint8), offs, *table)

    def parse(text, sample):
        n, at = 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at:end + 1] in sample:
                end += 1
            n, at = n + 1, end
        return n

    for k, text in enumerate(texts[:3]):
        assert got[k].tolist() == [parse(text, s) for s in samples]
    assert got[3].tolist() == [0, 0]


def counts_of(text):
    w = WORD.findall(text or "")
    three = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if three[tuple(w[k:k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_rules(spark, docs, rows, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_rules.quality_rules(docs, labels).collect()
    expected = Counter((i, *counts_of(t)) for i, t, *_ in rows)
    assert Counter(tuple(r)[:6] for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    plain = quality_rules.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.quality_score is None for r in plain)


def test_lines_of_one_word_after_a_text_without_a_line_end():
    profile = Profile(next(slices(pa.array(["foo bar", "A\nA\nA", "A\nA", "\n \nb"]))))
    assert profile.n_lines.tolist() == [1, 3, 2, 1] and profile.n_dup_lines.tolist() == [0, 2, 1, 0]


def test_quality_is_learned_on_held_out_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        words = [rng.choice("alpha beta gamma delta omega kappa".split()) for _ in range(80)]
        rows.append((i, " ".join(w + ("$$" if i % 2 else "") for w in words), "aa", "s"))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(120)], "doc_id bigint, quality int, toxic int")
    got = quality_rules.quality_rules(frame(spark, rows), labels, max_repeat_percent=100).where("doc_id >= 120").collect()
    assert all(r.kept == (r.doc_id % 2 == 0) for r in got)


def test_weak_labels(spark, docs, empty):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)]
        rows.append((i, ". ".join(w + ("$$%" if i % 4 == 0 else "") for w in words), "aa", "s"))
    got = weak_labels.classify_quality(frame(spark, rows)).collect()
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in got) >= 190
    assert weak_labels.classify_quality(docs).count() == docs.count()
    assert weak_labels.classify_quality(empty).count() == 0


@pytest.mark.parametrize("cosine", [0.4, -1.0, 2.0])
def test_top_products(spark, monkeypatch, cosine):
    monkeypatch.setattr(topk, "COSINE", cosine)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(90, 6)) * rng.lognormal(0, 1, 90)[:, None]
    vectors[20:45] = vectors[20]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(200, None, 1), (210, [1.0] * 5 + [None], 1), (220, [float("nan")] * 6, 1), (230, [0.0] * 6, 1), (None, [9.0] * 6, 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = topk.top_products(table, F.col("vec_id") % 10 == 0, 10, bucket=8).collect()
    whole = {i: np.floor(1024 * np.float32(v).astype(float)).astype(np.int64) for i, v, _ in rows[:90]} | {230: np.zeros(6, np.int64)}
    expected = set()
    for q in whole:
        if q % 10 == 0:
            best = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:10]
            expected |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {tuple(r) for r in got} == expected
    assert topk.top_products(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>", 0), (2, "http://b/", "<p>é</p>", 0), (3, None, None, 0), (4, "http://c/\r\nx: y", "", 0),
            (5, "http://d/", "z" * 200_000, 0), (None, "http://e/", "<p>é</p>", 0), (5, "http://d/", "z" * 200_000, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, file int").repartition(3)
    got = warc.archive_round_trip(pages).collect()
    last = {}
    for i, _, html, _ in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    expected = Counter()
    for i, _, html, _ in rows:
        payload, to = (html or "").encode(), last[html or ""]
        expected[(i, len(payload), warc.digest_of(payload), "response" if i == to else "revisit", None if i == to else to)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    assert warc.coalesced(np.array([0, 10, 200_000]), np.array([10, 5, 7])) == [(0, 2), (2, 3)]


def test_empty_tables(spark, empty):
    P = pytest.importorskip("public_tokenizers")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert suffix_dedup.repeated_passages(empty).count() == 0
    assert jaccard.jaccard_groups(empty).count() == 0
    assert mixture.mix_sources(empty).count() == 0
    assert pii.personal_data(empty).count() == 0
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert language.identify_language(empty).count() == 0
    assert quality_rules.quality_rules(empty, labels).count() == 0


def test_pipeline_stages(spark, docs, empty, tmp_path):
    import corpus_pipeline

    for name, start in (("full", docs), ("none", empty)):
        held = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, held, "")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}{k}")
            held = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert (held.count() > 0) == (name == "full")
