"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text is built. A text is parsed greedily into the
longest phrases that occur in that text; the language whose automaton needs the fewest phrases
per byte wins. The parse follows the automaton's transitions only and starts anew at the root where one is
missing, so a whole batch is parsed in lock step: one gather per byte position for all segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmura.functions.durable import cut_lineage
from murmura.llm.text import LOWER, slices, small_batches

UNKNOWN = "und"
SEGMENT = 256
_LANES = 8192


#: ASCII letters and every byte of other scripts; all else only separates, however much of it there is.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.where(_LETTER, LOWER, 32).astype(np.uint8)


def folded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one blank for each run of other bytes after a letter of the same text."""
    letter = _LETTER[data]
    after = np.concatenate([[False], letter])
    after[offs] = False
    keep = letter | after[:-1]
    total = np.concatenate([[0], np.cumsum(keep)])
    return _FOLD[data[keep]], total[offs]


class SuffixAutomaton:
    """Transitions over byte classes: state 0 is the root; -1 where a string does not occur."""

    def __init__(self, data: np.ndarray, classes: int):
        links, lengths, edges = [-1], [0], [{}]
        last = 0
        for c in data.tolist():
            new = len(edges)
            edges.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            p = last
            while p != -1 and c not in edges[p]:
                edges[p][c] = new
                p = links[p]
            if p != -1:
                q = edges[p][c]
                if lengths[q] == lengths[p] + 1:
                    links[new] = q
                else:
                    copy = len(edges)
                    edges.append(dict(edges[q]))
                    lengths.append(lengths[p] + 1)
                    links.append(links[q])
                    while p != -1 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = links[p]
                    links[q] = links[new] = copy
            last = new
        self.next = np.full((len(edges), classes), -1, np.int32)
        for state, out in enumerate(edges):
            for c, to in out.items():
                self.next[state, c] = to


def parser_table(samples: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, roots, byte classes) for all languages at once.

    ``table[state * classes + class]`` is the following state times 4, plus the phrases ended: one where the byte
    does not continue the phrase, and one more for a byte that occurs nowhere, which is its own phrase. Class 0 is the padding, which changes nothing; class 1 holds bytes that no sample has.
    """
    samples = [folded(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in samples]
    bytes_seen = sorted(set(np.concatenate(samples).tolist()))
    of = np.ones(256, np.uint8)
    for k, b in enumerate(bytes_seen):
        of[b] = k + 2
    classes = int(of.max()) + 1
    blocks, roots, base = [], [], 0
    for sample in samples:
        nxt = SuffixAutomaton(of[sample], classes).next
        missing = nxt < 0
        after = np.where(nxt[0] < 0, 0, nxt[0])
        ended = missing.astype(np.int32) + (missing & (nxt[0] < 0)[None, :])
        ended[0] = missing[0]
        filled = (np.where(missing, after[None, :], nxt) + base) * 4 + ended
        filled[:, 0] = (np.arange(len(nxt)) + base) * 4
        blocks.append(filled.astype(np.int32))
        roots.append(base)
        base += len(nxt)
    return np.concatenate(blocks).ravel(), np.array(roots, np.int32), of


def phrases(data: np.ndarray, offs: np.ndarray, table: np.ndarray, roots: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Phrases of every document (rows) in every language (columns), counted per segment of SEGMENT bytes."""
    classes = int(of.max()) + 1
    data, offs = folded(data, offs)
    lengths = np.diff(offs)
    parts = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), parts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offs[:-1][owner] + within * SEGMENT
    size = np.minimum(SEGMENT, offs[1:][owner] - begin)
    # Long segments first, so that those still running are always a prefix.
    order = np.argsort(-size, kind="stable")
    coded = np.concatenate([of[data], np.zeros(SEGMENT, np.uint8)])
    counts = np.zeros((len(lengths), len(roots)), np.int64)
    for a in range(0, len(order), _LANES):
        lanes = order[a: a + _LANES]
        block = coded[begin[lanes][None, :] + np.arange(SEGMENT)[:, None]]
        running = np.searchsorted(-size[lanes], -np.arange(SEGMENT), "left")
        for k, root in enumerate(roots):
            state = np.full(len(lanes), root, np.int32)
            ends = np.zeros(len(lanes), np.int32)
            for t in range(int(size[lanes[0]])):
                n = running[t]
                got = table[state[:n] * classes + block[t, :n]]
                ends[:n] += got & 3
                state[:n] = got >> 2
            np.add.at(counts[:, k], owner[lanes], ends + (state != root))
    return counts


def training_text(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, held_out: int, window: int = 512
) -> dict[str, bytes]:
    """``per_language`` bytes of labelled text a language, less where there is less, from documents in hashed order.

    Every language with text is kept. Each document gives at most ``window`` characters, from a hashed place, so that many authors are
    heard. What is sent to the driver is about twice what is used: hashes are dealt to levels, each as likely as all higher ones
    together, and the highest levels that fill a language's bytes are taken.
    """
    crc = F.crc32(F.col(id_col).cast("string"))
    pick = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.coalesce(crc, F.lit(0)) % held_out != 0))
    text = F.col(text_col).cast("string")
    begin = F.pmod(F.xxhash64(F.lit(5), F.col(id_col), text), F.greatest(F.lit(1), F.length(text) - window + 1)).cast("int")
    heard = pick.where(F.length(F.trim(text)) > 0).select(
        F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.lit(3), F.col(id_col), text).alias("o"),
        F.substring(text, begin + 1, F.lit(window)).alias("t"))
    heard = heard.withColumn("level", F.length(F.regexp_extract(F.lpad(F.bin("o"), 64, "0"), "^0*", 0)))
    above = Window.partitionBy("l").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    # At most 65 rows a language.
    once = heard.groupBy("l", "level", "o").agg(F.max(F.octet_length("t") + 1).alias("size"))
    levels = once.groupBy("l", "level").agg(F.sum("size").alias("size")).withColumn(
        "before", F.coalesce(F.sum("size").over(above), F.lit(0))).where(F.col("before") < per_language)
    rows = heard.join(cut_lineage(levels.select("l", "level")), ["l", "level"]).select("l", "o", "t").distinct().orderBy("l", "o", "t").collect()
    texts: dict[str, bytes] = {}
    for lang, _, said in rows:
        held = texts.get(lang, b"")
        if len(held) < per_language:
            texts[lang] = (held + b"\n" + said.encode())[:per_language]
    return dict(sorted(texts.items()))


_tables: dict = {}


def _has_letter(column: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(column.fill_null(""), r"\pL").to_numpy(zero_copy_only=False)


def _table(samples: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parser table of a block of languages; a worker holds one."""
    if samples not in _tables:
        _tables.clear()
        _tables[samples] = parser_table(list(samples))
    return _tables[samples]


def predicted(samples: dict[str, bytes], at_once: int):
    """A map over Arrow batches (__doc, text): (__doc, lang_pred, score, phrases per byte of the winner).

    Languages are tried in blocks of ``at_once`` automata, one block at a time for a batch; the two least counts go on.
    """
    names, held = list(samples), list(samples.values())
    blocks = [(k, tuple(held[k: k + at_once])) for k in range(0, len(held), at_once)]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            letters = _has_letter(column)
            n = len(column)
            best, rate = np.full(n, -1), np.zeros(n)
            low, rest = np.full(n, np.inf), np.full(n, np.inf)
            for first, block in blocks:
                for part in slices(column):
                    counts = phrases(part.data, part.offs, *_table(block)).astype(float)
                    to = slice(part.first, part.first + part.n)
                    least = counts.min(axis=1)
                    # Blocks go by name, so a tie stays with the earlier one.
                    best[to] = np.where(least < low[to], first + counts.argmin(axis=1), best[to])
                    two = np.sort(np.column_stack([low[to], rest[to], counts]), axis=1)[:, :2]
                    low[to], rest[to] = two[:, 0], two[:, 1]
                    rate[to] = low[to] / np.maximum(np.diff(part.offs), 1)
            if len(names) == 1:
                rest = low * 2
            score = 1 - low / np.maximum(rest, 1) if names else np.zeros(n)
            known = letters & (best >= 0)
            label = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(label, pa.string()), pa.array(np.where(known, score, 0.0)),
                pa.array(np.where(known, rate, 0.0)),
            ], ["__doc", "lang_pred", "score", "rate"])

    return predict


def identify_language(
    docs: DataFrame, per_language: int = 12_288, held_out: int = 5, at_once: int = 64,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", labelled: DataFrame | None = None,
) -> DataFrame:
    """(id_col, held_out, lang_pred, score, rate), a row per row of ``docs``.

    An automaton for every language is learned from ``labelled`` (``docs`` itself by default), never from held-out rows: those with
    crc32(id as text) mod ``held_out`` = 0. A worker holds ``at_once`` automata at a time. ``score`` is 1 - phrases of the winner / phrases of the next. A null text, a text
    without a letter, and any text where nothing was learned is ``und`` with score 0; ties go to the
    first language by name. Rows with a null id are held out; repeated rows get equal answers.
    """
    samples = training_text(
        docs if labelled is None else labelled, id_col, text_col, lang_col, per_language, held_out)
    kind = small_batches(docs).schema[id_col].dataType.simpleString()
    mapped = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")).mapInArrow(
        predicted(samples, at_once), f"__doc {kind}, lang_pred string, score double, rate double")
    held = F.coalesce(F.crc32(F.col("__doc").cast("string")), F.lit(0)) % held_out == 0
    return mapped.select(F.col("__doc").alias(id_col), held.alias("held_out"), "lang_pred", "score", "rate")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not ``und``: those with a letter, where anything was learned. Text of no learned language stays."""
    samples = training_text(docs, options.get("id_col", "doc_id"), "text", "lang",
                            options.get("per_language", 12_288), options.get("held_out", 5))
    predict = predicted(samples, options.get("at_once", 64))
    at = small_batches(docs).columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for said in predict(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(at)], ["__doc", "text"])])):
                yield batch.filter(pc.not_equal(said.column(1), UNKNOWN))

    return docs.mapInArrow(keep, docs.schema)
