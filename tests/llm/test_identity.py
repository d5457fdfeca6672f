"""Rows are told apart by 128 bits, and no answer depends on the rows beside it."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from murmura.llm import language, pii, suffix_dedup

#: Two texts of null ids with one 32-bit hash.
CLEAN, PRIVATE = "note 1619 nothing here at all", "note 171452 mail bob@example.com now"


def test_rows_with_one_32_bit_hash(spark):
    docs = spark.createDataFrame([(None, CLEAN), (None, PRIVATE), (None, CLEAN)], "doc_id bigint, text string")
    assert sorted(r["text"] for r in pii.masked(docs).collect()) == [CLEAN, CLEAN, "note 171452 mail <EMAIL> now"]
    got = Counter((r["n_email"], r["spans"]) for r in pii.personal_data(docs).collect())
    assert got == Counter({(0, ""): 2, (1, "email:17:32"): 1})
    cut = suffix_dedup.repeated_passages(docs, 20).collect()
    assert Counter((r["n_bytes"], r["n_removed"]) for r in cut) == Counter({(len(CLEAN), len(CLEAN)): 2, (len(PRIVATE), 0): 1})


@pytest.mark.parametrize("kind", ["string", "decimal(38,0)", "timestamp"])
def test_ids_of_any_type(spark, kind):
    base = spark.createDataFrame([(1, PRIVATE), (2, "a passage of more than twenty bytes"), (3, "x a passage of more than twenty bytes"), (None, "")],
                                 "n bigint, text string")
    ids = {"string": "concat('id-', n)", "decimal(38,0)": "cast(n as decimal(38,0))", "timestamp": "timestamp_seconds(n)"}[kind]
    docs = base.selectExpr(f"{ids} AS doc_id", "text")
    assert Counter(r["n_email"] for r in pii.personal_data(docs).collect()) == Counter({0: 3, 1: 1})
    cut = suffix_dedup.repeated_passages(docs, 20)
    assert cut.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted(r["n_removed"] for r in cut.collect()) == [0, 0, 35, 35]


def test_a_text_begins_at_its_border():
    table = language.parser_table([b"guten tag und guten morgen", b"good day and good morning"])
    texts = [b"abc", '"Guten Tag'.encode(), b"", b"...", '"Guten Tag'.encode(), b"x"]

    def counts(some):
        offs = np.concatenate([[0], np.cumsum([len(t) for t in some])]).astype(np.int64)
        return language.phrases(np.frombuffer(b"".join(some), np.uint8), offs, *table).tolist()

    assert counts(texts) == [counts([t])[0] for t in texts]


def labelled(spark, n):
    rows = [(i, f"kurz {i} wort" if i % 2 else f"header header {'x' * 60} body{i} tail{i}", "de" if i % 2 else "en") for i in range(n)]
    return spark.createDataFrame([*rows, rows[1], rows[1], (n, "", "fr"), (n + 1, None, "fr"), (None, "null id", "xx")],
                                 "doc_id bigint, text string, lang string")


def test_training_text_fills_its_budget(spark):
    docs = labelled(spark, 3000)
    got = language.training_text(docs, "doc_id", "text", "lang", 4096, 5, 24)
    assert set(got) == {"de", "en"} and all(len(t) == 4096 for t in got.values())
    # Windows lie anywhere in a text, not only at its start.
    assert b"tail" in got["en"]
    assert got == language.training_text(docs.repartition(7), "doc_id", "text", "lang", 4096, 5, 24)
    # All text there is, where it does not fill the budget.
    all_ = language.training_text(docs.where("lang = 'de'"), "doc_id", "text", "lang", 1 << 20, 5)
    assert 1100 < all_["de"].count(b"kurz") < 1300


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    docs = labelled(spark, 200).unionByName(spark.createDataFrame(
        [(9000 + i, t, None) for i, t in enumerate(['"kurz wort', "abc", "7 header", "é", None, ""])], "doc_id bigint, text string, lang string"))

    def answers(some):
        return Counter(tuple(r) for r in language.identify_language(some, labelled=docs).collect())

    assert answers(docs.coalesce(1)) == answers(docs.repartition(9)) == answers(docs.orderBy("text").coalesce(2))
