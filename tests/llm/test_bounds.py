"""Bounds on what reaches the driver, hashes that crafted text cannot make equal, archives other readers accept."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.llm import features, quality_rules, text, topk, warc
from murmura.llm.jaccard import jaccard_groups


def thue_morse(size: int) -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_crafted_strings_have_hashes_of_their_own(spark):
    for size in (1024, 2048, 4096):
        one, two = thue_morse(size)
        whole = text.Rolling(np.frombuffer((one + two + one).encode(), np.uint8))
        starts = np.array([0, size, 2 * size])
        got = whole.ranges(starts, starts + size)
        assert got[0] == got[2] != got[1]
        windows = whole.windows(size)
        assert windows[0] == windows[2 * size] != windows[size]
    one, two = thue_morse(2048)
    part = next(text.slices(text.pa.array([f"{one}\n{two}\n{one}"])))
    assert features.Profile(part).n_dup_lines.tolist() == [1]
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id bigint, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_groups(docs, 4, 85).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_range_hashes_do_not_depend_on_their_place():
    rng = np.random.default_rng(0)
    word = rng.integers(0, 256, 700).astype(np.uint8)
    data = np.concatenate([rng.integers(0, 256, 5000).astype(np.uint8), word, rng.integers(0, 256, 3).astype(np.uint8), word])
    got = text.Rolling(data).ranges(np.array([5000, 5703, 0]), np.array([5700, 6403, 700]))
    assert got[0] == got[1] != got[2]


def test_a_repeated_id_sends_no_more_than_the_sample(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("good words "), "id").alias("text")).unionByName(
        spark.createDataFrame([(2, "bad bad bad")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    held = []
    taken = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: held.append(taken(df)) or held[-1])
    first = quality_rules.quality_rules(docs, labels, sample=10).select("quality_score").distinct().collect()
    assert [t.num_rows for t in held] == [10] and set(held[0]["target"].to_pylist()) == {0.0, 1.0}
    again = quality_rules.quality_rules(docs.repartition(7), labels, sample=10).select("quality_score").distinct().collect()
    assert sorted(first) == sorted(again)


def test_vectors_meet_their_own_width(spark):
    rows = [(0, [1.0, 2.0]), (10, [3.0, 1.0]), (11, [1.0, 0.0]), (20, [1.0]), (21, [5.0]), (30, []), (40, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {tuple(r) for r in topk.top_products(table, F.col("vec_id") % 10 == 0, 1, scale=1).collect()}
    assert got == {(0, 1, 10, 5), (10, 1, 0, 5), (20, 1, 21, 5)}


@pytest.mark.parametrize("hot", [400])
def test_archives_are_valid_and_hot_payloads_spread(spark, tmp_path, hot):
    rows = [(i, f"http://h/{i}", "<p>error</p>") for i in range(hot)] + [(None, "http://n/", "<p>error</p>"), (0, "http://z/", "other"), (7, "u", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    index = warc.write_archives(pages, str(tmp_path / "w"))
    back = warc.read_records(index, str(tmp_path / "w"))
    assert back.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = back.collect()
    assert len(got) == len(rows)
    assert sum(r["record_type"] == "revisit" and r["refers_to"] == hot - 1 for r in got) == hot
    assert {(r["page_id"], bytes(r["payload"])) for r in got if r["record_type"] == "response"} == {
        (hot - 1, b"<p>error</p>"), (0, b"other"), (7, b"")}
    names = set()
    for r in index.collect():
        member = (tmp_path / "w" / r["file"]).read_bytes()[r["offset"]: r["offset"] + r["length"]]
        head, _, block = zlib.decompress(member, 31).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
        names.add(fields["WARC-Record-ID"])
        assert {"WARC-Type", "WARC-Date", "Content-Length", "WARC-Target-URI"} <= set(fields)
        assert fields["Content-Type"].startswith("application/http") and block.startswith(b"HTTP/1.1 200 OK\r\n")
        assert len(block) == int(fields["Content-Length"]) + 4
    assert len(names) == len(rows)
