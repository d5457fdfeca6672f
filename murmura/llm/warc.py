"""WARC archives: written with an index first, read back by coalesced byte ranges.

Each task writes one archive of gzip members (a record each) and returns an index row per record: file,
offset, length, URL and digest. Reading takes the index alone, sorts the wanted records of a file by offset and fetches
neighbouring ones in one range read. Archives lie in the shared folder, reached through its URI by a
file system that speaks ranges (file, hdfs, s3, gs); pages come and go through Spark. A retried
task writes a new file and its own index rows, so what a lost attempt left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.text import small_batches
from murmura.functions.durable import cut_lineage, new_path, release

GAP = 64 << 10
RANGE = 8 << 20
_INDEX = "file string, offset bigint, length bigint, url string, digest string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool, date: str) -> bytes:
    """A record with an id of its own; the page's id and that of the page it revisits are fields of ours."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"X-Page-Id: {'' if page is None else page}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head.append(f"X-Refers-To-Page: {refers}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path, stream, name, at = None, None, None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, refers, revisit in zip(*[batch.column(i) for i in range(5)], strict=True):
                    if stream is None:
                        files, path = _folder(folder)
                        files.create_dir(path, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        stream = files.open_output_stream(f"{path}/{name}", compression=None)
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    digest = digest_of(payload)
                    record = _record(page.as_py(), url.as_py(), payload, digest, refers.as_py(), revisit.as_py(), date)
                    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
                    member = pack.compress(record) + pack.flush()
                    stream.write(member)
                    rows.append((name, at, len(member), url.as_py(), digest))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                            pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                        ["file", "offset", "length", "url", "digest"])
        finally:
            if stream is not None:
                stream.close()

    return write


def write_archives(
    pages: DataFrame, folder: str, revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date: datetime | None = None,
) -> DataFrame:
    """Write a record per row of ``pages`` below ``folder``; returns the index (file, offset, length, url, digest).

    Of rows with equal payloads of at least ``revisit_bytes`` bytes those with the largest id are responses (a null id is the
    smallest; rows that share that id are all responses), the others revisit it. A null html is empty. ``date`` is that of
    the records, now by default.
    """
    small_batches(pages)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("html"),
        F.sha1(F.encode(payload, "UTF-8")).alias("sha"))
    # Which page to revisit is settled on ids and digests; a common payload is dealt by page and URL where html is moved.
    told = [F.coalesce("page", F.lit(0).cast("bigint")).alias("page0"), F.xxhash64("page", "url").alias("tag"), "sha"]
    seen = cut_lineage(rows.where(F.octet_length("html") >= revisit_bytes).select("page", *told))
    last = cut_lineage(seen.groupBy("sha").agg(F.max("page").alias("refers"), F.count(F.lit(1)).alias("n")).where(
        "n > 1 and refers is not null").drop("n"))
    again = cut_lineage(seen.join(last, "sha").where(~F.col("page").eqNullSafe(F.col("refers"))).select(
        "page0", "tag", "sha", F.col("page").isNull().alias("void"), "refers").distinct())
    named = rows.select("page", "url", "html", *told, F.col("page").isNull().alias("void"))
    typed = named.join(again, ["page0", "tag", "sha", "void"], "left").select(
        "page", "url", F.encode("html", "UTF-8").alias("html"), "refers", F.col("refers").isNotNull().alias("revisit"))
    when = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    index = cut_lineage(typed.mapInArrow(_writer(folder, when), _INDEX))
    release(seen, last, again)
    return index


def coalesced(offsets: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Index ranges of sorted records to be read at once: gaps up to GAP, RANGE bytes at most unless one record is longer."""
    out, first = [], 0
    for k in range(1, len(offsets) + 1):
        if k == len(offsets) or offsets[k] - (offsets[k - 1] + lengths[k - 1]) > GAP or (
                offsets[k] + lengths[k] - offsets[first] > RANGE):
            out.append((first, k))
            first = k
    return out if len(offsets) else []


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    record = zlib.decompress(member, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(said: str | None) -> int | None:
    return int(said) if said else None


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _folder(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            offsets, lengths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            order = sorted(range(len(names)), key=lambda k: (names[k], offsets[k]))
            for name in sorted(set(names)):
                mine = np.array([k for k in order if names[k] == name])
                with files.open_input_file(f"{path}/{name}") as source:
                    for a, b in coalesced(offsets[mine], lengths[mine]):
                        low, rows = int(offsets[mine[a]]), []
                        held = source.read_at(int(offsets[mine[b - 1]] + lengths[mine[b - 1]]) - low, low)
                        for k in mine[a:b]:
                            begin = int(offsets[k]) - low
                            fields, block = _parse(held[begin: begin + int(lengths[k])])
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            payload = block.partition(b"\r\n\r\n")[2]
                            if fields["WARC-Type"] == "response" and digest_of(payload) != digest:
                                raise ValueError(f"damaged record in {name} at {offsets[k]}")
                            rows.append((
                                _page(fields["X-Page-Id"]), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest,
                                fields["WARC-Type"], _page(fields.get("X-Refers-To-Page")), payload if with_payload else None))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                                pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)],
                            ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return read


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the wanted ``index`` rows: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload).

    Digests of responses are checked against their bytes. A revisit's payload is empty; its length and digest are those of
    the full payload.
    """
    span = F.floor(F.col("offset") / RANGE)
    # Tasks by the bytes of the archives: those of the index say nothing.
    held = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-held // (4 * RANGE)))
    dealt = index.repartition(tasks, "file", span).sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(
        _reader(folder, with_payload), "page_id bigint, url string, payload_bytes bigint, payload_digest string,"
        " record_type string, refers_to bigint, payload binary")


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives and read every record back (an empty table gives no rows)."""
    folder = new_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, **options)
    return read_records(index, folder, with_payload=False)
