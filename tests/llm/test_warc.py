"""WARC archives: round trip, magic inside payloads over many splits, equal payloads, awkward rows."""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from termgap.llm import warc
from termgap.llm.common import fresh_path

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666>\r\nContent-Length: {n}\r\n\r\n{body}\r\n\r\n"


def pages():
    inner = FAKE.format(n=5, body="hello")
    rows = [
        (0, "http://a/0", "<p>zero</p>"), (1, "http://a/1", inner + inner + "tail"), (2, None, None), (3, "http://a/3\r\nX: y", ""),
        (4, "http://a/4", "<p>zero</p>"), (None, "http://a/n", "<p>zero</p>"), (None, "http://a/m", "only without id"), (None, "http://a/m", "only without id"),
        (5, "http://a/5", "repeated"), (5, "http://a/5", "repeated"), (5, "http://a/6", "repeated"), (6, "ü", "WARC/1." * 400 + "é" * 300),
        (7, "http://a/7", FAKE.format(n=100_000, body="runs past its end")), (8, "http://a/8", (inner + "x" * 700) * 40), (9, "u", "WARC/1.1\r\n\r\n\r\n"), (10, "u", inner[:-4]),
    ]
    return rows + [(100 + i, f"http://b/{i}", f"page {i % 40} " + "word " * (i % 60)) for i in range(300)]


def digest(text: str) -> str:
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def plain_read(root: str) -> list[tuple]:
    """Records of the archives, read one after the other from each file's start."""
    out = []
    for file in sorted(Path(root.removeprefix("file:")).glob("part-*")):
        data, at = file.read_bytes(), 0
        while at < len(data):
            head = data[at : data.index(b"\r\n\r\n", at)]
            fields = dict(line.decode().split(": ", 1) for line in head.split(b"\r\n")[1:])
            begin = at + len(head) + 4
            block = data[begin : begin + int(fields["Content-Length"])]
            out.append((file.name, at, fields["WARC-Type"], fields["WARC-Record-ID"], block.partition(b"\r\n\r\n")[2]))
            at = begin + len(block) + 4
            assert data[at - 4 : at] == b"\r\n\r\n"
    return out


@pytest.mark.parametrize("split", ["64m", "2500"])
def test_records_of_the_chain_only(spark, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    path = fresh_path(spark, "warc")
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("id", F.lit("x")).withColumn("first", F.lit(1)).repartition(3)
    warc.write_warc(df, path, "2024-01-01T00:00:00Z")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = warc.read_warc(spark, path).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    mine = [(r.file.rsplit("/", 1)[1], r.offset, r.headers["warc-type"], r.headers["warc-record-id"], bytes(r.payload)) for r in rows]
    assert sorted(mine) == sorted(plain_read(path))
    assert len(mine) == len(pages())


def test_equal_payloads(spark):
    path = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(4), path, "2024-01-01T00:00:00Z")
    rows = warc.read_warc(spark, path).select(warc.page_of(F.col("headers")["warc-record-id"]).alias("id"), "headers", "payload").collect()
    want: dict[str, list] = {}
    for page_id, url, html in pages():
        want.setdefault(html or "", []).append((page_id is None, page_id, url or ""))
    for text, members in want.items():
        first = min(members, key=lambda m: (m[0], m[1] or 0, m[2]))
        mine = [r for r in rows if r.headers["warc-payload-digest"] == "sha1:" + digest(text)]
        assert len(mine) == len(members)
        responses = [r for r in mine if r.headers["warc-type"] == "response"]
        assert [(r.id, r.payload.decode()) for r in responses] == [(first[1], text)]
        for r in mine:
            if r.headers["warc-type"] == "revisit":
                assert r.headers.get("warc-refers-to") == (f"<urn:x-page:{first[1]}>" if first[1] is not None else None)


def test_small_payloads_are_all_responses(spark):
    path = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string"), path, "2024-01-01T00:00:00Z", min_bytes=3)
    kinds = {(warc_id, kind) for warc_id, kind in warc.read_warc(spark, path).select(warc.page_of(F.col("headers")["warc-record-id"]), F.col("headers")["warc-type"]).collect()}
    assert kinds == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def test_empty_table_and_foreign_files(spark, tmp_path):
    path = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path, "2024-01-01T00:00:00Z")
    assert warc.read_warc(spark, path).count() == 0
    other = "WARC/1.0\r\nWARC-Type: metadata\r\ncontent-length:  3\r\n\r\n\xff\xfe\x00\r\n\r\n".encode("latin-1")
    cut = other + b"WARC/1.1\r\nContent-Length: 50\r\n\r\ntoo short"
    for name, data in (("ok.warc", other * 3), ("cut.warc", cut), ("noise.warc", b"noise" + other), ("gap.warc", other + b"?" + other), ("empty.warc", b"")):
        (tmp_path / name).write_bytes(data)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.offset) for r in rows) == [("cut.warc", 0), ("gap.warc", 0), *(("ok.warc", len(other) * i) for i in range(3))]
    assert {(bytes(r.payload), r.http) for r in rows} == {(b"\xff\xfe\x00", None)}


def test_one_long_payload(spark):
    path = fresh_path(spark, "warc")
    text = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 200_000
    warc.write_warc(spark.createDataFrame([(1, "u", text), (2, "v", "short")], "page_id long, url string, html string").coalesce(1), path, "2024-01-01T00:00:00Z")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        rows = warc.read_warc(spark, path).select(warc.page_of(F.col("headers")["warc-record-id"]).alias("id"), F.length("payload").alias("n"), F.sha1("payload").alias("h")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.id, r.n, r.h) for r in rows} == {(1, len(text), hashlib.sha1(text.encode()).hexdigest()), (2, 5, hashlib.sha1(b"short").hexdigest())}
