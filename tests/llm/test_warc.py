import base64
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a.example/x", "<p>same</p>"),
    (7, "http://b.example/", "<p>same</p>"),
    (3, None, "<p>same</p>"),
    (4, "http://c.example/\r\nX-Evil: 1", None),
    (5, "http://d.example/", ""),
    (6, "http://é.example/", "<p>é ü 中</p>" * 2000),
    (None, "http://n.example/", "<p>same</p>"),
    (7, "http://b.example/", "<p>same</p>"),
    (8, "http://e.example/", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture
def path(spark):
    return common.scratch_path(spark, f"archive-{uuid.uuid4().hex}")


def test_contract(spark, path):
    warc.write_archive(spark.createDataFrame(ROWS, PAGES).withColumn("sha256", F.lit("clash")).withColumn("payload", F.lit(1)), path)
    rows = sorted(map(tuple, warc.read_archive(spark, path).collect()), key=repr)
    keeper = {}
    for p, _, h in ROWS:
        if p is not None:
            keeper[h or ""] = max(p, keeper.get(h or "", p))
    want = [(p, len((h or "").encode()), digest(h), "response" if p == keeper[h or ""] else "revisit", None if p == keeper[h or ""] else keeper[h or ""], True) for p, _, h in ROWS]
    assert rows == sorted(want, key=repr)


def test_payloads_are_stored_once_and_records_round_trip(spark, path):
    warc.write_archive(spark.createDataFrame(ROWS, PAGES), path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in ROWS})
    found = warc.records(spark, path).collect()
    assert len(found) == len(ROWS)
    data = b"".join(bytes(r.record) for r in found)
    parsed = list(warc.split_records(data))
    assert len(parsed) == len(ROWS)
    by_id = {(p, u): h for p, u, h in ROWS}
    for fields, block in parsed:
        http, _, body = block.partition(b"\r\n\r\n")
        pid = int(fields["WARC-Page-ID"]) if "WARC-Page-ID" in fields else None
        html = next(h for (p, _), h in by_id.items() if p == pid) or ""
        assert fields["WARC-Payload-Digest"] == f"sha1:{digest(html)}"
        assert body == (html.encode() if fields["WARC-Type"] == "response" else b"")
        assert f"Content-Length: {len(html.encode())}".encode() in http
        assert "X-Evil" not in fields


EVIL = [
    (2, "http://a.example/\u2028WARC-Refers-To-Page-ID: 77", "<p>same</p>"),
    (3, "http://a.example/", "<p>same</p>"),
    (None, "http://a.example/\x85WARC-Page-ID: 5", "<p>other</p>"),
    (6, "http://a.example/\nWARC-Type: warcinfo\r\n\r\n\x0b\x0c\x1e\u2029\x00", None),
]


def test_urls_cannot_forge_fields(spark, path):
    warc.write_archive(spark.createDataFrame(EVIL, PAGES), path)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.verified) for r in warc.read_archive(spark, path).collect()), key=repr)
    assert got == sorted([(2, "revisit", 3, True), (3, "response", None, True), (None, "response", None, True), (6, "response", None, True)], key=repr)
    heads = [bytes(r.header).decode() for r in warc.records(spark, path).collect()]
    assert any("/%E2%80%A8WARC-Refers-To-Page-ID: 77\r\n" in h for h in heads) and any("/%C2%85WARC-Page-ID: 5\r\n" in h for h in heads)
    assert all(len(h.split("\r\n\r\n")) == 3 for h in heads) and not any(c in h for h in heads for c in "\u2028\u2029\x85\x0b\x0c\x1e\x00")


def test_records_stand_for_their_payload(spark, path):
    warc.write_archive(spark.createDataFrame(ROWS, PAGES), path)
    by_id = {p: (h or "").encode() for p, _, h in ROWS}
    for r in warc.records(spark, path).collect():
        assert bytes(r.payload) == by_id[r.page_id] and bytes(r.record).startswith(bytes(r.header))
        assert bytes(r.record)[len(r.header) :] == (b"" if r.record_type == "revisit" else by_id[r.page_id]) + b"\r\n\r\n"


def test_a_hot_payload_is_dealt_over_tasks(spark, path, monkeypatch):
    monkeypatch.setattr(warc, "GROUP", 4)
    rows = [(i, "u", "hot" if i % 3 else f"p{i}") for i in range(60)]
    warc.write_archive(spark.createDataFrame(rows, PAGES), path)
    got = warc.read_archive(spark, path).collect()
    assert sorted((r.page_id, r.payload_digest) for r in got) == [(i, digest(h)) for i, _, h in rows] and all(r.verified for r in got)


def test_very_long_pages_and_a_lost_payload(spark, path):
    rows = [(1, "u", "x" * 3_000_000), (2, "u" * 100_000, "y")]
    warc.write_archive(spark.createDataFrame(rows, PAGES), path)
    assert {(r.page_id, r.payload_bytes, r.verified) for r in warc.read_archive(spark, path).collect()} == {(1, 3_000_000, True), (2, 1, True)}
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-bad/headers")
    spark.read.parquet(f"{path}/payloads").filter("octet_length(payload) > 1").write.parquet(f"{path}-bad/payloads")
    assert {(r.page_id, r.payload_bytes, r.verified) for r in warc.read_archive(spark, f"{path}-bad").collect()} == {(1, 3_000_000, True), (2, None, False)}


def test_small_payloads_are_all_responses(spark, path):
    warc.write_archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], PAGES), path, min_bytes=5)
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect()} == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)}


def test_damage_is_noticed(spark, path):
    warc.write_archive(spark.createDataFrame(ROWS, PAGES), path)
    store = spark.read.parquet(f"{path}/payloads")
    bad = store.withColumn("payload", F.when(F.octet_length("payload") == 11, F.lit(b"<p>SAME</p>")).otherwise(F.col("payload")))
    bad.write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-bad/headers")
    assert {r.page_id for r in warc.read_archive(spark, f"{path}-bad").collect() if not r.verified} == {1, 3, 7, None}


def test_many_shared_groups_go_through_the_salted_join(spark, path, monkeypatch):
    monkeypatch.setattr(common.lookup, "__defaults__", ("left", 0))
    test_contract(spark, path)


def test_empty_table(spark, path):
    warc.write_archive(spark.createDataFrame([], PAGES), path)
    assert warc.read_archive(spark, path).count() == 0
