import glob
import gzip
import hashlib
import os
import random

import pytest

from quern.llm import warc as W
from quern.llm.common import scratch, ship, table
from tests.conftest import SF


def pages(spark, rows):
    ship(spark)
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, type string, record_id long")


def want(rows):
    top = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            top[data] = max(top.get(data, -1), i)
    out = {}
    for i, _, html in rows:
        data = (html or "").encode()
        t = top.get(data, i)
        out[i] = (len(data), hashlib.sha1(data).hexdigest(), "response" if t == i else "revisit", None if t == i else t)
    return out


def got(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


def test_pages_round_trip(spark):
    d = table(spark, SF, "pages")
    ship(spark)
    assert got(W.digest(d)) == want([tuple(r) for r in d.select("page_id", "url", "html").collect()])


def test_revisits_and_hostile_payloads(spark):
    hostile = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 30
    big = "é" * 600
    rows = [(1, "http://a\r\nX: y", hostile), (2, None, None), (3, "c", ""), (4, "d", big), (5, "e", big), (9, "f", big), (6, "g", "short"), (7, "h", "short"), (8, "i", "\r\n\r\n\x00\n")]
    assert got(W.digest(pages(spark, rows))) == want(rows)


def test_captures_are_nested_and_whole(spark):
    rows = [(i, f"http://h/{i}", "<p>" + "x" * (900 + i) + "</p>") for i in range(1, 250)]
    path = scratch(spark, "warc-test")
    W.write_archives(pages(spark, rows), path)
    records = W.read_records(spark, path)
    assert records.count() == 3 * len(rows)
    c = W.captures(records)
    assert c.count() == len(rows)
    assert c.where("response.record_id = capture_id and request.concurrent_to = capture_id and metadata.concurrent_to = capture_id").count() == len(rows)
    assert {r["page_id"]: bytes(r["p"]).decode() for r in c.selectExpr("page_id", "response.payload as p").collect()} == {i: h for i, _, h in rows}


def test_parse_reads_plain_single_and_many_member_archives(monkeypatch):
    def record(kind, body):
        return b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    bodies = [b"", b"abc", b"WARC/1.1\r\n\r\n" * 100, bytes(range(256)) * 40]
    whole = [record(b"resource", b) for b in bodies]
    for data in (b"".join(whole), gzip.compress(b"".join(whole)), b"".join(map(gzip.compress, whole))):
        for piece in (7, 1 << 18):
            monkeypatch.setattr(W, "PIECE", piece)
            assert [b for _, b in W.parse(data)] == bodies
    with pytest.raises(ValueError):
        list(W.parse(whole[1][:-8]))
    with pytest.raises(ValueError):
        list(W.parse(b"nonsense\r\n\r\n"))


def test_odd_input(spark):
    rows = [(1, "u", "a" * 2000), (1, "u", "a" * 2000), (None, "v", "b" * 2000), (4, "w", "b" * 2000), (4, "w", "other")]
    out = W.digest(pages(spark, rows)).collect()
    assert len(out) == 4
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in out} == {(1, "response", None), (None, "revisit", 4), (4, "response", None)}
    assert W.digest(pages(spark, rows).limit(0)).count() == 0


def test_each_url_and_each_page_without_an_id_is_written(spark):
    big = "a" * 2000
    rows = [(None, "u", None), (None, "u", None), (None, "u", ""), (None, "v", "x"), (1, "a", "y"), (1, "b", "y"), (2, "a", big), (2, "b", big), (1, "c", big)]
    out = W.digest(pages(spark, rows)).collect()
    assert sorted((r["page_id"] or 0, r["target_uri"], r["record_type"], r["refers_to"] or 0) for r in out) == [
        *[(0, "u", "response", 0)] * 3, (0, "v", "response", 0), (1, "a", "response", 0), (1, "b", "response", 0),
        (1, "c", "revisit", 2), (2, "a", "response", 0), (2, "b", "response", 0),
    ]
    assert all(r["has_request"] for r in out)
    same = W.digest(pages(spark, [(None, "u", big)] * 3)).collect()
    assert sorted(r["record_type"] for r in same) == ["response", "revisit", "revisit"]


def test_equal_rows_are_a_record_each(spark):
    big = "a" * 2000
    rows = [(1, "u", big), (1, "u", big), (1, "u", "x"), (1, "u", "x"), (0, "u", big), (None, "u", big), (None, "u", big)]
    out = W.digest(pages(spark, rows), each=True).collect()
    assert sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out) == [
        (-1, 2000, "revisit", 1), (-1, 2000, "revisit", 1), (0, 2000, "revisit", 1),
        (1, 1, "response", None), (1, 1, "response", None), (1, 2000, "response", None), (1, 2000, "response", None),
    ]


def test_assembly_over_chains_directions_and_several_ids(spark):
    ship(spark)

    def record(kind, own, *together):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\n" + (f"WARC-Record-ID: <{own}>\r\n" if own else "")
        return (head + "".join(f"WARC-Concurrent-To: <{x}>\r\n" for x in together) + "Content-Length: 2\r\n\r\nhi\r\n\r\n").encode()

    records = [
        record("warcinfo", "u:info"),
        record("response", "u:r1"), record("request", "u:q1", "u:r1"), record("metadata", "u:m1", "u:r1"),  # direct
        record("response", "u:r2", "u:q2"), record("request", "u:q2"), record("metadata", "u:m2", "u:q2"),  # from the response, and a chain
        record("resource", "u:r3"), record("metadata", "u:m3", "u:nowhere", "u:r3"), record("metadata", "u:m4", "u:m3"),  # several ids, two of a kind
        record("request", "u:q5", "u:nowhere"),  # no response
        record("metadata", None), record("metadata", None),  # no id
    ]
    for data in (b"".join(records), b"".join(map(gzip.compress, records))):
        path = scratch(spark, "foreign")
        local = path.removeprefix("file:")
        os.makedirs(local)
        with open(f"{local}/part-0.txt" + (".gz" if data[:2] == b"\x1f\x8b" else ""), "wb") as f:
            f.write(data)
        out = W.assemble(W.read_records(spark, path)).collect()
        of = lambda x: x["record_id"] if x else None
        got = sorted((r["capture_id"] or "", r["part"], of(r["response"]) or "", of(r["request"]) or "", of(r["metadata"]) or "") for r in out)
        assert got == [
            ("", 0, "", "", ""), ("", 0, "", "", ""), ("u:q5", 0, "", "u:q5", ""), ("u:r1", 0, "u:r1", "u:q1", "u:m1"),
            ("u:r2", 0, "u:r2", "u:q2", "u:m2"), ("u:r3", 0, "u:r3", "", "u:m3"), ("u:r3", 1, "", "", "u:m4"),
        ]


def test_assembly_equals_captures_for_own_archives(spark):
    rows = [(i, f"http://h/{i}", "<p>" + "x" * (900 + i % 7 * 40) + "</p>") for i in range(120)]
    path = scratch(spark, "warc-own")
    W.write_archives(pages(spark, rows), path)
    records = W.read_records(spark, path)
    key = lambda r: (r["capture_id"], r["page_id"], r["response"]["record_id"], r["request"]["record_id"], r["metadata"]["record_id"])
    assert sorted(map(key, W.assemble(records).collect())) == sorted(map(key, W.captures(records).collect()))
    assert W.assemble(records.limit(0)).count() == 0


def test_archives_larger_than_a_split_are_read_by_ranges(spark):
    rng = random.Random(5)
    # letters of 64 values compress little: 5 MB a page
    long = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=5_000_000)) for _ in range(4)]
    rows = [(i, f"http://h/{i}", html) for i, html in enumerate([*long, "short", "", *(f"page {i}" * 300 for i in range(50)), long[0]])]
    path = scratch(spark, "warc-large")
    W.write_archives(pages(spark, rows).coalesce(1), path)
    local = path.removeprefix("file:").replace("//", "/")
    [archive] = glob.glob(f"{local}/part-*")
    with open(archive, "rb") as f:
        data = f.read()
    assert sum(1 for _ in W.parse(data)) == 3 * len(rows) and gzip.decompress(data).count(b"WARC/1.1\r\n") == 3 * len(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("1m", "300001"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            found = W.read_archives(spark, path)
            assert found.rdd.getNumPartitions() > len(data) // (1 << 20)
            payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in found.where("type = 'response'").collect()}
            assert payloads == {i: h for i, _, h in rows if i != 0} and found.count() == 3 * len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_payload_that_holds_the_mark(spark):
    noise = random.Random(7).randbytes(40_000)
    hostile = noise + W.MARK + noise[::-1] + W.MARK * 3
    packed = W.member(hostile)
    assert W.MARK not in packed and gzip.decompress(packed) == hostile
    path = scratch(spark, "warc-mark")
    ship(spark)
    W.write_archives(spark.createDataFrame([(1, "u", bytearray(hostile)), (2, "v", bytearray(W.MARK))], "page_id long, url string, html binary"), path)
    found = W.read_archives(spark, path).where("type = 'response'").collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in found} == {1: hostile, 2: W.MARK}


def test_many_equal_rows_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 7)
    big = "a" * 2000
    rows = [(1, "u", big)] * 50 + [(None, "u", "x")] * 14 + [(2, "u", "y")] * 7
    out = W.digest(pages(spark, rows), each=True).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["payload_bytes"]) for r in out) == [(0, "response", 1)] * 14 + [(1, "response", 2000)] * 50 + [(2, "response", 1)] * 7


def test_one_payload_on_most_pages(spark):
    big = "b" * 3000
    rows = [(i, f"http://h/{i}", big if i % 3 else f"{i}" * 900) for i in range(600)]
    assert got(W.digest(pages(spark, rows))) == want(rows)
