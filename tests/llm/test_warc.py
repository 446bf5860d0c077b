"""WARC archives: whole round trips, what predicates skip, and roles against a plain computation."""

from __future__ import annotations

import gzip
import hashlib
import io
from base64 import b32encode
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not, StringStartsWith

from tiercurve.llm import warc
from tiercurve.llm.common import table


def expected(items, min_bytes=0):
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of ``(page_id, url, html)`` rows."""
    same = defaultdict(list)
    for page, url, html in items:
        same[(html or "").encode()].append((page is not None, page, url is not None, url))
    out = []
    for payload, rows in same.items():
        rows.sort(key=repr)
        rows.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3] or ""), reverse=True)
        digest = b32encode(hashlib.sha1(payload).digest()).decode()
        for k, (_, page, _, _) in enumerate(rows):
            revisit = k and len(payload) >= min_bytes
            out.append((page, len(payload), digest, "revisit" if revisit else "response", rows[0][1] if revisit else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = [
    (1, "http://a/?q=ä b\r\n", "<p>ä</p>"), (2, None, "<p>ä</p>"), (7, "u", "<p>ä</p>"), (7, "u", "<p>ä</p>"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (5, "", "x"),
    (None, None, None), (None, "n", "only null"), (None, "n", "only null"), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (9, "u", "y\r\n" * 100_000), (10, "u", "\r\n\r\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "page_id long, url string, html string")
    return df.withColumns({"payload": F.lit("p"), "sha1": F.lit(1), "times": F.lit(2), "record_type": F.lit("t"), "n": F.lit(0)})


def test_query_on_the_small_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    items = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    doubled = pages.unionAll(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 10_000))
    assert rows_of(warc.query(pages)) == expected(items)
    want = expected([*items, *((p + 10_000, u, h) for p, u, h in items if p % 3 == 0)])
    assert rows_of(warc.query(doubled)) == want and any(r[3] == "revisit" for r in want)


def test_odd_rows(odd):
    assert rows_of(warc.query(odd)) == expected(ODD)
    assert warc.query(odd.where("false")).count() == 0


def test_ids_of_text(spark):
    df = spark.createDataFrame([("a/b c", "u", "same"), ("ü+%20", "u", "same"), (None, "u", "other")], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.query(df).collect()}
    assert got == {"a/b c": ("revisit", "ü+%20"), "ü+%20": ("response", None), None: ("response", None)}


def test_a_payload_of_very_many_rows(spark):
    pages = spark.range(9000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("html"))
    again = pages.where("page_id = 5").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(9000)))).drop("x")
    got = warc.query(pages.unionAll(again)).groupBy("payload_bytes", "record_type", "refers_to").count().where("count > 100 or record_type = 'revisit'")
    kinds = {(r.payload_bytes, r.record_type, r.refers_to): r["count"] for r in got.collect()}
    assert kinds[(3, "revisit", 8997)] == 2999 and kinds[(1, "revisit", 5)] == 9000 and len([k for k in kinds if k[1] == "revisit"]) == 2


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip_in_many_small_pieces(spark, odd, tmp_path, compression):
    path = str(tmp_path / "archive")
    warc.write(odd, path, min_bytes=5, compression=compression, split_bytes=100, file_bytes=700, date="2024-05-06T07:08:09Z")
    got = warc.read(spark, path, split_bytes=300)
    assert got.rdd.getNumPartitions() > 3
    payloads = defaultdict(list)
    for page, url, html in ODD:
        payloads[page].append((html or "").encode())
    rows = got.collect()
    assert len(rows) == len(ODD) and {r.date for r in rows} == {"2024-05-06T07:08:09Z"}
    for r in rows:
        page = int(r.record_id[9:]) if ":page:" in r.record_id else None
        if r.record_type == "response":
            assert bytes(r.payload) in payloads[page] and r.text == bytes(r.payload).decode() and r.payload_length == len(r.payload)
            assert r.payload_digest == "sha1:" + b32encode(hashlib.sha1(r.payload).digest()).decode()
        else:
            assert r.payload is None and r.payload_length in map(len, payloads[page])
    kinds = [(r.payload_length, r.record_type) for r in rows]
    assert sorted(kinds) == sorted((r[1], r[3]) for r in expected(ODD, 5))
    assert {r.target_uri for r in rows if r.record_id == "urn:page:1"} == {"http://a/?q=%C3%A4%20b%0D%0A"}


def test_manifests_hide_files_of_failed_attempts(spark, odd, tmp_path):
    path = tmp_path / "archive"
    warc.write(odd, str(path))
    (path / "part-99999-dead.warc").write_bytes(b"WARC/1.1\r\nhalf a rec")
    assert warc.read(spark, f"file://{path}", "record_id").count() == len(ODD)
    warc.write(odd.limit(3), str(path))
    assert warc.read(spark, str(path), "record_id").count() == len(ODD) + 3


FOREIGN = [
    (b"warcinfo", b"", b"application/warc-fields", b"software: x\r\n"),
    (b"response", b"http://b/", b"application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n\xe9t\xe9"),
    (b"request", b"http://b/", b"application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n"),
    (b"resource", b"http://c/", b"text/plain", b"caf\xc3\xa9"),
]


@pytest.fixture(params=["plain", "packed"])
def foreign(request, tmp_path):
    """An archive of other making: no manifest, folded and oddly cased headers, all kinds of records."""
    records = []
    for k, (kind, uri, content, block) in enumerate(FOREIGN):
        head = b"WARC/1.0\r\nwarc-type: %s\r\nWARC-Record-ID: <urn:uuid:%d>\r\n" % (kind, k) + (b"WARC-Target-URI:\r\n %s\r\n" % uri if uri else b"")
        records.append(head + b"Content-Type: %s\r\nCONTENT-LENGTH: %d\r\n\r\n" % (content, len(block)) + block + b"\r\n\r\n")
    path = tmp_path / ("x.warc.gz" if request.param == "packed" else "x.warc")
    path.write_bytes(b"".join(gzip.compress(r) for r in records) if request.param == "packed" else b"".join(records))
    return str(path)


def test_archives_of_other_making(spark, foreign):
    rows = {r.record_type: r for r in warc.read(spark, foreign).collect()}
    assert rows["response"].text == "été" and rows["response"].target_uri == "http://b/" and rows["response"].payload_length == 3
    assert rows["resource"].text == "café" and rows["warcinfo"].target_uri is None and rows["request"].payload_length == 0


def test_predicates_reach_the_reader(spark, foreign):
    got = warc.read(spark, foreign).where("record_type in ('response', 'resource') and target_uri like 'http://b%' and payload_length > 2")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter isnotnull" not in plan and [r.text for r in got.collect()] == ["été"]
    assert "Filter (" in warc.read(spark, foreign).where("length(text) > 2")._jdf.queryExecution().executedPlan().toString()
    assert warc.read(spark, foreign, "record_id").where("record_id <> 'urn:uuid:0'").count() == 3


@pytest.mark.parametrize(
    "tests, decoded",
    [([], 4), ([EqualTo(("record_type",), "response")], 1), ([Not(In(("record_type",), ("response", "request")))], 2), ([IsNull(("target_uri",))], 1),
     ([StringStartsWith(("target_uri",), "http://c")], 1), ([GreaterThan(("payload_length",), 3)], 2), ([Not(EqualTo(("target_uri",), "http://b/"))], 1)],
)
def test_unwanted_payloads_are_not_decoded(foreign, tests, decoded):
    for names, count in ((warc.SCHEMA.names, decoded), (["record_id"], 0)):
        reader = warc.WarcReader(foreign, warc.SCHEMA, 1 << 20)
        reader.names = names
        assert list(reader.pushFilters(tests)) == []
        found = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        assert (found, reader.decoded) == (decoded, count)


def test_packed_payloads_are_passed_over(spark, tmp_path):
    noise = np.random.default_rng(0).integers(97, 123, 3_000_000).astype(np.uint8).tobytes().decode()
    pages = spark.createDataFrame([(1, "u", noise), (2, "u", "small")], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "a"))
    file = next((tmp_path / "a").glob("*.warc.gz"))
    with gzip.open(file) as plain:  # any gzip reader can read it
        assert plain.read().count(b"WARC/1.1\r\n") == 2
    raw = io.BufferedReader(io.FileIO(file), 1 << 16)
    sizes = []
    for member in warc._members(raw, None):
        assert member.readline() == b"WARC/1.1\r\n"
        sizes.append(member.raw.left)
    assert max(sizes) > 1_500_000  # not read, let alone unpacked
    got = {r.record_id: len(r.payload) for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert got == {"urn:page:1": 3_000_000, "urn:page:2": 5}


def test_broken_archives_are_refused(tmp_path):
    (tmp_path / "bad.warc").write_bytes(b"no record\r\n")
    reader = warc.WarcReader(str(tmp_path / "bad.warc"), warc.SCHEMA, 1 << 20)
    with pytest.raises(ValueError):
        list(reader.read(reader.partitions()[0]))
    with pytest.raises(FileNotFoundError):
        warc.WarcReader(str(tmp_path / "none.warc"), warc.SCHEMA, 1).partitions()
