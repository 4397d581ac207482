"""Archives: round trips, predicates that decide before the payload is read, foreign files, and pages stored once."""

import base64
import glob
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import warc

SCHEMA = "type string, record_id string, date string, target_uri string, payload_digest string, payload_length long, refers_to string, payload binary"
NASTY = b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\x1f\x8b\x08\x04" + bytes(range(256))


def _rows(n=40):
    return [
        ("response" if i % 4 else "resource", f"<urn:t:{i}>", "2024-01-01T00:00:00Z", f"http://h{i % 3}.example/é?{i}" if i % 5 else None, f"sha1:{i}", None, None, NASTY * i)
        for i in range(n)
    ]


def _written(spark, tmp_path, rows=None, **options):
    folder = str(tmp_path / "archive")
    warc.write_warc(spark.createDataFrame(rows or _rows(), SCHEMA).repartition(3), folder, **options)
    return folder


def test_round_trip(spark, tmp_path):
    folder = _written(spark, tmp_path, rollBytes="2000")
    assert len(glob.glob(folder + "/*.warc.gz")) > 3
    back = warc.read_warc(spark, folder, partitionBytes="3000").filter("type != 'warcinfo'")
    got = {r.record_id: (r.type, r.date, r.target_uri, r.payload_digest, r.payload_length, bytes(r.payload)) for r in back.collect()}
    assert got == {r[1]: (r[0], r[2], r[3], r[4], len(r[7]), r[7]) for r in _rows()}
    infos = warc.read_warc(spark, folder, "type string, headers map<string,string>").filter("type = 'warcinfo'").collect()
    assert {r.headers["warc-filename"] for r in infos} == {f.rsplit("/", 1)[1] for f in glob.glob(folder + "/*.warc.gz")}


@pytest.mark.parametrize(
    "test",
    ["type = 'resource'", "type <> 'resource'", "type IN ('resource', 'x')", "target_uri LIKE 'http://h1%'", "target_uri IS NULL", "NOT target_uri LIKE '%9'",
     "target_uri LIKE '%é%'", "record_id >= '<urn:t:3'", "record_id < '<urn:t:3'", "target_uri <=> NULL", "NOT (target_uri <=> 'http://h1.example/é?1')", "payload_length > 3000",
     "type = 'response' AND payload_length < 2000 AND date IS NOT NULL"],
)
def test_predicates(spark, tmp_path, test):
    folder = _written(spark, tmp_path)
    got = warc.read_warc(spark, folder).filter(test).filter("type != 'warcinfo'")
    want = spark.createDataFrame(_rows(), SCHEMA).withColumn("payload_length", F.octet_length("payload").cast("long")).filter(test)
    assert {r.record_id for r in got.collect()} == {r.record_id for r in want.collect()}


def test_header_predicates_leave_the_plan(spark, tmp_path):
    frame = warc.read_warc(spark, _written(spark, tmp_path), "type string, target_uri string").filter("type = 'response' AND target_uri LIKE 'http://h1%'")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert ") Filter " not in plan and "Filter (" not in plan


def test_unwanted_payloads_are_not_inflated(spark, tmp_path):
    rows = [("response", f"<urn:t:{i}>", None, f"http://{i % 2}.example", None, None, None, hashlib.sha512(b"%d" % i).digest() * 40_000) for i in range(6)]
    folder = str(tmp_path / "archive")
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder)
    (path,) = glob.glob(folder + "/*.warc.gz")
    data = bytearray(open(path, "rb").read())
    members = [i for i in range(len(data)) if data[i : i + 4] == b"\x1f\x8b\x08\x04"][1:]
    for start in members[1::2]:  # spoil the payloads of host 1
        data[start + 5000 : start + 5100] = b"\xff" * 100
    open(path, "wb").write(data)
    good = warc.read_warc(spark, folder).filter("target_uri = 'http://0.example'")
    assert sorted(bytes(r.payload) for r in good.collect()) == sorted(r[7] for r in rows[::2])
    assert warc.read_warc(spark, folder, "record_id string, target_uri string, type string").filter("type = 'response'").count() == 6
    with pytest.raises(Exception, match="(?s)invalid|incorrect|error"):
        warc.read_warc(spark, folder).filter("target_uri = 'http://1.example'").select(F.sum(F.length("payload"))).collect()


def _record(kind, uri, block, content_type="text/plain", extra=""):
    return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\n{extra}Content-Type: {content_type}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 404 Not Found\r\nX-A: b\r\n\r\n" + NASTY
    records = [
        _record("request", "http://a", b"GET / HTTP/1.1\r\n\r\n"), _record("response", "http://a", http, "application/http;msgtype=response", "X-Note: one\r\n two\r\n"),
        _record("metadata", "http://b", b""), _record("resource", "http://c", NASTY * 3000),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    whole = io.BytesIO()
    with gzip.GzipFile(fileobj=whole, mode="wb") as out:
        out.write(b"".join(records))
    (tmp_path / "whole.warc.gz").write_bytes(whole.getvalue())
    (tmp_path / "notes.txt").write_text("no archive")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    for name in ("plain.warc", "members.warc.gz", "whole.warc.gz"):
        got = [(r.type, r.target_uri, r.payload_length, bytes(r.payload)) for r in rows if r.file.endswith("/" + name)]
        assert got == [
            ("request", "http://a", 18, b"GET / HTTP/1.1\r\n\r\n"), ("response", "http://a", len(NASTY), NASTY), ("metadata", "http://b", 0, b""),
            ("resource", "http://c", 3000 * len(NASTY), NASTY * 3000),
        ]
    assert {r.headers["x-note"] for r in rows if r.type == "response"} == {"one two"}
    few = warc.read_warc(spark, str(tmp_path), "target_uri string, payload binary").filter("target_uri = 'http://c'").collect()
    assert len(few) == 3 and {bytes(r.payload) for r in few} == {NASTY * 3000}


def test_only_committed_files_count(spark, tmp_path):
    folder = _written(spark, tmp_path)
    (tmp_path / "archive" / "part-00000-000-lost.warc.gz").write_bytes(b"left by a lost executor")
    assert warc.read_warc(spark, folder).filter("type <> 'warcinfo'").count() == 40
    warc.write_warc(spark.createDataFrame(_rows(7), SCHEMA), folder)
    assert warc.read_warc(spark, folder).filter("type <> 'warcinfo'").count() == 47
    warc.write_warc(spark.createDataFrame(_rows(5), SCHEMA), folder, mode="overwrite")
    assert warc.read_warc(spark, folder).filter("type <> 'warcinfo'").count() == 5
    with pytest.raises(Exception, match="no columns"):
        warc.read_warc(spark, folder, "nothing string").collect()


PAGES = (
    [(i, f"http://p{i}", f"<html>{i // 3}</html>") for i in range(30)]
    + [(100 + i, "http://hot\r\nX: y", "<p>same é</p>") for i in range(200)]
    + [(5, "http://again", "<html>1</html>"), (3, "http://p3", "<html>1</html>"), (3, "http://p3", "<html>1</html>")]
    + [(None, None, None), (None, "http://n", ""), (900, "http://e", ""), (901, "http://e", None), (None, "http://z", "only here"), (-4, None, "b" * 3_000_000)]
)


@pytest.mark.parametrize("min_bytes", [0, 14])
def test_pages(spark, tmp_path, monkeypatch, min_bytes):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 3 if min_bytes else 1 << 20)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS type", "2 AS payload", "3 AS _row").repartition(5)
    warc.archive_pages(pages, str(tmp_path / "pages"), min_bytes)
    got = sorted(map(tuple, warc.archived_pages(spark, str(tmp_path / "pages")).collect()), key=repr)
    want, groups = [], {}
    for page_id, _, html in PAGES:
        groups.setdefault((html or "").encode(), []).append(page_id)
    for payload, ids in groups.items():
        ids.sort(key=lambda p: (p is None, p))
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for k, page_id in enumerate(ids):
            new = k == 0 or len(payload) < min_bytes
            want.append((page_id, len(payload), sha, "response" if new else "revisit", None if new else ids[0]))
    assert got == sorted(want, key=repr)


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.digest(empty).collect() == []
