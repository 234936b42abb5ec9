import base64
import glob
import gzip
import hashlib
import io
import struct

import duckdb
import pytest

from pyspark.sql.datasource import EqualTo, GreaterThan

from millrace.llm import warc

from .conftest import same

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
PAGES = [
    (5, "http://a/5", "<p>same</p>"),
    (3, "http://a/3\r\nX: y", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (1, "http://a/1", None),
    (2, "http://a/2", ""),
    (4, "http://a/4", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\né漢🌍\0\0"),
    (6, "http://a/6", "long " * 300_000),
]


def brute(pages):
    first = {}
    for page, _, html in pages:
        first[html or ""] = min(page, first.get(html or "", page))
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    return [(p, len((h or "").encode()), digest(h or ""), "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""]) for p, _, h in pages]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, payload string, first string")


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, pages, tmp_path, compress):
    warc.write_warc(pages, f"{tmp_path}/w", compress=compress)
    archive = warc.read_warc(spark, f"{tmp_path}/w")
    same(warc.digest_rows(archive), brute(PAGES), COLUMNS)
    payloads = {r["record_id"]: bytes(r["payload"]) for r in archive.where("record_type = 'response'").collect()}
    assert payloads["<urn:millrace:page:4>"].decode() == PAGES[5][2] and len(payloads["<urn:millrace:page:6>"]) == 1_500_000
    heads = {r["record_id"]: r["headers"] for r in archive.collect()}
    assert heads["<urn:millrace:page:3>"]["warc-target-uri"] == "http://a/3%0D%0AX: y" and "warc-target-uri" not in heads["<urn:millrace:page:9>"]


def test_members_are_plain_gzip(spark, pages, tmp_path):
    warc.write_warc(pages, f"{tmp_path}/w")
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/w/part-*"))
    assert data.count(b"WARC/1.1\r\nWARC-Type:") == len(PAGES)
    for f in glob.glob(f"{tmp_path}/w/part-*"):  # an archive without skip lengths
        whole = gzip.open(f).read()
        with open(f"{tmp_path}/{f.rpartition('/')[2]}.one.gz", "wb") as out:
            out.write(gzip.compress(whole))
    same(warc.digest_rows(warc.read_warc(spark, f"{tmp_path}").where("record_id is not null")).distinct(), brute(PAGES), COLUMNS)


def test_predicates_are_pushed_and_payloads_left(spark, pages, tmp_path):
    path = f"{tmp_path}/w"
    warc.write_warc(pages, path)
    archive = warc.read_warc(spark, path)
    tests = [("record_type = 'revisit'", 3), ("record_id in ('<urn:millrace:page:4>', 'x')", 1), ("target_uri is null", 1), ("target_uri like 'http://a/%'", 6), ("refers_to is not null", 3), ("payload_length > 1000000", 1)]
    for test, n in tests:
        assert archive.where(test).count() == n
    assert archive.where("record_type = 'revisit'").unionByName(archive).count() == 3 + len(PAGES)
    assert [warc.read_warc(spark, path, where=w).count() for w in ({"record_type": "revisit"}, {"target_uri": None}, {"record_id": ["<urn:millrace:page:4>", "x"], "record_type": "response"})] == [3, 1, 1]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for test, n in tests:
            assert spark.read.format("warc").option("pushdown", "true").load(path).where(test).count() == n
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = warc.PushingReader({"path": path})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 3
    with pytest.raises(ValueError, match="no header column"):
        warc.WarcReader({"path": path, "where": '{"payload": "x"}'})
    heads = warc.read_warc(spark, path, payload=False)
    assert heads.where("payload is not null").count() == 0
    same(warc.digest_rows(heads), brute(PAGES), COLUMNS)


def test_repeated_and_null_pages(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "u", "x"), (1, "v", "x"), (None, "u", "x"), (2, "u", "y"), (2, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.typed(pages).select("page_id", "record_type", "refers_to").collect()
    assert sorted(r["record_type"] for r in got) == ["response"] * 3 + ["revisit"] * 3
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {1}
    assert [r["record_type"] for r in warc.typed(pages, least=2).collect()] == ["response"] * 6
    empty = pages.limit(0)
    warc.write_warc(empty, f"{tmp_path}/w")
    assert warc.read_warc(spark, f"{tmp_path}/w").count() == 0


def test_oracle(spark, small):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS FROM '{small}/pages.parquet'")
    same(warc.op4_warc(spark, small), duckdb.sql(warc.SQL).fetchall(), COLUMNS)


def test_what_is_no_record_fails(tmp_path):
    (tmp_path / "bad").write_bytes(b"not an archive\r\n\r\n")
    reader = warc.WarcReader({"path": str(tmp_path / "bad")})
    with pytest.raises(ValueError, match="no WARC record"):
        list(reader.read(reader.partitions()[0]))


def record(page, body):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:millrace:page:%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (page, len(block)) + block + b"\r\n\r\n"


def read(data, **options):
    return [(r[1], r[9]) for r in warc.records(io.BufferedReader(io.BytesIO(data)), **options)]


def test_members_of_any_kind_in_one_archive():
    """With skip lengths, without, several records in a member, empty members, and a name field in a header."""
    named = io.BytesIO()
    with gzip.GzipFile("name", "wb", fileobj=named) as f:
        f.write(record(3, b"c" * 200_000))
    data = warc.member(record(1, b"a")) + gzip.compress(record(2, b"b" * 70_000) + record(4, b"")) + gzip.compress(b"") + warc.EMPTY + named.getvalue() + warc.member(record(5, b"e"))
    want = [(f"<urn:millrace:page:{k}>", body) for k, body in ((1, b"a"), (2, b"b" * 70_000), (4, b""), (3, b"c" * 200_000), (5, b"e"))]
    assert read(data) == want
    assert read(data, payload=False) == [(k, None) for k, _ in want]
    assert read(data, wanted=lambda row: row["record_id"].endswith(":5>")) == want[-1:]
    assert read(b"") == []


@pytest.mark.parametrize("payload", [True, False])
def test_an_archive_cut_anywhere_ends_with_an_error(payload):
    body = bytes(range(256)) * 4
    for whole in (record(1, body), gzip.compress(record(1, body)), warc.member(record(1, body))):
        for cut in range(1, len(whole) - 4, 7):
            with pytest.raises((EOFError, ValueError)):
                read(record(7, b"x") * (whole[:1] == b"W") + whole[:cut], payload=payload)
    lying = bytearray(warc.member(record(1, body)))
    lying[16:20] = struct.pack("<I", len(lying) + 1000)
    with pytest.raises((EOFError, ValueError)):
        read(bytes(lying), payload=payload)


def test_hot_payloads_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 2)
    pages = [(k, f"u{k}", "abc"[min(k % 7, 2)] if k % 3 else f"own{k // 2 * 2}") for k in range(300)]
    same(warc.typed(spark.createDataFrame(pages, "page_id long, url string, html string")), brute(pages), COLUMNS)
