r"""WARC archives: a writer, and a Python data source that plans files, prunes by headers and skips payloads.

Archives are gzip members, one a record, as usual for .warc.gz. Each member's header has the skip lengths ("sl") that the
standard's annex on compression describes, so that a reader can leave a member before it has inflated the payload.

Writing: every row of pages becomes a WARC/1.1 record. Of records with equal payloads of at least `least` bytes the one
with the smallest page_id is a response that holds the payload and the others are revisits that refer to it. Spark's own
writer stores the records, so any file system will do and lost tasks leave nothing behind.

Reading (`spark.read.format("warc")`): the files are planned into partitions by size. Predicates on record_type, target_uri,
record_id, refers_to, payload_digest and warc_date are pushed down, those of read_warc's `where` always, and a query's
filters with option pushdown and the session's spark.sql.python.filterPushdown.enabled. (That isn't the default: Spark keeps
the filters last pushed with the loaded source, so a DataFrame that one plan uses twice, with other filters each time, gets
wrong rows.) A
record's header block is parsed first, and of records that a predicate rejects, and of all when option payload is false,
the block is skipped, by the member's packed length or, in plain archives, by Content-Length, and never decoded.
Members without skip lengths are inflated to their end. Files are planned whole and never split, as a member's begin can't be told from
within a file; archives are usually of a GB at most. An archive that ends within a record, or has something else where one should
begin, is an error that names it. op4_warc reads revisits by their headers alone and payloads of responses only.

Defined results: a null html is an empty payload and an empty payload is a payload like others. Of repeated page_ids with
equal payloads one is the response (the first by warc order is not defined, but exactly one is) and all report it. A null
url is left out of the header. Line breaks in a url are percent-encoded. An empty table gives an empty result. Further
columns are ignored. A null page_id sorts last.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith

from millrace.llm.common import Scratch, pick, table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Partitions are filled with whole files up to this many bytes, and the writer closes files at about as many records.
SPLIT_BYTES, FILE_RECORDS = 64 << 20, 20_000
#: The payloads that most pages share, so many at most, are told to all tasks.
HOT = 1 << 12
END = "\r\n"
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_length long, content_length long, headers map<string,string>, payload binary"


def base32_sha1(data):
    """Bare upper-case base32 of the SHA-1 of a column, by its hex digits: five make four letters."""
    hexed, out = F.sha1(data), []
    for k in range(0, 40, 5):
        n = F.conv(F.substring(hexed, k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(31) + 1, 1) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def typed(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload (string), payload_bytes, payload_digest, record_type, refers_to."""
    p = pick(pages, page_id=page_id, url=url, payload=html).withColumn("payload", F.coalesce("payload", F.lit("")))
    scratch = Scratch(pages.sparkSession, "warc-types")
    rows = p.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload").cast("binary")).alias("payload_digest"), F.sha2("payload", 256).alias("same"))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id")
    first = rows.groupBy("same").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = scratch.keep(first.select("same", F.col("first.page_id").alias("first"), F.lit(True).alias("shared"), "n"), "first")
    # Payloads of very many pages, HOT at most, are broadcast; their rows, and all that share nothing, are spread by themselves in the other join.
    often = F.broadcast(first.orderBy(F.desc("n"), "same").limit(HOT).select(F.col("same").alias("_often"), F.col("first").alias("_first")))
    rows = rows.join(often, F.col("same") == F.col("_often"), "left")
    key = F.when(F.col("_often").isNull(), F.col("same")).otherwise(F.concat("same", F.lit("/"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("_key", key).join(first.select(F.col("same").alias("_key"), "first", "shared"), "_key", "left").drop("_key")
    rows = rows.withColumn("first", F.coalesce("first", "_first")).withColumn("shared", F.coalesce("shared", F.col("_often").isNotNull())).drop("_often", "_first")
    # Of rows that repeat the first page_id, one holds the payload; only those that share it are numbered.
    again = rows.where("shared").groupBy("same", "page_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("same").alias("_s"), F.col("page_id").alias("_p"), F.lit(True).alias("twice"))
    again, nth = scratch.keep(again, "again"), F.lit(1)
    if not again.isEmpty():
        rows = rows.join(again, (F.col("same") == F.col("_s")) & F.col("page_id").eqNullSafe(F.col("_p")), "left")
        nth = F.when(F.col("twice"), F.row_number().over(W.partitionBy("same", "page_id").orderBy("url"))).otherwise(1)
    revisit = F.coalesce("shared", F.lit(False)) & (F.col("payload_bytes") >= least) & (~F.col("page_id").eqNullSafe(F.col("first")) | (nth > 1))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record(date: str = "2024-01-01T00:00:00Z"):
    """The record of a typed row as a column, without the two line breaks that end it."""
    head = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:millrace:page:"), c.cast("string"), F.lit(">"))
    response = F.col("record_type") == "response"
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.when(response, F.concat(http, F.col("payload"))).otherwise("")
    return F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.col("record_type"), F.lit(END),
        head("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:millrace:page:null>"))), head("WARC-Target-URI", uri), F.lit(f"WARC-Date: {date}{END}"),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(END), head("WARC-Refers-To", urn(F.col("refers_to"))),
        F.when(response, "").otherwise(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}"),
        F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(END + END), block,
    )


def member(data: bytes) -> bytes:
    """A gzip member with skip lengths, and a zero byte at its end."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    lengths = struct.pack("<II", FRAME + len(body), len(data) & 0xFFFFFFFF)
    out = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl\x08\0" + lengths + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return out if out[-1] == 0 else out + EMPTY


#: A member's bytes besides its deflated body: header, extra field and trailer.
FRAME = 10 + 2 + 12 + 8
EMPTY = b"\x1f\x8b\x08\0\0\0\0\0\0\xff\x03" + bytes(9)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [member(x.as_buffer().to_pybytes() + b"\r\n\r\n")[:-1] for x in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])


def write_warc(pages: DataFrame, path: str, least: int = 0, compress: bool = True, **columns: str) -> None:
    """The text writer puts its line separator after each value: the end of a plain record, or the zero byte that ends a member."""
    rows = typed(pages, least, **columns).select(record().alias("value"))
    if compress:
        rows = rows.select(F.col("value").cast("binary")).mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", "\0" if compress else END + END).option("maxRecordsPerFile", FILE_RECORDS).mode("overwrite").text(path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


_COLUMN = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.payload = options.get("payload", "true").lower() != "false"
        self.filters: list[tuple[str, str, Any]] = []
        for name, value in json.loads(options.get("where") or "{}").items():
            if name not in _COLUMN:
                raise ValueError(f"no header column {name!r}")
            self.filters.append(("IsNull" if value is None else "In" if isinstance(value, list) else "EqualTo", name, value))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _system(self.path)
        infos = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        hidden = lambda x: any(p[:1] in ("_", ".") for p in x.path[len(root) :].split("/"))
        files = sorted(((x.size, x.path) for x in infos if x.type == fs.FileType.File and x.size and not hidden(x)), key=lambda x: (-x[0], x[1]))
        out, room = [], 0
        for size, path in files:
            if not out or size > room:
                out.append([])
                room = self.split
            out[-1].append(path)
            room -= size
        return [Files(x) for x in out] or [Files([])]

    def _wanted(self, row: dict[str, str | None]) -> bool:
        test = {"EqualTo": lambda a, b: a is not None and a == b, "In": lambda a, b: a is not None and a in b, "IsNull": lambda a, b: a is None, "IsNotNull": lambda a, b: a is not None, "StringStartsWith": lambda a, b: a is not None and a.startswith(b)}
        return all(test[kind](row[name], value) for kind, name, value in self.filters)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                yield from records(io.BufferedReader(raw, 1 << 20), self._wanted, self.payload)


class PushingReader(WarcReader):
    """Takes a query's own filters too."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in _COLUMN and isinstance(f, (EqualTo, In, IsNull, IsNotNull, StringStartsWith)):
                self.filters.append((type(f).__name__, name, getattr(f, "value", None)))
            else:
                yield f


def _headers(block: bytes) -> dict[str, str]:
    """The fields after the version line, by lower-case name."""
    version, *lines = block.split(b"\n")
    if not version.startswith(b"WARC/"):
        raise ValueError(f"no WARC record where one should begin: {version[:40]!r}")
    fields = (x.partition(b":") for x in lines if x.strip())
    return {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in fields}


def _filtered(head: dict[str, str]) -> dict[str, str | None]:
    row = {name: head.get(key) for name, key in _COLUMN.items()}
    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
    return row


def _row(head: dict[str, str], row: dict[str, str | None], body: bytes | None) -> tuple:
    if body is not None and "application/http" in head.get("content-type", ""):
        body = body.partition(b"\r\n\r\n")[2]
    declared = head.get("x-payload-length")
    return (*(row[c] for c in ("record_type", "record_id", "target_uri", "warc_date", "payload_digest", "refers_to")), int(declared) if declared else None, int(head.get("content-length", 0)), head, body)


def _exactly(f, n: int) -> bytes:
    """n bytes, or an error: an archive that ends within a record is never waited for."""
    data = f.read(n)
    if len(data) < n:
        raise EOFError(f"the archive ends {n - len(data)} bytes before a record does")
    return data


def records(f, wanted=lambda row: True, payload: bool = True) -> Iterator[tuple]:
    """The rows of an open archive; f must seek. Each gzip member tells for itself whether it has skip lengths; empty members are passed."""
    start = f.read(2)
    f.seek(0)
    if start != b"\x1f\x8b":
        yield from _plain(f, wanted, payload)
        return
    while begin := f.read(24):
        if begin[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member where one should begin: {begin[:10]!r}")
        if len(begin) == 24 and begin[3] == 4 and begin[10:16] == b"\x0c\0sl\x08\0":
            yield from _packed(f, struct.unpack("<I", begin[16:20])[0] - FRAME, wanted, payload)
        else:
            f.seek(-len(begin), io.SEEK_CUR)
            yield from _member(f, wanted, payload)


def _member(f, wanted, payload: bool) -> Iterator[tuple]:
    """A gzip member without skip lengths: inflated as a stream, and left where it ends."""
    inflate = zlib.decompressobj(31)

    class Stream(io.RawIOBase):
        readable = lambda self: True

        def readinto(self, into) -> int:
            text = b""
            while not text and not inflate.eof:
                text = inflate.decompress(inflate.unconsumed_tail or _exactly(f, 1) + f.read(1 << 16), len(into))
            into[: len(text)] = text
            return len(text)

    yield from _plain(io.BufferedReader(Stream(), 1 << 16), wanted, payload)
    f.seek(-len(inflate.unused_data), io.SEEK_CUR)


def _plain(f, wanted, payload: bool) -> Iterator[tuple]:
    while line := f.readline():
        if not line.strip():
            continue
        block = line
        while (line := f.readline()).strip():
            block += line
        if not line:
            raise EOFError("the archive ends within a header")
        head = _headers(block)
        row, length = _filtered(head), int(head.get("content-length", 0))
        fits = wanted(row)
        if fits and payload and row["record_type"] != "revisit":
            yield _row(head, row, _exactly(f, length))
        else:
            _skipped(f, length)
            if fits:
                yield _row(head, row, None)


def _skipped(f, n: int) -> None:
    """Pass n bytes and see that they are there."""
    if n and f.seekable():
        f.seek(n - 1, io.SEEK_CUR)
        n = 1
    while n:
        n -= len(_exactly(f, min(n, 1 << 16)))


def _packed(f, left: int, wanted, payload: bool) -> Iterator[tuple]:
    """The member whose deflated body, of `left` bytes, comes next."""
    inflate, text = zlib.decompressobj(-15), b""
    while (cut := text.find(b"\r\n\r\n")) < 0 and left > 0:
        part = _exactly(f, min(left, 1024))
        left -= len(part)
        text += inflate.decompress(part)
    if cut < 0:
        raise ValueError("a WARC record without the end of its header")
    head = _headers(text[:cut])
    row = _filtered(head)
    fits = wanted(row)
    if fits and payload and row["record_type"] != "revisit":
        text += inflate.decompress(_exactly(f, left)) + inflate.flush()
        left, length = 0, int(head.get("content-length", 0))
        if len(text) < cut + 4 + length:
            raise EOFError("a WARC record shorter than its Content-Length")
        yield _row(head, row, text[cut + 4 : cut + 4 + length])
    elif fits:
        yield _row(head, row, None)
    _skipped(f, left + 8)


class WarcSource(DataSource):
    """Options: path; payload (false: blocks are skipped); where (JSON, as for read_warc); pushdown (true: a query's filters too); splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushingReader if options.get("pushdown") == "true" else WarcReader)(options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, where: dict[str, str | list[str] | None] | None = None) -> DataFrame:
    """where: the values that header columns must have (one, any of a list, or None), tested before a payload is read."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("where", json.dumps(where or {})).load(path)


def digest_rows(archive: DataFrame) -> DataFrame:
    """Per record: what its payload says if it has one, else what its headers say of the payload it refers to."""
    number = lambda c: F.regexp_extract(c, "page:(-?[0-9]+)>", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return archive.select(
        as_id(F.col("record_id")).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(base32_sha1(F.col("payload")), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        as_id(F.col("refers_to")).alias("refers_to"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").at("archive")
    write_warc(table(spark, sf_dir, "pages"), path)
    revisits = read_warc(spark, path, payload=False, where={"record_type": "revisit"})
    return digest_rows(read_warc(spark, path, where={"record_type": "response"}).unionByName(revisits))


_LETTER = "substr('" + ALPHABET + "', 1 + (({n} >> {s}) & 31), 1)"
_B32 = " || ".join(_LETTER.format(n=f"CAST('0x' || substr(h, {k}, 5) AS BIGINT)", s=s) for k in range(1, 41, 5) for s in (15, 10, 5, 0))
SQL = f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT page_id, p, h, min(page_id) OVER (PARTITION BY p) AS first FROM t)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM w
"""
