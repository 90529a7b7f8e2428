"""Page archives: whole-file gzip streams, rewritten as a gzip member per record with a sidecar index of offsets.

Writing is plain Spark: a record is a column of text, records that Spark's
text writer parts by the blank lines that end a WARC record, and its gzip codec
makes each file one stream from the first record to the last. Such a file can
only be read from its start. `normalise` inflates each stream once, in pieces,
writes every record as a gzip member of its own and notes where it lies; a
record is then read from its offset alone. Archives and index are files and a
table in a folder that Spark's own writers reach; nothing uses local paths.

Of records with equal payloads the one with the largest id is a response, the
others are revisits: they carry the response's id, the digest and HTTP headers,
whose Content-Length is that of the full payload, but no payload.

Sizes: a file holds what one scan task reads (spark.sql.files.maxPartitionBytes)
and at most `Warc.records` records; a normalised archive is one value, so
it must fit a task's memory and 2 GB. Payload groups may be of any size: ids are
aggregated on the map side and come back by a salted join.

Defined results: a null payload is an empty one, and empty payloads are
equal; among equal payloads null ids are smaller than others, rows that
repeat the largest id are all responses, and null ids alone are all
responses; a null url is left out of its record; an empty table gives no
archives and an empty table. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, hot_keys, salted_join

#: base32, the end of a record, and an empty gzip member, which ends an archive.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = b"\r\n\r\n"
LAST_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


@dataclass(frozen=True)
class Warc:
    #: Most records in a file.
    records: int = 20_000
    #: Payloads of fewer bytes are always responses.
    least_bytes: int = 0
    date: str = "1970-01-01T00:00:00Z"
    level: int = 6
    #: Bytes that are inflated at once.
    piece: int = 1 << 20


def sha1_base32(payload: Column) -> Column:
    """SHA-1 as 32 letters: five hexadecimal digits are four letters."""
    digits = F.sha1(payload)
    letters = []
    for k in range(8):
        number = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, s).bitwiseAND(31) + 1, 1) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def plan_records(pages: DataFrame, scratch: Scratch, p: Warc = Warc(), id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("__sha"))
    marks = rows.where(F.col("payload_bytes") >= p.least_bytes).select("__sha", "page_id")
    # Only payloads that more than one row has; the others are responses anyway. As a table they have a known size, so payloads are shuffled only if they are many.
    top = scratch.settle(marks.groupBy("__sha").agg(F.max("page_id").alias("__top"), F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    settled = salted_join(rows, top, ["__sha"], hot_keys(marks, ["__sha"]), ["page_id", "url"], "left")
    again = F.col("__top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__top")) & (F.col("payload_bytes") >= p.least_bytes)
    return settled.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        sha1_base32(F.col("payload").cast("binary")).alias("payload_digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("__top")).alias("refers_to"),
    )


def record(p: Warc = Warc()) -> Column:
    """A planned row as a WARC record without the blank lines that end it."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    headers = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "),
        name(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {p.date}\r\n"),
        # A line break can't stand in a header.
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]+", " "), F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        length,
        F.lit("\r\n\r\n"),
    )
    return F.concat(headers, block)


def write_streams(planned: DataFrame, path: str, p: Warc = Warc()) -> None:
    """Write archives that are one gzip stream each."""
    options = {"compression": "gzip", "lineSep": END.decode(), "maxRecordsPerFile": p.records}
    planned.select(record(p).alias("value")).write.options(**options).text(path)


# --- records of a stream --------------------------------------------------------------


def _inflated(raw: bytes, piece: int) -> Iterator[bytes]:
    """The bytes of one gzip stream or of members one after the other, a piece at a time."""
    while raw:
        stream, rest = zlib.decompressobj(31), raw
        while rest and not stream.eof:
            yield stream.decompress(rest, piece)
            rest = stream.unconsumed_tail
        if not stream.eof:
            raise ValueError("the gzip stream is cut off")
        raw = stream.unused_data


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {"": lines[0]} | {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if x)}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes, blank lines included, of each record of an inflated archive."""
    held, ended = bytearray(), False
    need: tuple[dict[str, str], int] | None = None
    while True:
        if need is None and (at := held.find(END)) >= 0:
            headers = parse_headers(bytes(held[:at]))
            if not headers[""].startswith("WARC/"):
                raise ValueError("not a WARC record")
            need = headers, at + len(END) + int(headers["content-length"]) + len(END)
        if need and len(held) >= need[1]:
            yield need[0], bytes(held[: need[1]])
            del held[: need[1]]
            need = None
            continue
        if ended:
            if held:
                raise ValueError("the last record is cut off")
            return
        if (new := next(pieces, None)) is None:
            ended = True
        else:
            held += new


def member(whole: bytes, level: int) -> bytes:
    """One gzip member without a time or a name, so equal records give equal bytes."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(whole) + deflate.flush()


def facts(headers: dict[str, str], whole: bytes) -> tuple[int | None, str, int | None, int, str]:
    """page_id, record_type, refers_to, payload_bytes, payload_digest. A response's payload is measured and must have the digest in its headers."""
    number = lambda x: None if x in (None, "<urn:page:none>") else int(x[len("<urn:page:") : -1])
    block = whole[len(whole) - len(END) - int(headers["content-length"]) : len(whole) - len(END)]
    at = block.index(END)
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(parse_headers(block[:at])["content-length"])
    if headers["warc-type"] == "response":
        payload = block[at + len(END) :]
        if (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
            raise ValueError(f"the payload of {headers['warc-record-id']} isn't what was written")
    return number(headers["warc-record-id"]), headers["warc-type"], number(headers.get("warc-refers-to")), size, digest


# --- normalising and reading ----------------------------------------------------------


def _normalise(batches: Iterator[pa.RecordBatch], p: Warc) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            out = bytearray()
            for _, whole in split_records(_inflated(batch.column("content")[i].as_py(), p.piece)):
                out += member(whole, p.level)
            yield pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], names=["members"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each member of an archive lies and what its record says."""
    schema = pa.schema([(n, pa.string() if kind == "string" else pa.int64()) for n, kind in (x.split() for x in INDEX.split(", "))])
    for batch in batches:
        for i in range(batch.num_rows):
            raw, name, at, rows = batch.column("content")[i].as_py(), batch.column("archive")[i].as_py(), 0, []
            view = memoryview(raw)
            while at < len(raw):
                record, size = read_member(view[at:])
                if record:
                    headers, whole = record
                    rows.append((name, at, size, *facts(headers, whole)))
                at += size
            if not raw.endswith(LAST_MEMBER):
                raise ValueError(f"{name} is cut off")
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def read_member(raw: memoryview | bytes, piece: int = 1 << 16) -> tuple[tuple[dict[str, str], bytes] | None, int]:
    """The record of the member at the start of raw, None if it is empty, and the member's length."""
    stream, whole, at = zlib.decompressobj(31), bytearray(), 0
    while not stream.eof:
        if at >= len(raw):
            raise ValueError("the member is cut off")
        whole += stream.decompress(raw[at : at + piece])
        at += piece
    size = min(at, len(raw)) - len(stream.unused_data)
    return next(split_records(iter([bytes(whole)])), None), size


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("archive"), "content")


def normalise(spark: SparkSession, streams: str, path: str, p: Warc = Warc()) -> DataFrame:
    """Rewrite the archives in the folder `streams` to path/archives, write their index to path/index and return it.

    A stream is inflated once. The index is read off the finished archives, whose names Spark's writer has given by then:
    each member is inflated and checked against its digest, and its end shows where the next one begins.
    """
    packed = _files(spark, streams).mapInArrow(lambda it: _normalise(it, p), "members binary")
    # A file for each row; its last member is empty, so a file that was cut off shows.
    options = {"compression": "none", "lineSep": LAST_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1", "maxRecordsPerFile": 1}
    packed.select(F.col("members").cast("string").alias("value")).write.options(**options).text(f"{path}/archives")
    _files(spark, f"{path}/archives").mapInArrow(_members, INDEX).write.option("compression", "zstd").parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """page_id and payload of the pages in wanted(page_id); a revisit has the payload of the response it refers to.

    Only members that the index names are inflated, each at its offset. Offsets meet their archive by its name.
    """
    index = read_index(spark, path)
    asked = wanted.select("page_id").distinct().join(index, "page_id").select("page_id", F.coalesce("refers_to", "page_id").alias("at"))
    # One response for each asked id: copies under one id are alike.
    held = index.where("record_type = 'response'").groupBy(F.col("page_id").alias("at")).agg(F.min(F.struct("archive", "offset", "length")).alias("m"))
    places = asked.select("at").distinct().join(held, "at").groupBy("m.archive").agg(F.collect_list(F.struct("at", "m.offset", "m.length")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, payloads = [], []
            for raw, members in zip(batch.column("content"), batch.column("members").to_pylist()):
                view = memoryview(raw.as_buffer())
                for m in members:
                    headers, whole = read_member(view[m["offset"] : m["offset"] + m["length"]])[0]
                    facts(headers, whole)
                    block = whole[len(whole) - len(END) - int(headers["content-length"]) : len(whole) - len(END)]
                    ids.append(m["at"])
                    payloads.append(block[block.index(END) + len(END) :].decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(payloads, pa.string())], names=["at", "payload"])

    found = _files(spark, f"{path}/archives").join(places, "archive").mapInArrow(run, "at long, payload string")
    return asked.join(found, "at").select("page_id", "payload")


def archive_pages(pages: DataFrame, params: Warc = Warc(), id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The index of archives of all pages: written as streams, normalised and read back. One row per page; INDEX has the columns."""
    scratch = Scratch(pages.sparkSession, "warc")
    write_streams(plan_records(pages, scratch, params, id_col, url_col, payload_col), f"{scratch.root}/streams", params)
    return normalise(pages.sparkSession, f"{scratch.root}/streams", scratch.root, params)
