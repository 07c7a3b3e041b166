"""Web archives: writing legacy ARC files, converting them to WARC, reading WARC back.

The converter reads what each ARC file says of itself: the version block names the version, which says how many
fields a record's header line has, and the last of them is the length in bytes of what follows. From these it
synthesises a WARC record: an identifier (a UUID from the record's own fields, equal at every attempt), the timestamp
in the WARC form, the type and the digest. Of records with equal payloads of at least `least` bytes, the one with the
smallest id is the response, the others revisit it.

Archives are written by Spark's text writer, so that any file system Spark knows will do, and a lost task is written again. A record
is a row and a gzip member of its own. Each file ends after ROLL bytes of records, so that files, which are read whole, have bounded sizes
however much a task writes. Contents are never shuffled: only digests are, and what they say of each file comes back to it by
broadcasts of at most MARKS revisits, in as many passes over different files as that takes.

Defined cases: a null html is an empty payload; a null url is the URI ``urn:none``, and white space in one is escaped. A record larger than
ROLL is a file of its own; Spark's limit for a value, 2 GB, is the limit of a payload. A page without a date has one that follows from its id.
A record with a null id is never the response of a group that has ids; records of a group without ids, or with the
smallest id more than once, are all responses. Tables may be empty and may have further columns; only id, url and html
are read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import delete_path, drop, looked_up, new_path, ship, written

#: The fields of a record's header line by version of the format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
ID_HEADER = "X-Page-Id"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
WARC_VERSION = "WARC/1.1"
#: Bytes of records after which a file ends; bytes of rows that are sent on at once.
ROLL, FLUSH = 1 << 26, 1 << 23
#: Revisits that are broadcast at once, with the identifiers of what they refer to.
MARKS = 500_000


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    block: bytes

    @property
    def http(self) -> tuple[bytes, bytes]:
        """Header and payload of an HTTP response; what isn't one is all payload."""
        head, end, body = self.block.partition(END)
        return (head + end, body) if end and head.startswith(b"HTTP/") else (b"", self.block)

    @property
    def page_id(self) -> str | None:
        found = re.search(rf"(?mi)^{ID_HEADER}: *(-?\d+)\r?$".encode(), self.http[0])
        return found[1].decode() if found else None


def member(record: bytes, level: int) -> bytes:
    """A gzip member without its last byte, which is the separator that the text writer adds: the highest byte of the length, 0 under 16 MiB. After a longer record comes an empty member, whose length is 0."""
    found = gzip.compress(record, level, mtime=0)
    return (found if not found[-1] else found + gzip.compress(b"", mtime=0))[:-1]


class Rolled:
    """Rows of gzip members with the number of the file, of those of this task, that each belongs to."""

    def __init__(self, start, most: int, level: int) -> None:
        self.start, self.most, self.level, self.roll, self.size, self.rows, self.waiting = start, most, level, -1, most, [], 0

    def add(self, record: bytes) -> Iterator[pa.RecordBatch]:
        if self.size and self.size + len(record) > self.most:
            self.roll, self.size = self.roll + 1, 0
            self.rows.append((member(self.start(self.roll), self.level), self.roll))
        row = member(record, self.level)
        self.rows.append((row, self.roll))
        self.size, self.waiting = self.size + len(record), self.waiting + len(row)
        if self.waiting >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            values, rolls = zip(*self.rows, strict=True)
            # bytes as a text column, whatever their encoding
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).view(pa.string()), pa.array(rolls, pa.int32())], names=["value", "roll"])
        self.rows, self.waiting = [], 0


def write_rolled(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("roll").text(path, lineSep="\0")


def archive_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(paths).select("path", "content")


def arc_header(version: int, url: str, ip: str, date: str, kind: str, length: int, status: str = "200") -> bytes:
    """A record's header line. The longer version has fields that aren't known here, a dash each."""
    values = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": status, "Archive-length": str(length)}
    return " ".join(values.get(field, "-") for field in FIELDS[version]).encode() + b"\n"


def arc_start(version: int, name: str, date: str) -> bytes:
    """The version block that an archive begins with."""
    body = f"{version} 0 vitrine\n{' '.join(FIELDS[version])}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body)) + body


def escaped(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "urn:none" if url else "urn:none"


def page_date(key) -> str:
    """Fourteen digits: some second of the ten years from 2000 on, by the id."""
    return time.strftime("%Y%m%d%H%M%S", time.gmtime(946_684_800 + zlib.crc32(str(key).encode()) % 315_360_000))


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str | None = None, roll: int = ROLL) -> None:
    """pages: page_id, url, html. Each record is an HTTP response that carries the id. date: of all records; else each has its own."""
    ship(pages.sparkSession)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rolled(lambda n: arc_start(version, f"pages-{n}.arc", date or "20000101000000") + b"\n", roll, 1)  # converted soon
        for batch in parts:
            for key, url, html in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"], strict=True):
                body = html.as_py() or b""
                own = "" if key is None else f"{ID_HEADER}: {key}\r\n"
                block = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{own}\r\n".encode() + body
                yield from out.add(arc_header(version, escaped(url), "0.0.0.0", date or page_date(key), "text/html", len(block)) + block + b"\n")
        yield from out.flush()

    write_rolled(pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(run, "value string, roll int"), path)


def unzipped(data: bytes) -> bytes:
    """Of a file of many members; read as a stream, as gzip.decompress copies all that is left after each of them."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, without its version block."""
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : len(data) if end < 0 else end].strip()
        at = len(data) if end < 0 else end + 1
        if not line:
            continue
        if line.startswith(b"filedesc://"):  # its second line, the block's first, begins with the version
            length = int(line.rsplit(b" ", 1)[1])
            version = int(data[at : at + length].split(None, 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} isn't known")
        else:
            values = line.decode("utf-8", "surrogateescape").rsplit(" ", len(FIELDS[version]) - 1)
            if len(values) != len(FIELDS[version]):
                raise ValueError(f"a header line of ARC version {version} has {len(FIELDS[version])} fields: {line[:200]!r}")
            length = int(values[-1])
            if at + length > len(data):
                raise ValueError(f"a record declares {length} bytes, {len(data) - at} are left: {line[:200]!r}")
            yield ArcRecord(values[0], values[1], values[2], values[3], data[at : at + length])
        at += length


def record_id(url: str, date: str, key: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date} {key} {url}'.encode('utf-8', 'replace').decode())}>"


def warc_date(date: str) -> str:
    """YYYYMMDDhhmmss, shorter ones filled, in the WARC form."""
    d = date + "00000101000000"[len(date) :] if len(date) < 14 else date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_info(name: str) -> bytes:
    """The record that an archive begins with."""
    body = b"software: vitrine\r\nformat: WARC File Format 1.1\r\n"
    lines = [WARC_VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id('warcinfo', name, None)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + END + body + END


def warc_record(record: ArcRecord, first: dict | None) -> bytes:
    """The WARC record of an ARC record. first: of the response that it revisits, page_id, record_id, uri and date."""
    head, body = record.http
    block = record.block if first is None else head
    lines = [WARC_VERSION, f"WARC-Type: {'revisit' if first else 'response' if head else 'resource'}", f"WARC-Record-ID: {record_id(record.url, record.date, record.page_id)}", f"WARC-Date: {warc_date(record.date)}", f"WARC-Target-URI: {record.url}", f"WARC-IP-Address: {record.ip}", f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}", f"X-Payload-Length: {len(body)}"]
    if first:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {first['record_id']}", f"WARC-Refers-To-Target-URI: {first['uri']}", f"WARC-Refers-To-Date: {first['date']}", f"X-Refers-To-Page: {first['page_id']}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else record.kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + END + block + END


def convert_arc(spark: SparkSession, arc: str, warc: str, least: int = 100, roll: int = ROLL) -> None:
    """Converts the ARC files of a folder to WARC files in another."""
    ship(spark)

    def index(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows = []
                for i, r in enumerate(parse_arc(unzipped(content.as_py()))):
                    body = r.http[1]
                    if len(body) >= least:
                        rows.append((i, int(r.page_id) if r.page_id else None, hashlib.sha256(body).digest(), record_id(r.url, r.date, r.page_id), r.url.encode("utf-8", "replace").decode(), warc_date(r.date)))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["path", "place", "page_id", "digest", "record_id", "uri", "date"])

    files = archive_files(spark, arc)
    records = written(files.mapInArrow(index, "path string, place long, page_id long, digest binary, record_id string, uri string, date string"), "arc-index")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id", "uri", "date"))
    groups = records.groupBy("digest").agg(F.count("*").alias("n"), F.min(named).alias("first")).filter("n > 1")
    again = looked_up(records.select("path", "place", "page_id", "digest"), "digest", groups).filter("first IS NOT NULL AND NOT (page_id <=> first.page_id)").select("path", "place", "first")
    again = written(again, "arc-revisits")

    def convert(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in parts:
            for path, content, marks in zip(batch["path"].to_pylist(), batch["content"], batch["again"].to_pylist(), strict=True):
                out = out or Rolled(lambda n, name=path.rsplit("/", 1)[-1]: warc_info(f"{name}-{n}.warc"), roll, 4)
                first = {m["place"]: m["first"] for m in marks or ()}
                for i, record in enumerate(parse_arc(unzipped(content.as_py()))):
                    yield from out.add(warc_record(record, first.get(i)))
        if out:
            yield from out.flush()

    passes = max(1, -(-again.count() // MARKS))
    for number in range(passes):
        part, marks = files, again
        if passes > 1:
            turn = F.pmod(F.xxhash64("path"), F.lit(passes)) == number
            names = [r["path"] for r in files.select("path").filter(turn).collect()]  # a name for every ROLL bytes: what Spark lists on the driver anyway
            if not names:
                continue
            part, marks = archive_files(spark, names), again.filter(turn)
        side = marks.groupBy("path").agg(F.collect_list(F.struct("place", "first")).alias("again"))  # at most the records of a file
        write_rolled(part.join(F.broadcast(side), "path", "left").mapInArrow(convert, "value string, roll int"), f"{warc}/pass-{number}")
    drop(records)
    drop(again)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, names in lower case, and block of each record."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.index(END, start)
        fields = dict(line.split(": ", 1) for line in data[start:end].decode("utf-8", "surrogateescape").split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        at = end + 4 + int(fields["content-length"])
        yield fields, data[end + 4 : at]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per response, revisit or resource: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_record, uri, date. A response whose payload isn't what its digest says is an error."""
    ship(spark)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        for batch in parts:
            for content in batch["content"]:
                rows = []
                for fields, block in parse_warc(unzipped(content.as_py())):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    record = ArcRecord("", "", "", "", block)
                    digest, length = fields["warc-payload-digest"].partition(":")[2], int(fields["x-payload-length"])
                    if kind != "revisit" and (hashlib.sha256(record.http[1]).hexdigest(), len(record.http[1])) != (digest, length):
                        raise ValueError(f"payload and digest differ: {fields}")
                    first = fields.get("x-refers-to-page")
                    rows.append((record.page_id and int(record.page_id), length, digest, kind, first and int(first), fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-target-uri"].encode("utf-8", "replace").decode(), fields["warc-date"]))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record", "uri", "date"])

    return archive_files(spark, path).select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, uri string, date string")


def archive(pages: DataFrame, version: int = 1, least: int = 100, date: str | None = None, roll: int = ROLL) -> DataFrame:
    """Writes pages as ARC, converts that to WARC, and reads the WARC files back."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, version, date, roll)
    convert_arc(spark, arc, warc, least, roll)
    delete_path(spark, arc)
    return read_warc(spark, warc)
