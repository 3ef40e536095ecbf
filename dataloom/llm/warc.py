"""WARC archives by way of a legacy archive converter.

ARC files start with a version block whose second line names the version and whose third line names the fields of
all header lines: version 1 has URL, IP-address, Archive-date, Content-type, Archive-length; version 2 adds
Result-code, Checksum, Location, Offset and Filename before the length. The converter reads a header line by the
fields that its file declares, takes as many bytes as the line declares, and synthesises the equivalent WARC record:
an identifier from file, offset and digest, a WARC-Date from the Archive-date, a type, and block and payload digests.
Of records with equal payloads of at least `revisit_bytes` bytes that of the largest page id (then file and offset)
is the response; the others become revisit records, which refer to it and hold the HTTP head alone.

Archives are written by Spark's text writer (a record and its separator are UTF-8 text) as gzip files in a folder
that the cluster shares, and read back as whole files, which the writer's partitions keep bounded.

Null html counts as an empty payload, a null URL as `urn:unknown`, a null page id as the least one; page ids of
another type than whole numbers are refused. Repeated rows are
records of their own. White space and control characters in a URL are percent-encoded. An empty table gives
archives without records and an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataloom.llm.common import checkpointed, salted_join

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Estimated bytes of decisions that are broadcast at most.
BROADCAST_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = "\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0  　]")


class GzipStream:
    """Reads a gzip file of any number of members from memory, without holding it decompressed."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.source, self.step, self.buffer, self.at = io.BytesIO(data), step, b"", 0
        self.engine = zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
        if self.engine.eof:
            data = data or self.source.read(self.step)
            if not data:
                return False
            self.engine = zlib.decompressobj(31)
        data = data or self.source.read(self.step)
        if not data:
            return False
        self.buffer = self.buffer[self.at :] + self.engine.decompress(data, self.step)
        self.at = 0
        return True

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at == len(self.buffer) and not self._more():
                break
            part = self.buffer[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def until(self, mark: bytes) -> bytes:
        """Bytes up to the mark, which is consumed; what is left if the mark never comes."""
        searched = 0
        while True:
            found = self.buffer.find(mark, self.at + searched)
            if found >= 0:
                out, self.at = self.buffer[self.at : found], found + len(mark)
                return out
            searched = max(0, len(self.buffer) - self.at - len(mark) + 1)
            if not self._more():
                out, self.buffer, self.at = self.buffer[self.at :], b"", 0
                return out


def arc_version_block(version: int, name: str, date: str) -> str:
    body = f"{version} 0 dataloom\n{ARC_FIELDS[version]}\n"
    if version == 1:
        return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n{body}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n{body}"


def http_head(page_id, payload_bytes: int) -> str:
    name = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}Content-Length: {payload_bytes}\r\n\r\n"


def _write_gzip(rows: DataFrame, folder: str, separator: str) -> None:
    """Records as gzip files, by zlib's fastest level: the default one takes most of the work's time."""
    rows.write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)


def write_arc(pages: DataFrame, folder: str, date: str = "20240101000000") -> None:
    """Writes one ARC file per partition; files of even partitions have version 1, the others version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name, offset = 1 + part % 2, f"part-{part:05d}.arc.gz", 0
        first = arc_version_block(version, name, date)
        for batch in batches:
            out = [first] if first else []
            offset += len(first) + 1 if first else 0
            first = ""
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                html = html or ""
                size = len(html.encode())
                head = http_head(page_id, size)
                uri = _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:unknown"
                extra = "" if version == 1 else f" 200 - - {offset} {name}"
                line = f"{uri} 0.0.0.0 {date} text/html{extra} {len(head) + size}\n"
                offset += len(line.encode()) + len(head) + size + 1
                out.append(line + head + html)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    kind = pages.schema["page_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"page_id is {kind}; archives name pages by whole numbers")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "value string")
    _write_gzip(rows, folder, "\n")


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, content) of every record but the version block of one gzipped ARC file."""
    stream, fields, offset = GzipStream(data), None, 0
    while line := stream.until(b"\n"):
        start, offset = offset, offset + len(line) + 1
        values = line.decode().split(" ")
        content = stream.read(int(values[-1]))
        offset += len(content) + 1
        stream.read(1)
        if len(content) != int(values[-1]):
            raise ValueError(f"ARC record at {start} ends early")
        if fields is None:
            if not values[0].startswith("filedesc:"):
                raise ValueError("an ARC file starts with a version block")
            version, names = content.decode().split("\n")[:2]
            if int(version.split(" ")[0]) not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = names.split(" ")
            continue
        if len(values) != len(fields):
            raise ValueError(f"ARC header at {start} has {len(values)} of {len(fields)} fields")
        yield start, dict(zip(fields, values)), content


def read_arc(spark: SparkSession, folder: str, contents: bool = True) -> DataFrame:
    """Rows (file, offset, uri, archive_date, page_id, head, payload, payload_bytes, digest); head and payload are null without contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file, rows, held = path.rsplit("/", 1)[-1], [], 0
                for offset, header, content in arc_records(data):
                    head, _, payload = content.partition(b"\r\n\r\n")
                    named = re.search(rb"X-Page-Id: (-?\d+)", head)
                    rows.append((file, offset, header["URL"], header["Archive-date"], int(named[1]) if named else None, head.decode() if contents else None, payload.decode() if contents else None, len(payload), hashlib.sha1(payload).hexdigest()))
                    held += len(content)
                    if held >= 4 << 20:
                        yield _batch(rows, _ARC_COLUMNS)
                        rows, held = [], 0
                yield _batch(rows, _ARC_COLUMNS)

    return _files(spark, folder).mapInArrow(run, "file string, offset long, uri string, archive_date string, page_id long, head string, payload string, payload_bytes long, digest string")


_ARC_COLUMNS = [("file", pa.string()), ("offset", pa.int64()), ("uri", pa.string()), ("archive_date", pa.string()), ("page_id", pa.int64()), ("head", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string())]
_WARC_COLUMNS = [("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string())]


def _batch(rows: list[tuple], columns: list[tuple]) -> pa.RecordBatch:
    values = list(zip(*rows)) if rows else [[] for _ in columns]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, columns)], [n for n, _ in columns])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content")


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record_id(file: str, offset: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}/{offset}/{digest}')}>"


def arc_to_warc(spark: SparkSession, arc_folder: str, warc_folder: str, revisit_bytes: int = 1000) -> None:
    """Converts all ARC files of a folder to WARC files, one per partition.

    What revisits what is decided on narrow rows without payloads, in joins that a payload of a third of all pages does
    not make uneven. The decisions go to the records by file and offset: broadcast while they take at most
    `BROADCAST_BYTES`, else in a join whose keys are all different.
    """
    narrow = read_arc(spark, arc_folder, contents=False)
    large = narrow.where(F.col("payload_bytes") >= revisit_bytes).withColumn("content", F.concat_ws(":", "digest", "payload_bytes"))
    # a group of one needs no entry; the greatest (page id, file, offset) of the others is the original
    original = F.max(F.struct("page_id", "file", "offset", "uri", "archive_date"))
    originals = checkpointed(large.groupBy("content").agg(original.alias("o"), F.count("*").alias("n")).where("n > 1").select("content", "o"))
    revisits = salted_join(large.select("content", "file", "offset"), originals, "content", F.struct("file", "offset")).where("file <> o.file or offset <> o.offset")
    revisits = checkpointed(revisits.select("file", "offset", F.lit(True).alias("revisit"), F.col("o.file").alias("o_file"), F.col("o.offset").alias("o_offset"), F.col("o.uri").alias("o_uri"), F.col("o.archive_date").alias("o_date")))
    size = revisits.agg(F.sum(F.lit(200) + F.octet_length("file") + F.octet_length("o_file") + F.octet_length("o_uri"))).first()[0] or 0
    rows = read_arc(spark, arc_folder).join(F.broadcast(revisits) if size <= BROADCAST_BYTES else revisits, ["file", "offset"], "left")
    rows = rows.withColumn("revisit", F.coalesce("revisit", F.lit(False))).withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    rows = rows.select("file", "offset", "uri", "archive_date", "head", "payload", "digest", "revisit", "o_file", "o_offset", "o_uri", "o_date")

    def warc_date(arc_date: str) -> str:
        d = arc_date
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = "software: dataloom\r\nformat: WARC File Format 1.1\r\n"
        part = TaskContext.get().partitionId()
        first = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(warc_folder, part, '')}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}"
        for batch in batches:
            out = [first] if first else []
            first = ""
            for file, offset, uri, date, head, payload, digest, is_revisit, o_file, o_offset, o_uri, o_date in zip(*(c.to_pylist() for c in batch.columns)):
                block = f"{head}{SEPARATOR}{'' if is_revisit else payload}"
                data = block.encode()
                lines = [
                    "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(file, offset, digest)}",
                    f"WARC-Date: {warc_date(date)}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{_base32(digest)}",
                    f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(data).hexdigest())}", "Content-Type: application/http;msgtype=response",
                ]
                if is_revisit:
                    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(o_file, o_offset, digest)}", f"WARC-Refers-To-Target-URI: {o_uri}", f"WARC-Refers-To-Date: {warc_date(o_date)}"]
                out.append("\r\n".join([*lines, f"Content-Length: {len(data)}", "", block]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    _write_gzip(rows.mapInArrow(run, "value string"), warc_folder, SEPARATOR)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of one gzipped WARC file, by declared lengths."""
    stream = GzipStream(data)
    while head := stream.until(b"\r\n\r\n"):
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record ends early")
        yield fields, block


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all response and revisit records; digests are recomputed from the bytes and compared.

    payload_bytes and payload_digest (hex) are those of the full payload, for revisits from their HTTP head and
    header field; `refers_to_record` is the identifier of the original.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                rows = []
                for fields, block in warc_records(data):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    if fields["WARC-Block-Digest"] != f"sha1:{_base32(hashlib.sha1(block).hexdigest())}":
                        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                    if fields["WARC-Type"] == "response":
                        if digest != hashlib.sha1(payload).hexdigest():
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                        size = len(payload)
                    else:
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    named = re.search(rb"X-Page-Id: (-?\d+)", head)
                    rows.append((fields["WARC-Record-ID"], fields["WARC-Type"], int(named[1]) if named else None, fields["WARC-Target-URI"], fields["WARC-Date"], size, digest, fields.get("WARC-Refers-To")))
                yield _batch(rows, _WARC_COLUMNS)

    return _files(spark, folder).mapInArrow(run, "record_id string, record_type string, page_id long, uri string, date string, payload_bytes long, payload_digest string, refers_to_record string")


def resolved_revisits(records: DataFrame) -> DataFrame:
    """Adds refers_to, the page id of the record that a revisit refers to; null for responses, and where that record is not there.

    Responses are not joined; revisits are, salted, as one payload may have any number of them.
    """
    records = checkpointed(records)  # narrow rows, without payloads
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    originals = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    found = salted_join(revisits, originals, "refers_to_record", F.col("record_id"))
    others = responses.union(revisits.join(originals, "refers_to_record", "left_anti").select(*records.columns))
    return found.select(*records.columns, "refers_to").union(others.withColumn("refers_to", F.lit(None).cast("long")))
