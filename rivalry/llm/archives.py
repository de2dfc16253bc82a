"""Legacy ARC archives converted to WARC, written as WARC files and read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.llm.common import scratch_path, written

#: A WARC file is closed once it holds so many bytes of records, so it exceeds them by one record at most.
FILE_BYTES = 16 << 20
END = "\r\n\r\n"
#: Fields of an ARC header line after the address, by version of the archive.
FIELDS = {
    b"1": ("ip", "date", "type", "length"),
    b"2": ("ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(key.encode()).digest()[:16], version=5)}>"


def arc_file(entries: Iterable[tuple[str, str, str, bytes]], version: int = 1, name: str = "part.arc") -> bytes:
    """An ARC archive of (url, date as 14 digits, media type, content): a version block, then a header line and content each."""
    own = b"1 0 rivalry\nURL IP-address Archive-date Content-type Archive-length\n"
    if version == 2:
        own = (
            b"2 0 rivalry\nURL IP-address Archive-date Content-type Result-code "
            b"Checksum Location Offset Filename Archive-length\n"
        )
    out = io.BytesIO()
    middle = " 200 - - 0 " + name if version == 2 else ""
    out.write(f"filedesc://{name} 0.0.0.0 20000101000000 text/plain{middle} {len(own)}\n".encode() + own + b"\n")
    for url, date, kind, content in entries:
        address = (url or "-").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")
        middle = f" 200 {digest(content)} - {out.tell()} {name}" if version == 2 else ""
        out.write(f"{address} 0.0.0.0 {date} {kind}{middle} {len(content)}\n".encode() + content + b"\n")
    return out.getvalue()


def arc_records(data: bytes) -> Iterator[dict]:
    """Records of an ARC archive. The version block, its first record, names the header fields; declared lengths bound the content."""
    at, fields, version_block = 0, FIELDS[b"1"], data.startswith(b"filedesc:")
    if version_block:
        start = data.find(b"\n") + 1
        version = data[start : start + 1]
        if version not in FIELDS:
            raise ValueError("an ARC archive of an unknown version")
        fields = FIELDS[version]
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line doesn't end")
        line = data[at:end]
        if not line.strip():
            at = end + 1
            continue
        parts = line.decode("utf-8", "replace").rsplit(" ", len(fields))
        head = dict(zip(("url", *fields), parts, strict=True))
        size = int(head["length"])
        content = data[end + 1 : end + 1 + size]
        if size < 0 or len(content) != size:
            raise ValueError("an ARC record is shorter than its declared length")
        at = end + 1 + size
        if not version_block:
            yield head | {"content": content}
        version_block = False


def http_parts(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of an HTTP response; content without a status line is all payload."""
    if not content.startswith(b"HTTP/"):
        return {}, content
    head, _, payload = content.partition(b"\r\n\r\n")
    lines = [x.decode("utf-8", "replace").partition(":") for x in head.split(b"\r\n")[1:]]
    return {k.strip().lower(): v.strip() for k, _, v in lines}, payload


def warc_record(arc: dict, key: str, refers_key: str | None = None) -> bytes:
    """The WARC record of an ARC one: synthesised id, timestamp, type and digests. A revisit keeps the HTTP header only."""
    content, date = arc["content"], arc["date"]
    http, payload = http_parts(content)
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    block = content if refers_key is None else content[: len(content) - len(payload)]
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_key is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {stamp}", f"WARC-Target-URI: {arc['url']}", f"WARC-IP-Address: {arc['ip']}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Type: {'application/http; msgtype=response' if http else arc['type']}", f"Content-Length: {len(block)}",
    ]
    if refers_key is not None:
        head[3:3] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_key)}",
        ]
    return ("\r\n".join(head) + END).encode() + block + END.encode()


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record doesn't start where the last one ended")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is shorter than its declared length")
        yield head, block


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the largest page_id of those with an equal payload of `least` bytes or more.

    Payloads are grouped by SHA-1 and size. Only groups of two or more, a digest and an id each, are written
    and meet the pages again, in a join of plain exchanges that splits a frequent payload among tasks.
    """
    keyed = pages.withColumns({"sha": F.sha1("html"), "size": F.octet_length("html")})
    groups = keyed.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    groups = groups.where("n > 1 and kept is not null").select(F.col("sha").alias("s"), F.col("size").alias("z"), "kept")
    joined = keyed.join(written(groups, "warc-copies"), (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z")), "left")
    other = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("kept")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, date: str = "20000101000000", file_bytes: int = FILE_BYTES) -> None:
    """Put pages (page_id, url, html, refers_to) through ARC archives of either version and write WARC files.

    A file is a row of records, a gzip member each, that Spark's text writer puts down as it is; the byte
    that the writer adds at the end is zero, which gzip takes as padding.
    """

    def convert(batches):
        held, size = [], 0
        for batch in batches:
            for i, url, html, ref in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                payload = html.encode()
                no = "" if i is None else str(i)
                about = f"X-Page-Id: {no}\r\n" + ("" if ref is None else f"X-Refers-To-Page-Id: {ref}\r\n")
                content = (
                    f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{about}Content-Length: {len(payload)}\r\n\r\n"
                ).encode() + payload
                archive = arc_file([(url, date, "text/html", content)], 1 + len(payload) % 2)  # both versions are met
                for record in arc_records(archive):
                    held.append(gzip.compress(warc_record(record, f"page:{no}", None if ref is None else f"page:{ref}"), 6, mtime=0))
                    size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    rows = pages.select("page_id", "url", "html", "refers_to").mapInArrow(convert, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to, record_id) of the WARC files at path.

    The payload of a response is digested again and must agree with its header. Records are decompressed one
    by one; a file is as large as write_archives() makes it.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows: list[list] = [[] for _ in names]
                for head, block in warc_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    http, payload = http_parts(block)
                    told = head["warc-payload-digest"].removeprefix("sha1:")
                    kind = head["warc-type"]
                    if kind == "response" and digest(payload) != told:
                        raise ValueError(f"{head['warc-record-id']}: the payload differs from its digest")
                    size = len(payload) if kind == "response" else int(http["content-length"])
                    values = (http["x-page-id"] or None, size, told, kind, http.get("x-refers-to-page-id"), head["warc-record-id"])
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
                kinds = [pa.string(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    out = files.mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def convert_pages(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page, from WARC files that were converted from ARC archives of the pages.

    A null html is an empty payload, a null url an address of "-". Of equal payloads of `least` bytes or more
    the largest page_id is the response and the others revisit it; rows that repeat that id are responses
    too. Null ids stay null and revisit an equal page that has an id. A url may hold anything, header words
    of the format included; a very long page is a file of its own. Other columns, whatever their names, are
    not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    path = scratch_path(spark, "warc")
    write_archives(with_revisits(rows, least), path)
    return read_archives(spark, path, dict(rows.dtypes)["page_id"])
