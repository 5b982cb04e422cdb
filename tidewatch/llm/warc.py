"""WARC archives: one gzip member per record, and a sequential reader.

Writing: payloads are digested, the smallest page id of every digest becomes the
response, the others revisit it.  Each task writes its records to archives of about
``ARCHIVE_BYTES`` in the folder all executors share, under names of its own attempt;
the list of archives is the task's output, so files of a failed attempt are never
listed.  Reading: each archive is read front to back in blocks; a decompression object
per member, the header block up to the empty line, then as many bytes as
Content-Length says, digested on the way.  A reader holds one block and one payload.

Defined cases: a null html is an empty payload; payloads under 100 bytes are always
responses; a null page id is written as an empty field and never referred to unless no
row of the digest has an id; rows that repeat the smallest id of a digest are responses;
an empty table gives an empty folder and no rows; a record whose framing or digest is
wrong raises ``WarcError`` with archive and offset.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import join_checked, map_rows, shared_folder, stage_table, table

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
BLOCK = 1 << 16
LISTING = "path string, records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class WarcError(ValueError):
    """A record that is not framed or digested as it says."""


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, local, HDFS or an object store."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(path)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record, uncompressed."""
    block = b"" if revisit else payload
    text = lambda v: "" if v is None else str(v)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Target-URI: {quote(text(url), safe=';/?:@&=+$,#%[]!*()~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {text(page_id)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {text(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def read_members(stream, name: str = "") -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member, decompressed block by block."""
    offset, waiting, ended = 0, b"", False
    while True:
        if not waiting:
            waiting = stream.read(BLOCK)
            if not waiting:
                return
        unpack, parts, start, used = zlib.decompressobj(31), [], offset, 0
        while not unpack.eof:
            if not waiting:
                waiting = stream.read(BLOCK)
                if not waiting:
                    raise WarcError(f"{name}: member at {start} is cut off")
            try:
                parts.append(unpack.decompress(waiting))
            except zlib.error as error:
                raise WarcError(f"{name}: member at {start}: {error}") from error
            used += len(waiting) - len(unpack.unused_data)
            waiting = unpack.unused_data
        offset += used
        yield start, b"".join(parts)


def parse_record(content: bytes, where: str = "") -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record, framed by Content-Length."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise WarcError(f"{where}: no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"{where}: header line without a colon")
        fields[name.strip().lower()] = value.strip()
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError) as error:
        raise WarcError(f"{where}: no valid Content-Length") from error
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise WarcError(f"{where}: the block is not {length} bytes long")
    return fields, block


def read_archive(stream, name: str = "") -> Iterator[tuple]:
    """Rows of ``RECORDS`` from one archive, digests verified."""
    number = lambda v: int(v) if v else None
    for offset, content in read_members(stream, name):
        where = f"{name}: record at {offset}"
        fields, block = parse_record(content, where)
        kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:")
        if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
            raise WarcError(f"{where}: wrong digest")
        yield (
            number(fields.get("x-page-id")),
            fields.get("warc-target-uri"),
            number(fields.get("x-payload-length")),
            digest,
            kind,
            number(fields.get("x-refers-to-page")),
            None if kind == "revisit" else block,
        )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page as a record below ``folder``; the stored list of archives."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.filter(F.octet_length("payload") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first_id")
    )
    # Only digests that occur twice; a small list is broadcast, a large one is joined by
    # a shuffle whose hot digests adaptive execution splits.
    marked = join_checked(rows, stage_table(first), ["digest"], "left", row_bytes=128)

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        files, target = _open(folder)
        files.create_dir(target, recursive=True)
        out, path, size, records = None, "", 0, 0
        for batch in batches:
            done = []
            columns = (batch[c] for c in ("page_id", "url", "payload", "digest", "first_id"))
            for page, url, content, digest, first_id in zip(*columns, strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, records = f"{folder}/{name}", 0, 0
                    out = files.open_output_stream(f"{target}/{name}", compression=None)
                revisit = first_id is not None and page != first_id
                data = member(record_bytes(page, url, content, digest, first_id, revisit))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, records))
                    out = None
            yield done
        if out is not None:
            out.close()
            yield [(path, records)]

    return stage_table(map_rows(marked.select("page_id", "url", "payload", "digest", "first_id"), run, LISTING))


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the listed archives; a task reads archives one after the other."""

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        for batch in batches:
            for path in batch["path"]:
                files, target = _open(path)
                rows, held = [], 0
                with files.open_input_stream(target, compression=None, buffer_size=BLOCK) as stream:
                    for row in read_archive(stream, path):
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield rows
                            rows, held = [], 0
                yield rows

    # A number keeps adaptive execution from reading all archives in one task.
    return map_rows(archives.repartition(max(archives.count(), 1), "path"), run, RECORDS)


def op6_warc(spark, sf_dir) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return read_archives(archives).drop("url", "payload")
