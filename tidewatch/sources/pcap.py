"""Capture files (pcap) to packet rows.

Files are listed by Spark.  Captures up to ``PART_BYTES`` are read by Spark, a task per
file.  Larger ones are read by byte ranges, many tasks per file:

1. Records carry no marks, so a task looks for the first place of its range where a chain
   of record headers makes sense, and hops from header to header to the range's end.  It
   reports where it began, where the first record beyond the range starts and how many
   records it saw: one row per range.
2. A range that did not begin where the one before it ended was misled, by a payload that
   looks like records or a record longer than a range.  It is done again from the right
   place, until all ranges join; the first one begins behind the file header, so then all
   are right, whatever the payloads hold.
3. Ranges are decoded, with record numbers that follow from the counts before them.

A stream reads each capture in one task, block by block, as it only sees it once.  Files
that cannot be read or are no captures are left out; ``bad_captures`` names them.  A tail
that is cut off ends its file, as a capture that was interrupted does.
"""

from __future__ import annotations

import ipaddress
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import packet as P
from tidewatch.schemas import PACKETS
from tidewatch.session import prepare, ship_package, stage_table
from tidewatch.sources.files import open_input
from tidewatch.sources.tables import AppendTable

FILES = "path string, modificationTime timestamp, length long, content binary"
PART_BYTES = 128 << 20
_BLOCK = 4 << 20
_CHAIN = 8  # headers in a row that must make sense
_DAYS = 400 * 86_400
_ROWS = 50_000

# File magic -> (byte order, units per microsecond), link types with
# the offset of the network layer, ether types, IPv6 extension headers.
_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}
_ETHERNET, _RAW, _RAW_V4, _RAW_V6 = 1, 101, 228, 229
_IPV4, _IPV6, _VLAN = 0x0800, 0x86DD, (0x8100, 0x88A8)
_EXTENSIONS = {0, 43, 60}
_FRAGMENT, _AUTH = 44, 51

RAW = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("t", T.LongType()),
        T.StructField("ip_version", T.IntegerType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("tcp_window", T.IntegerType()),
        T.StructField("ip_len", T.IntegerType()),
        T.StructField("ihl", T.IntegerType()),
        T.StructField("segment_len", T.IntegerType()),
        T.StructField("data_offset", T.IntegerType()),
        T.StructField("udp_len", T.IntegerType()),
        T.StructField("source_file", T.StringType()),
    ]
)


def _network(frame: bytes, link: int) -> bytes | None:
    """The IP packet inside a captured frame, None if it is none."""
    if link in (_RAW, _RAW_V4, _RAW_V6):
        return frame
    if link != _ETHERNET or len(frame) < 14:
        return None
    at, kind = 14, int.from_bytes(frame[12:14], "big")
    while kind in _VLAN and len(frame) >= at + 4:
        kind = int.from_bytes(frame[at + 2 : at + 4], "big")
        at += 4
    return frame[at:] if kind in (_IPV4, _IPV6) else None


def _headers(ip: bytes):
    """(version, src, dst, protocol, ip_len, ihl, transport bytes or None)."""
    version = ip[0] >> 4 if ip else 0
    if version == 4 and len(ip) >= 20:
        ihl = ip[0] & 15
        total, frag = struct.unpack_from(">H2xH", ip, 2)
        end = total if 0 < total <= len(ip) else len(ip)  # drop link padding
        body = ip[ihl * 4 : end] if not frag & 0x1FFF else None
        return 4, str(ipaddress.IPv4Address(ip[12:16])), str(ipaddress.IPv4Address(ip[16:20])), ip[9], total, ihl, body
    if version == 6 and len(ip) >= 40:
        end = 40 + struct.unpack_from(">H", ip, 4)[0]
        nxt, at, body = ip[6], 40, ip[: min(end, len(ip))]
        while len(body) >= at + 8:
            if nxt in _EXTENSIONS:
                nxt, at = body[at], at + 8 * (body[at + 1] + 1)
            elif nxt == _AUTH:
                nxt, at = body[at], at + 4 * (body[at + 1] + 2)
            elif nxt == _FRAGMENT:
                if struct.unpack_from(">H", body, at + 2)[0] & 0xFFF8:
                    return 6, str(ipaddress.IPv6Address(ip[8:24])), str(ipaddress.IPv6Address(ip[24:40])), nxt, end, 10, None
                nxt, at = body[at], at + 8
            else:
                break
        return 6, str(ipaddress.IPv6Address(ip[8:24])), str(ipaddress.IPv6Address(ip[24:40])), nxt, end, 10, body[at:]
    return None


class _Held:
    """A capture whose bytes Spark has read."""

    def __init__(self, content: bytes):
        self.content, self.size = content, len(content)

    def at(self, place: int, n: int) -> bytes:
        return self.content[place : place + n]


class _Opened:
    """A capture on a file system, read in blocks."""

    def __init__(self, path: str):
        self._file = open_input(path)
        self.size, self._start, self._block = self._file.size(), 0, b""

    def at(self, place: int, n: int) -> bytes:
        if place < self._start or place + n > self._start + len(self._block):
            self._file.seek(place)
            self._start, self._block = place, self._file.read(max(n, _BLOCK))
        return self._block[place - self._start : place - self._start + n]


class _Head:
    """What the file header says, and the time of the first record."""

    def __init__(self, source: _Held | _Opened):
        magic = source.at(0, 24)
        if magic[:4] not in _MAGIC or len(magic) < 24:
            raise ValueError("not a pcap file")
        self.order, self.unit = _MAGIC[magic[:4]]
        snap, link = struct.unpack_from(self.order + "II", magic, 16)
        self.link, self.longest = link & 0xFFFF, max(snap, 1 << 18)
        self.record = struct.Struct(self.order + "IIII")
        first = source.at(24, 16)
        self.began = self.record.unpack(first)[0] if len(first) == 16 else 0

    def plausible(self, source: _Held | _Opened, place: int) -> int | None:
        """The place after the record that seems to begin here."""
        raw = source.at(place, 16)
        if len(raw) < 16:
            return None
        seconds, fraction, held, length = self.record.unpack(raw)
        fits = held <= min(length, self.longest) and fraction < 1_000_000 * self.unit and abs(seconds - self.began) < _DAYS
        return place + 16 + held if fits else None

    def first_record(self, source: _Held | _Opened, start: int, stop: int) -> int | None:
        """The first place from ``start`` on where a chain of records seems to begin."""
        for place in range(start, min(stop, start + 2 * self.longest)):
            at: int | None = place
            for _ in range(_CHAIN):
                at = self.plausible(source, at)
                if at is None or at >= source.size:
                    break
            if at is not None and at <= source.size:
                return place
        return None


def _hop(source: _Held | _Opened, head: _Head, start: int, stop: int) -> tuple[int, int]:
    """(first record start at or after ``stop``, records before it) from a record's start."""
    at, count = start, 0
    while at < stop:
        raw = source.at(at, 16)
        if len(raw) < 16:
            return source.size, count
        at, count = at + 16 + head.record.unpack(raw)[2], count + 1
    return at, count


def decode(path: str, content: bytes) -> Iterator[tuple]:
    """The IP packets of one capture file as rows of ``RAW``."""
    if content:
        source = _Held(content)
        yield from _decoded(path, source, _Head(source), 24, source.size, 0)


def _decoded(path: str, source: _Held | _Opened, head: _Head, at: int, stop: int, number: int) -> Iterator[tuple]:
    """The packets of the records that begin in a range; ``number`` records come before."""
    base = zlib.crc32(path.encode()) << 31
    while at < stop and at + 16 <= source.size:
        seconds, fraction, held, _ = head.record.unpack(source.at(at, 16))
        if at + 16 + held > source.size:
            return
        frame = source.at(at + 16, held)
        at, number = at + 16 + held, number + 1
        ip = _network(frame, head.link)
        found = _headers(ip) if ip is not None else None
        if found is None:
            continue
        version, src, dst, protocol, ip_len, ihl, body = found
        t = seconds * 1_000_000 + fraction // head.unit
        first = (base + number, t, version, src, dst)
        if protocol == P.TCP and body is not None and len(body) >= 20:
            sport, dport, offset, flags, window = struct.unpack_from(">HH8xBBH", body)
            yield (*first, P.TCP, sport, dport, flags, window, ip_len, ihl, len(body), offset >> 4, None, path)
        elif protocol == P.UDP and body is not None and len(body) >= 8:
            sport, dport, size = struct.unpack_from(">HHH", body)
            yield (*first, P.UDP, sport, dport, 0, 0, ip_len, ihl, len(body), None, size, path)
        else:
            # Another protocol, or a fragment without a transport header: counted as skipped.
            other = protocol if protocol not in (P.TCP, P.UDP) else -1
            yield (*first, other, None, None, 0, 0, ip_len, ihl, 0, None, None, path)


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    names = RAW.fieldNames()
    while part := list(islice(rows, _ROWS)):
        numbers = {n: "Int64" for n in names if n not in ("src_ip", "dst_ip", "source_file")}
        yield pd.DataFrame(part, columns=names).astype(numbers)


def _source(path: str, content: bytes | None) -> _Held | _Opened:
    return _Opened(path) if content is None else _Held(bytes(content))


def _whole_files(files: DataFrame) -> DataFrame:
    """Raw packets of files (path, content), a null content to be read in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    source = _source(path, content)
                    head = _Head(source)
                except (OSError, ValueError):
                    continue  # named by bad_captures
                yield from _frames(_decoded(path, source, head, 24, source.size, 0))

    return files.select("path", "content").mapInPandas(run, RAW)


def bad_captures(files: DataFrame) -> DataFrame:
    """(path, reason) of listed files that are no captures or cannot be opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad = []
            for path in pdf["path"]:
                try:
                    _Head(_Opened(path))
                except (OSError, ValueError) as error:
                    bad.append((path, str(error)))
            yield pd.DataFrame(bad, columns=["path", "reason"])

    ship_package(files.sparkSession)
    return files.filter("length > 0").select("path").mapInPandas(run, "path string, reason string")


def _indexed(ranges: DataFrame) -> DataFrame:
    """Ranges (path, start, stop, from) with ``first``, ``after`` and ``records`` (stored).

    ``from``: where a record is known to begin, null to look for one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, start, stop, known in pdf.itertuples(index=False):
                try:
                    source = _Opened(path)
                    head = _Head(source)
                except (OSError, ValueError):
                    continue
                first = head.first_record(source, start, stop) if pd.isna(known) else int(known)
                after, count = (None, 0) if first is None else _hop(source, head, first, stop)
                rows.append((path, start, stop, first, after, count))
            names = ["path", "start", "stop", "first", "after", "records"]
            yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(names[1:], "Int64"))

    columns = "path string, start long, stop long, first long, after long, records long"
    return stage_table(_dealt(ranges.select("path", "start", "stop", "from")).mapInPandas(run, columns))


def _dealt(ranges: DataFrame) -> DataFrame:
    """A row is a whole range of work: a task for each, which a given number keeps from being merged."""
    return ranges.repartition(max(1, ranges.count()))


def _by_ranges(files: DataFrame, part_bytes: int) -> DataFrame:
    """Raw packets of large files (path, length), in ranges of ``part_bytes``."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(part_bytes).cast("long"))
    ranges = files.select("path", "length", F.explode(starts).alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("start") + part_bytes, "length"))
    index = _indexed(ranges.withColumn("from", F.when(F.col("start") == 0, F.lit(24).cast("long"))))
    chain = Window.partitionBy("path").orderBy("start")
    while True:
        linked = index.withColumn("due", F.lag("after").over(chain))
        # Each round at least the first misled range of a file is put right.
        wrong = linked.filter(F.col("due").isNotNull() & ~F.col("due").eqNullSafe(F.col("first")))
        wrong = stage_table(wrong.select("path", "start", "stop", F.col("due").alias("from")))
        if wrong.isEmpty():
            break
        again = _indexed(wrong)
        index = stage_table(index.join(again.select("path", "start"), ["path", "start"], "left_anti").unionByName(again))
    before = F.sum("records").over(chain) - F.col("records")
    work = stage_table(index.withColumn("before", before).filter("records > 0").select("path", "first", "stop", "before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, first, stop, number in pdf.itertuples(index=False):
                source = _Opened(path)
                yield from _frames(_decoded(path, source, _Head(source), first, stop, number))

    return _dealt(work).mapInPandas(run, RAW)


def packets_of(files: DataFrame, max_bytes: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Packet rows of a (batch or streaming) listing with file contents.

    ``max_bytes``: refuse larger files; by default there is no limit.
    """
    ship_package(files.sparkSession)
    files = files.filter("length > 0")
    if max_bytes is not None:
        refusal = F.raise_error(F.concat(F.lit("capture file too large: "), F.col("path"))).cast("long")
        files = files.withColumn("length", F.when(F.col("length") > max_bytes, refusal).otherwise(F.col("length")))
    small = F.col("length") <= part_bytes
    raw, large = _whole_files(files.filter(small)), files.filter(~small)
    if files.isStreaming:
        # Only the path is asked for: Spark does not read these contents.
        raw = raw.unionByName(_whole_files(large.select("path", F.lit(None).cast("binary").alias("content"))))
    elif not large.isEmpty():
        raw = raw.unionByName(_by_ranges(large.select("path", "length"), part_bytes))
    return _packet_columns(raw)


def _packet_columns(raw: DataFrame) -> DataFrame:
    v4 = F.col("ip_version") == 4
    tcp, udp = F.col("protocol") == P.TCP, F.col("protocol") == P.UDP
    off = F.col("data_offset")
    payload = (
        F.when(tcp & v4, P.tcp_payload_v4(F.col("ip_len"), F.col("ihl"), off))
        .when(tcp, P.tcp_payload_v6(F.col("segment_len"), off))
        .when(udp, P.udp_payload(F.col("udp_len")))
        .otherwise(0)
    )
    columns = raw.withColumns(
        {
            "ts": F.timestamp_micros("t"),
            "payload_len": payload.cast("long"),
            "header_size": F.when(tcp, P.tcp_header_size(off)).when(udp, P.UDP_HEADER),
        }
    )
    return columns.select(*[F.col(f.name).cast(f.dataType) for f in PACKETS.fields], "source_file")


def read_pcap(
    spark: SparkSession, path: str, glob: str = "*.pcap", max_bytes: int | None = None, part_bytes: int = PART_BYTES,
    quarantine: AppendTable | None = None,
) -> DataFrame:
    """All capture files of a directory; ``quarantine`` gets (path, reason) of those left out."""
    files = prepare(spark).read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    if quarantine is not None:
        quarantine.append(bad_captures(files))
    return packets_of(files, max_bytes, part_bytes)


def stream_pcap(
    spark: SparkSession, path: str, glob: str = "*.pcap", archive: str | None = None,
    files_per_trigger: int | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """Capture files as they appear; finished ones move to ``archive`` if given."""
    reader = prepare(spark).readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return packets_of(reader.load(path), max_bytes)
