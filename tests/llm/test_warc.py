import gzip
import io

import pytest

from tidewatch.llm import warc
from tidewatch.llm.common import shared_folder

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "é" * 80 + "</p>"
ROWS = [
    (1, "http://a/", LONG), (2, "http://b/?q=ü x\r\ny", LONG), (3, None, LONG), (4, "u", "short"), (5, "u", "short"),
    (6, "u", None), (7, "u", ""), (8, "u", "x" * 100), (8, "u", "x" * 100), (9, "u", "\r\n\r\n" * 40), (None, "u", "y" * 200), (10, "u", "y" * 200),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    listed = warc.write_archives(pages, shared_folder(spark, "warc"), archive_bytes=600)
    assert listed.count() > 2
    got = warc.read_archives(listed).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for page, _, html in ROWS:
        data = (html or "").encode()
        for r in by[page]:
            assert r.payload_bytes == len(data)
            assert r.record_type == "revisit" or bytes(r.payload) == data
    kinds = {k: [(r.record_type, r.refers_to) for r in v] for k, v in by.items()}
    assert kinds[1] == [("response", None)] and kinds[2] == kinds[3] == [("revisit", 1)]
    assert kinds[4] == kinds[5] == kinds[6] == [("response", None)]
    assert kinds[8] == [("response", None)] * 2
    assert kinds[None] == [("revisit", 10)]
    assert [tuple(map(len, (listed.collect()[0].path,)))]


def test_empty_table(spark):
    listed = warc.write_archives(spark.createDataFrame([], PAGES), shared_folder(spark, "warc"))
    assert warc.read_archives(listed).count() == 0


def member(block=b"abc", **over):
    import hashlib

    return warc.member(warc.record_bytes(1, "u", block, over.get("digest", hashlib.sha256(block).hexdigest())))


def test_members_are_plain_gzip_and_read_in_small_blocks(monkeypatch):
    data = member(b"a" * 5000) + member(b"") + member(b"\r\n\r\n")
    monkeypatch.setattr(warc, "BLOCK", 7)
    rows = list(warc.read_archive(io.BytesIO(data)))
    assert [r[-1] for r in rows] == [b"a" * 5000, b"", b"\r\n\r\n"]
    assert gzip.decompress(data).count(b"WARC/1.1") == 3


@pytest.mark.parametrize("data", [member()[:-5], member(digest="0" * 64), b"not gzip", warc.member(b"HTTP/1.1\r\n\r\n"), warc.member(b"WARC/1.1\r\nA: b\r\n\r\n")])
def test_broken_records_are_named(data):
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(data)))
