"""WARC archives: exact round trips, members by offset, broken files."""

import base64
import gzip
import hashlib

import pytest

from shelfcast.llm import warc
from shelfcast.llm.warc import normalised, op10_warc_normaliser, read_records, with_first_ids, write_archives

PAGES = "page_id long, url string, html string"
ROWS = [(5, "http://a/b c\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "u", "<p>é</p>"), (1, "v", None), (3, "w", ""), (4, "x", "WARC/1.1\r\n\r\n"),
        (None, "n", "alone"), (None, "n", "<p>é</p>"), (7, "y", "z" * 3_000_000), (8, "t", "twice"), (8, "t", "twice")]


def expected(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ref = first.get(html or "")
        response = ref is None or ref == page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else ref))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=str)


@pytest.mark.parametrize("archive_bytes", [1 << 28, 200])
def test_round_trip(spark, tmp_path, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    df = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "1 AS payload", "2 AS sha").repartition(3)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    assert rows_of(op10_warc_normaliser(spark, str(tmp_path))) == expected(ROWS)


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert rows_of(op10_warc_normaliser(spark, str(tmp_path))) == []


def test_each_record_is_a_member_at_its_offset(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES).coalesce(1)
    mono = write_archives(with_first_ids(pages), str(tmp_path / "w"))
    by_record = normalised(mono, str(tmp_path / "w")).collect()
    assert sum(r["records"] for r in by_record) == len(ROWS)
    for old, new in zip(mono.collect(), by_record):
        whole = gzip.open(old["path"]).read()
        data = open(new["path"], "rb").read()
        parts = []
        for line in open(new["index"]):
            offset, size = map(int, line.split("\t")[:2])
            parts.append(gzip.decompress(data[offset:offset + size]))
        assert b"".join(parts) == whole
        assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)
        assert sum(int(line.split("\t")[1]) for line in open(new["index"])) == len(data)


def test_smaller_payloads_are_all_responses(spark):
    got = {(r["page_id"], r["refers_to"]) for r in with_first_ids(spark.createDataFrame(ROWS, PAGES), least_bytes=100).collect()}
    assert {ref for _, ref in got} == {None}


def test_broken_archives_are_named(spark, tmp_path):
    path = str(tmp_path / "broken.warc.gz")
    record = warc._record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    for data in (gzip.compress(record)[:-12], gzip.compress(record[:-9]), gzip.compress(b"no archive\r\n\r\n")):
        open(path, "wb").write(data)
        with pytest.raises(Exception, match="broken.warc.gz|end-of-stream"):
            read_records(normalised(spark.createDataFrame([(path,)], "path string"), str(tmp_path))).collect()
