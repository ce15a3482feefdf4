"""WARC archives: writing, normalising and reading.

* `write_archives` writes records as monolithic gzip files, one stream over many records, as
  many crawlers leave them.
* `normalised` inflates each file once as a stream, rewrites every record as a gzip member of
  its own, and writes a sidecar index of offsets beside the new archive.
* `read_records` reads through the sidecar: each member is inflated alone, at its offset.

Files go to the shared folder named in `spark.checkpoint.dir`, or below `folder`. A task writes
under a name of its own attempt and only returns names of whole files, so that a retried or
speculative task leaves at most a stray file that nothing refers to. A task holds one page (or
one chunk of a record) at a time; an archive is closed at `ARCHIVE_BYTES` of payload.

Nulls and edge cases: a null html is an empty payload; a null url leaves the target out, and
line breaks or blanks in a url are percent-encoded; a null page_id is written as `null` and
counts as the largest; rows that repeat page_id and html are written as often as they come,
all of them of the type that the page has; no pages give no archives and no rows. Other columns
are not carried. A truncated or broken archive raises an error that names it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shelfcast.functions.shipping import shipped
from shelfcast.functions.tables import shared_folder, written
from shelfcast.llm.common import table

ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
# Fast compression: archives are written twice and read twice.
LEVEL = 1
FIELDS = ("type", "record", "refers_to", "digest", "payload_bytes")
# The profile of a revisit, and the record's fixed date for repeatable files.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2000-01-01T00:00:00Z"
ID_PREFIX = "urn:page:"


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), folder
    return pyarrow.fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/")
                                          and not folder.startswith("file://") else folder)


def with_first_ids(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for a response.

    Of pages with equal payloads of at least `least_bytes`, the one with the smallest id is the
    response. Only ids and digests are grouped; the payloads meet the list of revisits, whose
    size is known because it is written, by page.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    based = pages.select("page_id", "url", payload.alias("payload"))
    marked = based.withColumn("sha", F.sha1("payload"))
    large = marked.filter(F.length("payload") >= least_bytes).select("page_id", "sha")
    groups = large.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = written(
        large.join(groups, "sha").filter(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
        .select(F.col("page_id").alias("of"), F.col("sha").alias("of_sha"), "first").distinct(), "revisits")
    same = marked["page_id"].eqNullSafe(revisits["of"]) & (marked["sha"] == revisits["of_sha"])
    return marked.join(revisits, same, "left").select("page_id", "url", "payload", "sha", F.col("first").alias("refers_to"))


def _record(page_id, url, payload: bytes, sha: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and drops the payload."""
    digest = base64.b32encode(bytes.fromhex(sha)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{ID_PREFIX}{'null' if page_id is None else page_id}>", f"WARC-Date: {RECORD_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """(path, records): monolithic gzip archives of the rows of `with_first_ids`."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        context = TaskContext.get()
        stem = f"{root}/mono-{context.partitionId():06d}-{context.taskAttemptId()}"
        done, out, packed, rows, size = [], None, None, 0, 0
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "sha", "refers_to")]):
                if out is None:
                    path, rows, size = f"{stem}-{len(done):05d}.warc.gz", 0, 0
                    out, packed = store.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                record = _record(*[v.as_py() for v in row])
                out.write(packed.compress(record))
                rows, size = rows + 1, size + len(record)
                if size >= ARCHIVE_BYTES:
                    out.write(packed.flush())
                    out.close()
                    done.append((path, rows))
                    out = None
        if out is not None:
            out.write(packed.flush())
            out.close()
            done.append((path, rows))
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "records": pa.array([n for _, n in done], pa.int64())},
                                         schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    shipped(records.sparkSession)
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    return written(records.mapInArrow(write, "path string, records long"), "archives")


class _Digesting:
    """What a record's head says, and the length and digest of what follows it."""

    def __init__(self, head: dict[str, str]):
        self.head, self.sha, self.size = head, hashlib.sha1(), 0

    def payload(self, data: bytes) -> None:
        self.sha.update(data)
        self.size += len(data)


def _name(value: str | None) -> str | None:
    return None if value is None else value.strip("<>").removeprefix(ID_PREFIX)


def _head(stream, path: str) -> tuple[bytes, dict[str, str]] | None:
    """Raw bytes and fields of the next head, up to its empty line; None at the end."""
    raw, fields = [], {}
    while True:
        line = stream.readline()
        if not line:
            if raw:
                raise ValueError(f"{path}: ends within a head")
            return None
        raw.append(line)
        if line == b"\r\n":
            return b"".join(raw), fields
        key, _, value = line.decode("utf-8").partition(":")
        fields[key.strip().lower()] = value.strip()


def _block(stream, size: int, path: str) -> Iterator[bytes]:
    while size:
        data = stream.read(min(CHUNK, size))
        if not data:
            raise ValueError(f"{path}: ends within a record")
        size -= len(data)
        yield data


def _rewrite(source, path: str, target, index) -> int:
    """Each record of one long stream as a member of its own; its place goes to `index`."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source), CHUNK)
    offset = count = 0
    while (head := _head(stream, path)) is not None:
        raw, fields = head
        if not raw.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record at record {count}")
        member, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        size += target.write(packed) if (packed := member.compress(raw)) else 0
        for data in _block(stream, int(fields["content-length"]), path):
            size += target.write(packed) if (packed := member.compress(data)) else 0
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{path}: record {count} has no end")
        size += target.write(member.compress(b"\r\n\r\n") + member.flush())
        index.write(f"{offset}\t{size}\t{fields['warc-type']}\t{_name(fields['warc-record-id'])}\n".encode())
        offset, count = offset + size, count + 1
    return count


def normalised(archives: DataFrame, folder: str) -> DataFrame:
    """(path, index, records): archives with a member per record, and their sidecar indexes.

    `archives` has one row (path) per monolithic file.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                stem = f"{root}/{path.rpartition('/')[2].removesuffix('.warc.gz')}-by-record-{attempt}"
                with (store.open_input_stream(path, compression=None) as source,
                      store.open_output_stream(f"{stem}.warc.gz", compression=None) as target,
                      store.open_output_stream(f"{stem}.index.tsv", compression=None) as index):
                    rows = _rewrite(source, path, target, index)
                yield pa.RecordBatch.from_pydict(
                    {"path": [f"{stem}.warc.gz"], "index": [f"{stem}.index.tsv"], "records": pa.array([rows], pa.int64())})

    shipped(archives.sparkSession)
    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    return written(spread.mapInArrow(rewrite, "path string, index string, records long"), "normalised")


def _read_record(member: bytes, path: str) -> tuple:
    stream = io.BytesIO(member)
    fields = _head(stream, path)[1]
    block_end = stream.tell() + int(fields["content-length"])
    http = _head(stream, path)[1]
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        return fields["warc-type"], _name(fields["warc-record-id"]), _name(fields["warc-refers-to"]), said, int(http["content-length"])
    body = member[stream.tell():block_end]
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    if digest != said:
        raise ValueError(f"{path}: {fields['warc-record-id']} does not have the digest it states")
    return fields["warc-type"], _name(fields["warc-record-id"]), _name(fields.get("warc-refers-to")), digest, len(body)


def read_records(archives: DataFrame) -> DataFrame:
    """One row per record of normalised archives, read member by member through the sidecars."""
    schema = pa.schema([(f, pa.int64() if f == "payload_bytes" else pa.string()) for f in FIELDS])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                store, _ = _store(path.rpartition("/")[0])
                rows = []
                with store.open_input_file(path) as file, store.open_input_stream(index, compression=None) as lines:
                    for line in io.BufferedReader(lines):
                        offset, size = map(int, line.split(b"\t")[:2])
                        file.seek(offset)
                        rows.append(_read_record(gzip.decompress(file.read(size)), path))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pydict(dict(zip(FIELDS, map(list, zip(*rows)))), schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(FIELDS, map(list, zip(*rows)))), schema=schema)

    shipped(archives.sparkSession)
    spread = archives.repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(read, "type string, record string, refers_to string, digest string, payload_bytes long")


def op10_warc_normaliser(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/shelfcast/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex[:8]}"
    archives = write_archives(with_first_ids(table(spark, sf_dir, "pages")), folder)
    records = read_records(normalised(archives, folder))
    return records.select(
        F.expr("try_cast(record AS BIGINT)").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.expr("try_cast(refers_to AS BIGINT)").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda c:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(hex, (g * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * c)::INT) & 31) + 1)::INT, 1)),
         'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM f
"""
