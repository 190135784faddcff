"""Operator 1: dictionary-compressed WARC archives.

Pages become WARC/1.1 records: ``response`` with the payload, or ``revisit`` where an equal
payload of at least ``LEAST_REVISIT`` bytes is kept by another record (of equal payloads, that of
the largest page_id is the response).  A task gathers records up to ``ARCHIVE_BYTES``, trains a
Zstandard dictionary on records spread evenly over them (``DICTIONARY_SAMPLE`` bytes at most),
writes it as a leading skippable frame and compresses each record as a frame of its own, so that
any record can be read at its offset.  An archive whose records are too few or too alike to
train on has no dictionary and no leading frame.

Archives go to a folder that the cluster shares, through Arrow's file systems (``file``,
``hdfs``, ``s3``, ``gs``).  A file's name carries the task attempt; the manifest, one row per
archive, lists only files of attempts that succeeded, and readers go by the manifest.

Defined cases: a null html is an empty payload; a null url has no target URI; a null page_id is
a record without one and counts as the smallest; rows that repeat page and payload are all the
response (all records of the largest page_id are); other columns are ignored; an empty table
gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm.tables import stored, table
from custlens.session import delete_at_exit, scratch_path

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 32 << 10
DICTIONARY_SAMPLE = 100 * DICTIONARY_BYTES
LEVEL = 3
DICTIONARY_MAGIC = 0x184D2A5D   # the skippable frame that holds a dictionary
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

MANIFEST = "archive string, n_records bigint, raw_bytes bigint, stored_bytes bigint, dictionary_bytes bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, archive string"


def with_record_types(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, digest, record_type, refers_to`` of every page.

    Which payloads occur more than once is found on their digests; payloads move only if Spark
    sorts for the join because those digests are too many to broadcast.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"))
    base = base.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")})
    shared = base.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    shared = stored(shared.select("digest", "payload_bytes", "keeper"), "warc-shared")
    out = base.join(shared, ["digest", "payload_bytes"], "left")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return out.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "digest",
                      F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keeper")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; ``digest`` is the payload's SHA-1 in hex."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <{_urn(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Bytes: {size}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URI)}")
    block = HTTP_HEAD + f"Content-Length: {size}\r\n\r\n".encode()
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    else:
        block += payload
    head.append(f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


_URI = "%:/?#[]@!$&'()*+,;=-._~"


def _urn(page_id: int | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def _page_of(urn: bytes) -> int | None:
    page = urn.strip(b"<>").rpartition(b":")[2]
    return None if page == b"none" else int(page)


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    total = sum(map(len, records))
    every = max(1, -(-total // DICTIONARY_SAMPLE))
    sample = records[::every]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), sample)
    except zstandard.ZstdError:   # too little to learn from
        return None


def write_archive(to, records: list[bytes]) -> int:
    """Writes an archive to a binary file; returns the dictionary's size."""
    dictionary = train(records)
    size = 0
    if dictionary is not None:
        raw = dictionary.as_bytes()
        size = len(raw)
        to.write(struct.pack("<II", DICTIONARY_MAGIC, size) + raw)
        dictionary.precompute_compress(level=LEVEL)
        compress = zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_checksum=True).compress
    else:
        compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
    for r in records:
        to.write(compress(r))
    return size


def read_archive(file) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header fields, block) of each record; the stream is read once, a record at a time."""
    head = file.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        dictionary = zstandard.ZstdCompressionDict(file.read(struct.unpack("<I", head[4:])[0]))
        rest = file
    else:
        rest = _Chained(head, file)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(rest, read_across_frames=True)
    lines = io.BufferedReader(reader, 1 << 18)
    while lines.readline():   # the version line
        fields = {}
        while (line := lines.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b": ")
            fields[name] = value
        block = lines.read(int(fields[b"Content-Length"]))
        lines.read(4)
        yield fields, block


class _Chained:
    """A file whose first bytes have been read."""

    def __init__(self, head: bytes, file):
        self.head, self.file = head, file

    def read(self, n: int = -1) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out
        return self.file.read(n)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes all pages as archives under ``folder`` (a shared one); returns the manifest."""
    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        waiting: list[bytes] = []
        size = n = 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting, size, n
            name = f"pages-{task.partitionId():06d}-{n:04d}-{task.taskAttemptId()}.warc.zst"
            with files.open_output_stream(f"{root}/{name}", compression=None) as to:
                dictionary = write_archive(to, waiting)
                stored_bytes = to.tell()
            row = [[f"{folder}/{name}"], [len(waiting)], [size], [stored_bytes], [dictionary]]
            waiting, size, n = [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if i == 0 else pa.int64()) for i, v in enumerate(row)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                r = record(*row)
                waiting.append(r)
                size += len(r)
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if waiting:
            yield flush()

    return stored(with_record_types(pages).mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives in ``manifest``.  A response's digest and size are
    those of the payload that was read, and must be those of its header."""
    def run(batches):
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for archive in b.column("archive").to_pylist():
                files, path = fs.FileSystem.from_uri(archive)
                rows = []
                with files.open_input_stream(path, compression=None) as file:
                    for fields, block in read_archive(file):
                        kind = fields[b"WARC-Type"].decode()
                        said = base64.b32decode(fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:")).hex()
                        size = int(fields[b"X-Payload-Bytes"])
                        refers_to = None
                        if kind == "revisit":
                            refers_to = _page_of(fields[b"WARC-Refers-To"])
                        else:
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (hashlib.sha1(payload).hexdigest(), len(payload)) != (said, size):
                                raise ValueError(f"{archive}: {fields[b'WARC-Record-ID'].decode()} is damaged")
                        url = fields.get(b"WARC-Target-URI")
                        rows.append((_page_of(fields[b"WARC-Record-ID"]), size, said, kind, refers_to, url and url.decode(), archive))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    archives = manifest.select("archive")
    return archives.repartition(max(1, archives.count())).mapInArrow(run, RECORDS)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = delete_at_exit(spark, scratch_path(spark, "warc"))   # the query keeps no archives
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
