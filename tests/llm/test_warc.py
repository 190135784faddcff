import hashlib
import io
import struct

import zstandard
from pyspark.sql import functions as F

from custlens.llm.warc import DICTIONARY_MAGIC, op1, read_archive, read_archives, record, with_record_types, write_archive, write_archives
from tests.llm.common import folder, sentence

import random


def pages(spark, extra=True):
    rng = random.Random(4)
    big = [f"<html>{sentence(rng, 300)}</html>" for _ in range(30)]
    rows = [(i, f"http://h/{i}?q=é x\r\n", t) for i, t in enumerate(big)]
    rows += [(100 + i, "http://copy/", big[0]) for i in range(40)] + [(200, None, "small"), (201, "u", "small"), (202, "u", None), (203, "u", ""), (None, "u", big[1]), (204, "u", "x" * 999), (205, "u", "x" * 999), (206, "u", "é" * 500), (207, "u", "é" * 500), (207, "u", "é" * 500)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return df.withColumns({"digest": F.lit(1), "payload": F.lit("x"), "keeper": F.lit(2)}) if extra else df


def expected(rows):
    best = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            best[b] = max(best.get(b, -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        keep = best.get(b)
        again = keep is not None and keep != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=repr)


def test_written_and_read_back(spark, tmp_path):
    df = pages(spark)
    out = op1(spark, folder(df, tmp_path, "pages"))
    assert sorted(map(tuple, out.collect()), key=repr) == expected([(r.page_id, r.url, r.html) for r in df.collect()])


def test_records_and_dictionary_on_disk(spark, tmp_path):
    df = pages(spark, extra=False).coalesce(1)
    manifest = write_archives(df, f"file://{tmp_path}/archives").collect()
    assert len(manifest) == 1 and manifest[0].n_records == df.count()
    raw = open(manifest[0].archive.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == DICTIONARY_MAGIC and size == manifest[0].dictionary_bytes > 0
    dictionary = zstandard.ZstdCompressionDict(raw[8:8 + size])
    one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    first = one.decompress(raw[8 + size:])   # the first record is a frame of its own
    assert first.startswith(b"WARC/1.1\r\n") and first.endswith(b"\r\n\r\n") and one.unused_data.startswith(b"\x28\xb5\x2f\xfd")
    urls = {r.url for r in read_archives(spark.createDataFrame(manifest)).collect()}
    assert "http://h/0?q=%C3%A9%20x%0D%0A" in urls


def test_few_records_have_no_dictionary():
    to = io.BytesIO()
    r = record(1, None, b"a", 1, hashlib.sha1(b"a").hexdigest(), "response", None)
    assert write_archive(to, [r]) == 0
    to.seek(0)
    (fields, block), = read_archive(to)
    assert fields[b"WARC-Type"] == b"response" and block.endswith(b"\r\n\r\na")


def test_no_pages(spark, tmp_path):
    assert op1(spark, folder(pages(spark).limit(0), tmp_path, "pages")).count() == 0
    assert with_record_types(pages(spark).limit(0)).count() == 0
