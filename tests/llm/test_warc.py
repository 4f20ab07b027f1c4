import functools
import gzip
import hashlib
import io
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm import warc
from terralens.llm.scratch import new_path

PAGES = "/root/testdata/sf0.01/pages.parquet"


def brute(rows):
    raw = {p: (h or "").encode() for p, _, h in rows}
    last = {}
    for p, b in raw.items():
        if len(b) >= 1000:
            last[b] = max(p, last.get(b, p))
    return {p: (len(b), hashlib.sha1(b).hexdigest(), "revisit" if last.get(b, p) != p else "response", last[b] if last.get(b, p) != p else None) for p, b in raw.items()}


def rows_of(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_table(spark):
    t = pq.read_table(PAGES, columns=["page_id", "url", "html"])
    want = brute(list(zip(*(c.to_pylist() for c in t.columns), strict=True)))
    got = warc.archive_and_read(spark.read.parquet(PAGES))
    assert got.count() == len(want) and rows_of(got) == want


def test_edges_and_chunks(spark):
    big = "é<p>" * 100000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "u", None), (2, None, ""), (3, "http://x/é\r\nEvil: 1", "a" * 999), (4, "u", "a" * 999), (5, "u", big), (6, "u", big), (7, "u", "b" * 65536), (8, "u", "b" * 65536), (9, "u", "b" * 131072), (10, "u", big)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, sha1 string")
    manifest = warc.write_archives(pages, new_path(spark, "warc"))
    assert sum(r.records for r in manifest.collect()) == len(rows)
    chunks = warc.read_archives(manifest)
    assert rows_of(warc.payloads(chunks)) == brute(rows)
    assert chunks.selectExpr("max(octet_length(data))").first()[0] <= warc.CHUNK
    parts = sorted((r.chunk_no, bytes(r.data), r.digest_so_far) for r in chunks.where("page_id = 10").collect())
    assert len(parts) > 5 and [p[0] for p in parts] == list(range(len(parts)))
    so_far = b""
    for _, data, digest in parts:
        so_far += data
        assert hashlib.sha1(so_far).hexdigest() == digest
    assert so_far == big.encode()
    assert warc.archive_and_read(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", "c" * 2000), (1, "u", "c" * 2000), (0, "u", "c" * 2000)], "page_id long, url string, html string")
    assert sorted(r.record_type for r in warc.archive_and_read(twice).collect()) == ["response", "response", "revisit"]


def test_file_is_plain_warc(spark):
    pages = spark.createDataFrame([(1, "http://x/", "<p>hi")], "page_id long, url string, html string")
    path = re.sub("^file:/+", "/", warc.write_archives(pages, new_path(spark, "warc")).first().path)
    text = gzip.open(path).read()
    assert text.count(b"WARC/1.1\r\n") == 2 and b"\r\n\r\n<p>hi\r\n\r\n" in text
    assert [x[2] for x in warc.read_records(io.BytesIO(open(path, "rb").read()))] == [b"", b"<p>hi"]


def test_files_are_read_in_parallel_and_whole(spark):
    """Eight archives are read by several tasks; a file that is cut anywhere, or lacks a record, raises."""
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k} " * (k * 40)) for k in range(64)], "page_id long, url string, html string")
    parts = [warc.write_archives(pages.where(F.col("page_id") % 8 == k), new_path(spark, "warc")) for k in range(8)]
    manifest = functools.reduce(DataFrame.unionByName, parts)
    files = [r.path for r in manifest.collect()]
    chunks = warc.read_archives(manifest)
    assert chunks.rdd.getNumPartitions() == len(files) == 8 and all(p.startswith("file:/") for p in files)
    tasks = chunks.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == 8
    whole = open(re.sub("^file:/+", "/", files[0]), "rb").read()
    n = len(list(warc.read_records(io.BytesIO(whole))))
    for cut in (5, 30, len(whole) // 2, len(whole) - 20, len(whole) - 1):
        with pytest.raises(EOFError):
            list(warc.read_records(io.BytesIO(whole[:cut])))
    assert n > 1
    more = manifest.withColumn("records", F.col("records") + 1)
    with pytest.raises(Exception, match="records"):
        warc.read_archives(more).count()


def test_null_and_repeated_page_ids(spark):
    big = "d" * 3000
    rows = [(None, "u", big), (None, "u", big), (4, "u", big), (4, "u", big), (2, "u", big), (None, "u", "e" * 2000)]
    got = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in got) == sorted(
        [("None", 3000, "revisit", "4")] * 2 + [("4", 3000, "response", "None")] * 2 + [("2", 3000, "revisit", "4"), ("None", 2000, "response", "None")])


def test_a_chunk_that_is_missing_is_noticed(spark, tmp_path):
    w = warc.Writer(f"file://{tmp_path}")
    w.begin(1, "u", 10, hashlib.sha1(b"0123456789").hexdigest(), None)
    w.chunk(memoryview(b"01234"))
    with pytest.raises(ValueError):
        w.chunk(memoryview(b"56780"))
