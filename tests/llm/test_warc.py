"""WARC write, index and range reads against plain Python."""

import base64
import gzip
import hashlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare, duck

from tablab.llm.queries import ORACLE, QUERIES
from tablab.llm.storage import filesystem
from tablab.llm.warc import coalesce_ranges, read_records, write_archives

SF = "/root/testdata/sf0.001"


def brute(rows, least=0):
    """rows: (key, html).  Key, bytes, digest, type, refers_to of each."""
    keeper = {}
    for k, h in rows:
        h = h or ""
        if k is not None and len(h.encode()) >= least:
            keeper[h] = min(k, keeper.get(h, k))
    out = []
    for k, h in rows:
        data = (h or "").encode()
        to = keeper.get(h or "") if len(data) >= least else None
        to = None if to == k else to  # a null key revisits too: it is not the smallest
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if to is not None else "response", to))
    return Counter(out)


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    rows = QUERIES["op1_warc"](spark, SF)
    assert rows.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, rows.collect())) == brute(pages)
    ok, message = compare(rows, duck(SF), ORACLE["op1_warc"])
    assert ok, message


@pytest.mark.parametrize("least", [0, 5])
def test_copies_and_odd_pages(spark, tmp_path, least):
    rows = [(9, "same"), (3, "same"), (5, "same"), (3, "same"), (None, "lonely"), (None, "same"), (1, None), (2, ""), (7, "é\r\n\r\nWARC/1.1\r\n" * 30000),
            (8, "long enough"), (10, "long enough")]
    pages = spark.createDataFrame([(k, f"http://x/{i}\r\ny" if i else None, h, "clash") for i, (k, h) in enumerate(rows)], "page_id long, url string, html string, file string")
    index = write_archives(pages, f"{tmp_path}/a", min_payload=least)
    got = read_records(index)
    fields = [tuple(r[c] for c in ("record_key", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()]
    assert Counter(fields) == brute(rows, least)
    texts = {(r.record_key, r.payload) for r in got.collect() if r.record_type == "response"}
    assert texts <= {(k, h or "") for k, h in rows}
    chosen = read_records(index.where("record_key = 7")).collect()
    assert len(chosen) == 1 and chosen[0].payload == rows[8][1]
    assert read_records(write_archives(pages.limit(0), f"{tmp_path}/b")).count() == 0


def test_archives_are_valid_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "body %d" % (i % 3)) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    index = sorted(write_archives(pages, str(tmp_path / "w")).collect(), key=lambda r: r.offset)
    system, path = filesystem(index[0].file)
    data = system.open_input_file(path).read()
    assert sum(r.length for r in index) == len(data)
    plain = gzip.decompress(data)
    assert plain.count(b"WARC/1.1\r\n") == 20 and plain.count(b"WARC-Type: revisit") == 17
    assert sorted(r.url for r in index) == sorted(f"http://x/{i}" for i in range(20))


def test_ranges_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 500_000, 5), ("b", 0, 20 << 20), ("b", 20 << 20, 7)]
    reads = [(f, s, e, len(r)) for f, s, e, r in coalesce_ranges(rows)]
    assert reads == [("a", 0, 20, 2), ("a", 500_000, 500_005, 1), ("b", 0, 20 << 20, 1), ("b", 20 << 20, (20 << 20) + 7, 1)]


def test_tasks_follow_the_bytes_named_not_the_index(spark, tmp_path):
    """An index of a few rows a megabyte is read by as many tasks as its archives have task sizes."""
    from tablab.llm.storage import tasks_for
    from tablab.llm.warc import read_records, write_archives

    rng = np.random.default_rng(4)
    rows = [(i, f"u{i}", rng.bytes(6000).hex()) for i in range(640)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = write_archives(pages, str(tmp_path / "a"))
    size = index.agg({"length": "sum"}).first()[0]
    read = read_records(index, task_bytes=size // 63)
    assert read.rdd.getNumPartitions() >= 60
    assert read.where("payload is not null").count() == 640
    assert tasks_for(None) == tasks_for(0) == 1 and tasks_for(64 << 20, 1 << 20) == 64


def test_null_key_revisits_an_equal_payload(spark, tmp_path):
    from tablab.llm.warc import archive_and_read

    pages = spark.createDataFrame([(None, "a", "same"), (7, "b", "same"), (9, "c", "same"), (None, "d", "alone"), (None, "e", None), (None, "f", None)],
                                  "page_id long, url string, html string")
    got = sorted((r.url, r.record_type, r.refers_to) for r in archive_and_read(pages).collect())
    assert got == [("a", "revisit", 7), ("b", "response", None), ("c", "revisit", 7), ("d", "response", None), ("e", "response", None), ("f", "response", None)]
