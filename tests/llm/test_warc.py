import hashlib
import io
from collections import Counter, defaultdict

import zstandard
from pyspark.sql import functions as F

from tallyloom.llm import warc

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    same = defaultdict(list)
    for r in rows:
        same[(r.html or "").encode()].append(r.page_id)
    out = Counter()
    for r in rows:
        body = (r.html or "").encode()
        ids = [i for i in same[body] if i is not None]
        revisit = len(body) >= 1000 and bool(ids) and r.page_id != max(ids)
        out[r.page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None] += 1
    return out


def odd_pages(spark):
    big = "x" * 5000
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, big), (3, None, big), (4, "http://d", "s" * 999), (5, "http://e", "s" * 999), (6, "u", None), (7, "u", ""), (None, "u", big), (None, None, None), (9, "ü%41 x", "é\r\n\r\nWARC/1.1\r\n" * 90000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as bundle", "2 as digest", "3 as refers_to")


def test_round_trip(spark):
    for pages in (spark.read.parquet(f"{SMALL}/pages.parquet"), odd_pages(spark)):
        index = warc.archive(pages, bundle_bytes=60_000, frame_bytes=10_000)
        rows = warc.read_back(index).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == brute(pages.collect())
        assert Counter((r.page_id, r.url, (r.html or "").encode()) for r in pages.collect()) >= Counter((r.page_id, r.url, bytes(r.payload)) for r in rows if r.record_type == "response")
        assert Counter((r.page_id, r.url) for r in pages.collect()) == Counter((r.page_id, r.url) for r in rows)


def test_an_id_that_repeats_with_two_payloads(spark):
    a, b = "a" * 2000, "b" * 2000
    for rows in ([(5, "u", a), (5, "v", b), (9, "w", a), (None, "n", a)], [(5, "u", a), (5, "v", b), (9, "w", a), (10, "x", b)], [(None, "u", a), (None, "v", a), (None, None, b), (1, "x", b)]):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = warc.read_back(warc.archive(pages)).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(pages.collect())
        assert {bytes(r.payload) for r in got if r.record_type == "response"} == {a.encode(), b.encode()}


def test_each_record_id_names_one_record(spark):
    a, b = "a" * 2000, "b" * 2000
    rows = [(5, "u", a), (5, "v", b), (9, "w", a), (9, "w2", a), (None, "n", a), (None, "n2", a), (None, "m", b), (7, "s", "x"), (7, "s", "x"), (8, "t", "x"), (None, None, None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.archive(pages)
    heads = []
    for path in {r.bundle for r in index.collect()}:
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(path.removeprefix("file://"), "rb").read()), read_across_frames=True).read()
        heads += [dict(x.split(": ", 1) for x in part.split("\r\n\r\n")[0].split("\r\n")[1:]) for part in plain.decode().split("WARC/1.1\r\nWARC")[1:] for part in ["\r\nWARC" + part]]
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(heads) == len(ids) == len(rows)
    for h in heads:
        if h["WARC-Type"] == "revisit":
            named = ids[h["WARC-Refers-To"]]
            assert named["WARC-Type"] == "response" and named["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]


def test_index_and_frames(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    index = warc.archive(pages, bundle_bytes=60_000, frame_bytes=10_000)
    assert index.select("bundle").distinct().count() > 1 and index.agg(F.max("frame")).first()[0] > 1
    some = index.filter("page_id % 7 = 0")
    html = {r.page_id: r.html.encode() for r in pages.collect()}
    rows = warc.fetch(some).collect()
    assert {r.page_id for r in rows} == {r.page_id for r in some.collect()}
    assert all(bytes(r.payload) == html[r.page_id] for r in rows if r.record_type == "response")


def test_any_reader_reads_a_bundle(spark):
    index = warc.archive(spark.read.parquet(f"{SMALL}/pages.parquet"))
    path = index.first().bundle.removeprefix("file://")
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(path, "rb").read()), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n") and plain.count(b"WARC/1.1\r\nWARC-Type") == index.filter(F.col("bundle") == index.first().bundle).count()


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_back(warc.archive(none)).count() == 0
