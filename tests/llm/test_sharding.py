from collections import Counter
from zlib import crc32

from tallyloom.llm import queries, sharding


def test_law_of_rows(small, odd):
    for docs in (small, odd):
        rows = sharding.assign(docs, bucket_bytes=20_000).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1, crc32((r.text or "").encode())) for r in docs.collect())
        counts = Counter(r.shard for r in rows)
        assert max(counts.values()) - min(counts.get(k, 0) for k in range(8)) <= 1 and {r.law for r in rows} == {"rows"}
        assert {(r.shard, r.slot) for r in rows} == {(s, k) for s, n in counts.items() for k in range(n)}


def test_shuffled_and_repeatable(small):
    rows = sorted(sharding.assign(small, bucket_bytes=20_000).collect(), key=lambda r: (r.slot, r.shard))
    order = [r.doc_id for r in rows]
    assert order != sorted(order)
    assert abs(sum((a < b) for a, b in zip(order, order[1:], strict=False)) / len(order) - 0.5) < 0.15
    again = sorted(sharding.assign(small.repartition(5), bucket_bytes=20_000).collect(), key=lambda r: (r.slot, r.shard))
    assert [r.doc_id for r in again] == order


def test_native(small):
    plan = small.sparkSession._jvm.PythonSQLUtils.explainString(sharding.assign(small)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards(spark, odd, tmp_path):
    docs = odd.selectExpr("*", "'mine' as shard", "'own' as slot", "1 as __id", "2 as __crc", "3 as doc", "4 as bucket")
    sharding.write_shards(docs, f"file://{tmp_path}/shards", bucket_bytes=20_000)
    back = sharding.read_shards(spark, f"file://{tmp_path}/shards", docs.schema)
    assert Counter(r.doc for r in back.collect()) == Counter(docs.collect())
    assert {(r.shard, r.slot) for r in back.collect()} == {(r.shard, r.slot) for r in sharding.assign(docs, bucket_bytes=20_000).collect()}
    assert Counter((r.shard, r.slot) for r in back.collect()).most_common(1)[0][1] == 1


def test_equal_rows_spread_over_buckets(spark):
    docs = spark.createDataFrame([(None, "same text")] * 3000 + [(i, "own") for i in range(300)], "doc_id long, text string").repartition(3)
    slim = sharding.written(sharding._text_columns(sharding._own(docs), "place"))
    scatter = sharding.Scatter(slim, bucket_bytes=1000)
    assert scatter.hot.count() == 1 and scatter.buckets > 20
    assert max(r["count"] for r in scatter.scattered(slim).groupBy("bucket").count().collect()) < 300
    rows = sharding.assign(docs, bucket_bytes=1000).collect()
    assert Counter(r.shard for r in rows) == Counter({k: 413 if k < 4 else 412 for k in range(8)})
    assert {(r.shard, r.slot) for r in rows} == {(p % 8, p // 8) for p in range(3300)}


def test_query_reads_written_shards(spark, small, monkeypatch):
    paths, write = [], sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda docs, path: paths.append(path) or write(docs, path))
    rows = queries.op8_sharding(spark, "/root/testdata/sf0.001").collect()
    back = sharding.read_shards(spark, *paths, small.schema).select("doc.*", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.text) for r in small.collect())
    assert Counter((r.doc_id, len(r.text.encode()) + 1, crc32(r.text.encode()), r.shard, r.slot) for r in back) == Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows)
    assert {tuple(r) for r in rows} == {tuple(r) for r in sharding.assign(small).collect()}


def test_empty(spark, empty, tmp_path):
    assert sharding.assign(empty).count() == 0
    sharding.write_shards(empty, f"file://{tmp_path}/none")
    assert sharding.report_shards(spark, f"file://{tmp_path}/none", empty.schema).count() == 0
