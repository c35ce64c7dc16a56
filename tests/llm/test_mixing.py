from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing


def targets(sizes):
    """Water-filling by repetition."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    left, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in capped]
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if got[s] > 3 * sizes[s]]
        if not over:
            return capped | got
        for s in over:
            capped[s] = 3.0 * sizes[s]
            left -= capped[s]


def test_against_brute_force(small, odd):
    for docs in (small, odd):
        rows = mixing.mix_report(docs).collect()
        assert len(rows) == docs.count()
        by = defaultdict(list)
        for r in rows:
            by[r.source].append(r)
        want = targets({s: sum(r.size for r in x) for s, x in by.items()})
        for s, x in by.items():
            total, taken = sum(r.size for r in x), sum(r.taken for r in x)
            assert x[0].source_size == total and x[0].target == pytest.approx(want[s])
            assert abs(taken - want[s]) <= max(r.size for r in x) * max(1, sum(1 for r in x if r.key == max(x, key=lambda r: r.size).key))
            assert all(r.taken <= 3 * r.size for r in x)
            epochs = int(want[s] / total) if total else 0
            extra = [r.size > 0 and r.taken > epochs * r.size for r in sorted((r for r in x if r.size), key=lambda r: r.key)]
            assert extra == sorted(extra, reverse=True), "a prefix by key"


def test_reruns_agree_and_mix_follows_the_report(small, odd, empty):
    assert sorted(map(str, mixing.mix_report(small).collect())) == sorted(map(str, mixing.mix_report(small.repartition(7)).collect()))
    for docs in (small, odd):
        copies = defaultdict(int)
        for r in mixing.mix(docs).collect():
            copies[r.doc_id] += 1
        want = defaultdict(int)
        for r in mixing.mix_report(docs).collect():
            want[r.doc_id] += r.taken // r.size if r.size else 0
        assert copies == {k: v for k, v in want.items() if v}
        assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_many_sources_and_hot_ones_meet_by_salt(spark, small, odd, monkeypatch):
    docs = odd.withColumn("source", F.lit("hot")).unionByName(odd)
    want = sorted(map(str, mixing.mix_report(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_report(docs).collect())) == want


def test_clashing_names(spark, small):
    docs = small.limit(20).selectExpr("*", "1 as __source", "2 as __id", "3 as id", "4 as bucket", "5 as row", "6 as c0", "7 as copies", "8 as salt", "9 as name")
    got = mixing.mix(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} <= {r.doc_id for r in docs.collect()}
    assert {tuple(r[5:]) for r in got.collect()} == {tuple(range(1, 10))}


def test_low_quality_spreads_over_buckets(spark):
    """Texts of digits have keys of another scale; their prefix is found just as well."""
    rows = [(i, "1234567890 " * 20, None, "ab"[i % 3 == 0], 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing._draws(docs, 17).groupBy("bucket").count().agg(F.max("count")).first()[0] < 30
    for r in mixing.mix_report(docs).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 20


def test_weights_pull(spark):
    rows = [(i, "word " * 10 + ("# " * 300 if i % 2 else ""), None, "a" if i < 400 else "b", 0) for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {0: 0, 1: 0}
    for r in mixing.mix_report(docs).filter("source = 'a' and taken > 0").collect():
        kept[r.doc_id % 2] += 1
    assert kept[0] > kept[1]
