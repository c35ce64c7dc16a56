import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tallyloom.llm import importance

SCHEMA = "doc_id bigint, text string"


def grams(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    texts = [(d, *grams(t, longest)) for d, t in docs]
    s, t = Counter(bucket(g) for _, _, gs in texts for g in gs), Counter(bucket(g) for x in target for g in grams(x, longest)[1])
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for d, words, gs in texts:
        weight = sum(gain[bucket(g)] for g in gs)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("longest", [1, 2])
def test_brute_force(spark, small, odd, longest):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = [r.text for r in target.collect()]
    for docs in (small, odd):
        got = importance.resample(docs, target, longest=longest).collect()
        assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], texts, longest)


def test_copies_count_and_meet_as_one_hot_group(spark):
    rows = [(k, "Same old words Again " * 6 if k % 3 else f"text number {k} " + "x y z " * 7) for k in range(4000)] + [(k, None) for k in range(4000, 4010)]
    target = [("same old",), (None,), ("",), ("number 7 ÄÖ",)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = importance.resample(docs, spark.createDataFrame(target, "text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, [t for (t,) in target])


def test_ties_go_to_the_smaller_id_and_repeated_rows_stay(spark):
    rows = [(1, "a b c d e " * 5)] * 30 + [(2, "a b c d e " * 5)] * 10
    got = importance.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "text string")).collect()
    assert len(got) == 40 and sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4] and sorted(map(tuple, got), key=str) == brute(rows, [])


def test_empty_tables_and_null_targets(spark, empty, small):
    none = spark.createDataFrame([(None,)], "text string")
    assert importance.resample(empty, none).count() == 0
    assert importance.resample(small, none).count() == small.count()


def test_sample_keeps_rows_of_the_target_kind(spark):
    rows = [(k, ("zebra lion tiger " if k < 50 else "pipe valve pump ") * 10) for k in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rank", "2 as weight")
    kept = importance.sample(docs, spark.createDataFrame([("lion zebra " * 9,)], "text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(50))
