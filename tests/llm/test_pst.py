import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import pst


def is_held(doc_id):
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def brute(rows):
    """The contract's base, and the suffix tree by dictionaries of byte strings."""
    train = [r for r in rows if not is_held(r.doc_id)]
    tokens = lambda r: [*(r.text or "").encode().lower().split(), b"\n"]
    words = Counter(w for r in train for w in tokens(r))
    n, v = sum(words.values()), len(words)
    nexts = defaultdict(Counter)
    seq = lambda r: b"\n" * pst.DEPTH + b" ".join(tokens(r)[:-1]) + b"\n"
    for r in train:
        s = seq(r)
        for i in range(pst.DEPTH, len(s)):
            for k in range(pst.DEPTH + 1):
                nexts[s[i - k : i]][s[i]] += 1

    def retained(c):
        if not c:
            return bool(nexts[c])
        here, up = nexts.get(c), nexts.get(c[1:])
        if not here:
            return False
        a, b = sum(here.values()), sum(up.values())
        return sum(x * math.log((x / a) / (up[y] / b)) for y, x in here.items()) > pst.GAIN

    keep = {}

    def p(c, y):
        if c not in keep:
            keep[c] = retained(c)
        up = p(c[1:], y) if c else 1 / 256
        if not keep[c]:
            return up
        here = nexts[c]
        return (here[y] + len(here) * up) / (sum(here.values()) + len(here))

    out = []
    for r in rows:
        s = seq(r)
        t = tokens(r)
        f, at, score, spelled = 1 / (n + v + 1), pst.DEPTH, 0.0, 0.0
        for k, w in enumerate(t):
            token = w if k >= len(t) - 1 else w + b" " if k < len(t) - 2 else w
            spell = sum(math.log10(p(s[i - pst.DEPTH : i], s[i])) for i in range(at, at + len(token)))
            at += len(token)
            spelled += spell
            score += spell if k == len(t) - 1 else spell + math.log10(1 - 2 * f) if w in words else math.log10(f)
        out.append((r.doc_id, is_held(r.doc_id), len(t), sum(w in words for w in t), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t), score, spelled))
    return sorted(out, key=str)


def test_against_brute_force(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    for some in (docs, odd.filter("doc_id is null or doc_id not in (7, 8)")):
        got = sorted(map(tuple, pst.score(some).collect()), key=str)
        want = brute(some.collect())
        key = lambda r: (str(r[0]), r[2], round(r[5], 3))
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_held_out_texts_score_better_than_base(spark):
    rows = pst.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.score < 0 and r.spelled_score < 0 for r in rows)


def test_distributions_sum_to_one(spark):
    counts = Counter()
    for text in ("the cat sat", "the dog sat", "a cat ran"):
        counts.update(pst.grams([text.encode()])[0].tolist())
    context = b"\nthe "[-pst.DEPTH :]
    base = int.from_bytes(context, "big") << 8
    grams = [(g, n) for g, n in counts.items()] + [(base | y, 0) for y in range(256) if base | y not in counts]
    rows = pst.suffix_tree(spark.createDataFrame(grams, "gram long, n long"), 0.1).collect()
    assert sum(10**r.lp for r in rows if r.gram >> 8 == base >> 8) == pytest.approx(1)


def test_parts_and_early_counts_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r for r in pst.score(docs).collect()}
    monkeypatch.setattr(pst, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(pst, "HELD_ENTRIES", 100)
    assert pst._blocks(docs).select("block").distinct().count() > 3
    for r in pst.score(docs).collect():
        assert r[:5] == want[r.doc_id][:5] and r[5:] == pytest.approx(want[r.doc_id][5:])


def test_blocks_do_not_depend_on_splits(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1).write.option("parquet.block.size", 20_000).parquet(path)
    seen = set()
    for split in ("128m", "30k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            docs = spark.read.parquet(path)
            seen.add((docs.rdd.getNumPartitions() > 1, frozenset((r.doc_id, r.block) for r in pst._blocks(docs).select("doc_id", "block").collect())))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({split for split, _ in seen}) == 2 and len({blocks for _, blocks in seen}) == 1


def test_grams_of_many_texts():
    texts = [b"", b"a", b"the cat", b"", b"x" * 20, b""]
    codes, starts = pst.grams(texts)
    want = []
    for t in texts:
        s = b"\n" * pst.DEPTH + t + b"\n"
        want.append([int.from_bytes(s[i - pst.DEPTH : i + 1], "big") for i in range(pst.DEPTH, len(s))])
    assert [x.tolist() for x in pst.np.split(codes, starts[1:])] == want
    assert [*pst._parts([b"a" * 400_000, b"b" * 400_000, b"", b"c"])] == [(0, 1), (1, 4)] and [*pst._parts([])] == [] and [*pst._parts([b""])] == [(0, 1)]


def test_a_missing_answer_is_an_error():
    words = pa.record_batch({"block": pa.array([1], pa.int64()), "kind": pa.array([0], pa.int32()), "id": pa.array([5], pa.int64()), "value": pa.array([None], pa.float32()), "held": pa.array([None], pa.bool_()), "body": pa.array([b"\n"], pa.binary())})
    grams = pa.record_batch({"block": pa.array([1], pa.int64()), "kind": pa.array([1], pa.int32()), "id": pa.array([7], pa.int64()), "value": pa.array([-1.0], pa.float32()), "held": pa.array([None], pa.bool_()), "body": pa.array([None], pa.binary())})
    text = pa.record_batch({"block": pa.array([1], pa.int64()), "kind": pa.array([2], pa.int32()), "id": pa.array([0], pa.int64()), "value": pa.array([None], pa.float32()), "held": pa.array([False], pa.bool_()), "body": pa.array([b""], pa.binary())})
    with pytest.raises(ValueError, match="didn't ask"):
        list(pst._score(0.1, 5)(iter([words, grams, text])))


def test_empty(empty, spark):
    assert pst.score(empty).count() == 0
    held = next(i for i in range(100) if is_held(i))
    row = pst.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert row.train_tokens == 0 and row.spelled_score == pytest.approx(3 * math.log10(1 / 256)) and row.score == pytest.approx(math.log10(1 / 256))


def test_words_have_one_hash_wherever_they_stand():
    words = [b"a", b"ab", b"ba", b"a\xc3\xa9", b"\x00", b"\x00\x00", b"abab" * 50, b"a"]
    raw = np.frombuffer(b"\n" + b" ".join(words) + b" " + b"\n".join([*words, b""]) + b"\n", np.uint8)
    for multiplier in pst._MULTIPLIERS:
        hashes, begins, stops = pst.word_hashes(raw, multiplier)
        assert [raw[a:b].tobytes() for a, b in zip(begins, stops, strict=True)] == words * 2
        assert (hashes[:8] == hashes[8:]).all() and len(set(hashes.tolist())) == 7
    assert all(len(x) == 0 for x in pst.word_hashes(np.frombuffer(b"\n \n", np.uint8), 3)) and len(pst.word_hashes(np.frombuffer(b"", np.uint8), 3)[0]) == 0
