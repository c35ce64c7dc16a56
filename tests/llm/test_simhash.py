import itertools
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import simhash
from tallyloom.llm.components import components


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, pairs):
    root = {n: n for n in nodes}
    for a, b in pairs:
        ra, rb = root[a], root[b]
        if ra != rb:
            root = {n: min(ra, rb) if r in (ra, rb) else r for n, r in root.items()}
    return root


def test_keys_lose_no_link():
    assert len(simhash.KEYS) == 14
    for differing in itertools.combinations(range(8), 3):
        assert any(not set(s) & set(differing) for s in simhash.KEYS)


def test_fingerprints_match_spark_and_plain(small, odd):
    got = {r.doc_id: r.fp for r in simhash.fingerprints(small).collect()}
    for r in small.collect():
        assert int.from_bytes(got[r.doc_id], "big") == plain_simhash(r.text)
    text = small.select("text").first().text.encode().lower().split()
    assert small.sparkSession.range(1).select(F.xxhash64(F.lit(b" ".join(text[:3]).decode()))).first()[0] & (2**64 - 1) == int(simhash.shingle_hashes(b" ".join(text[:3]).decode(), 3)[0])


def test_components_against_brute_force(small, odd):
    for docs in (small, odd):
        rows = docs.collect()
        fp = {r.doc_id: plain_simhash(r.text) for r in rows if r.doc_id is not None}
        want = union(fp, [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 3])
        got = simhash.near_duplicates(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == want.get(r.doc_id)
            assert r.doc_id is None or r.fingerprint == f"{fp[r.doc_id]:016x}"


def test_hot_posting_list_in_chunks(spark):
    """One ball of fingerprints, far over a chunk, and strays: the components are those of all pairs."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 300:
        x = base
        for b in rng.sample(range(20), rng.choice([2, 3, 4, 6])):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, bytearray(x.to_bytes(8, "big"))) for i, x in enumerate(fps)], "rep long, fp binary")
    want = union(range(len(fps)), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    for chunk in (7, 64, 512):
        edges = simhash.link(nodes, simhash.KEYS, 5, 3, chunk)
        got = {r.node: r.component for r in components(edges).collect()}
        assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_hubs_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tallyloom.llm.components.HUB", 10)
    edges = spark.createDataFrame([(i, 500) for i in range(3, 300)] + [(1000 + i, 1001 + i) for i in range(4)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 3 for i in [*range(3, 300), 500]} | {1000 + i: 1000 for i in range(5)}


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)}
    assert components(edges.limit(0)).count() == 0
    assert components(spark.createDataFrame([(None, 1), (2, None), (None, None), (3, 3)], "a long, b long")).count() == 0


def jaccard(a, b, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, origin = [], []
    for n in range(60):
        base = [word() for _ in range(rng.choice([60, 200, 900]))]
        texts.append(" ".join(base))
        origin.append(n)
        for _ in range(n % 4):
            copy = list(base)
            for _ in range(max(1, len(copy) // 100)):
                copy[rng.randrange(len(copy))] = word()
            if jaccard(" ".join(base), " ".join(copy)) >= 0.83:
                texts.append(" ".join(copy))
                origin.append(n)
    shared = " ".join(word() for _ in range(80))
    for n in range(10):  # a passage in common is no copy
        texts.append(" ".join(word() for _ in range(200)) + " " + shared)
        origin.append(1000 + n)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter(origin[r.doc_id] for r in simhash.drop_near_copies(docs).collect())
    assert set(kept) == set(origin)
    assert sum(kept.values()) <= len(kept) + 1


def test_pairs_about_the_bar_against_brute_force(spark):
    """Pairs from 0.77 to 0.83, and chains of them: exactly the links of 0.8 or more count."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, near = [], Counter()
    for n in range(150):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(1 + n % 2):
            edits, copy = 0, list(base)
            while True:
                copy[rng.randrange(200)] = word()
                edits += 1
                if (like := jaccard(texts[-1], " ".join(copy))) < 0.83 and (like < 0.8 or rng.random() < 0.5):
                    break
            near[like >= 0.8] += like >= 0.77
            texts.append(" ".join(copy))
    assert min(near.values()) > 40
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    like = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    want = union(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a + 1, min(a + 3, len(texts))) if like(a, b)])
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == set(want.values())


def test_verified_in_chunks(spark):
    """A group far over a chunk keeps the links between its chunks."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            copy[rng.randrange(120)] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    want = union(range(60), [(a, b) for a, b in itertools.combinations(range(60), 2) if jaccard(texts[a], texts[b]) >= 0.8])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (7, 16):
        assert {r.doc_id for r in simhash.drop_near_copies(docs, chunk=chunk).collect()} == set(want.values())


def test_a_chain_of_20_000_texts_is_one_group(spark):
    """Each is alike to its neighbours only: the work is that of the links, not of all pairs of the chain."""
    words = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), (F.col("id") * 9 + i).cast("string")))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    assert [r.doc_id for r in simhash.drop_near_copies(docs).collect()] == [0]


def test_texts_about_one_form_stay(spark):
    """Most pairs are candidates and none are alike, but for two copies: each is compared where it meets the others."""
    form = [f"f{i}" for i in range(150)]
    texts = [" ".join(form[:75] + [f"own{n}x{i}" for i in range(26)] + form[75:]) for n in range(150)]
    texts += [texts[0].replace("own0x5 ", ""), texts[40].replace("own40x25", "changed")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = union(range(len(texts)), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8])
    assert 140 < len(set(want.values())) < len(texts)
    for chunk in (16, 512):
        assert {r.doc_id for r in simhash.drop_near_copies(docs, chunk=chunk).collect()} == set(want.values())


def test_sketch_estimates_jaccard():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    other = list(words)
    for i in range(0, 2000, 45):
        other[i] = "zz"
    a, b = (np.frombuffer(simhash.sketch(" ".join(w)), np.uint8) for w in (words, other))
    assert abs((a == b).mean() - jaccard(" ".join(words), " ".join(other))) < 0.1


def test_odd_rows_of_the_stage(odd, empty):
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 7 in ids and 8 not in ids and 14 not in ids and ids.count(None) == 2 and {1, 2, 3} <= set(ids)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0
