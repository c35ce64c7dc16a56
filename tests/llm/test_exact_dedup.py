import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_brute_force(small, odd):
    for docs in (small, odd):
        assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect()), key=str) == brute(docs.collect())


def test_hash_collisions_join_nothing(small):
    one_bucket = lambda text: F.lit(b"x")
    assert sorted(map(tuple, exact_dedup.exact_groups(small, one_bucket).collect()), key=str) == brute(small.collect())


def test_drop_copies(odd, empty):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len({r.text or "" for r in rows}) == len(rows) == len({r.text or "" for r in odd.collect()})
    assert {r.doc_id for r in rows} == {2, 3, None, 8, 9, 10, 11, 12, 13, 14}
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0
