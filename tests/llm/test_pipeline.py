import hashlib

import corpus_pipeline

from tallyloom.llm import bpe

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order(spark, small):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near-dedup", "mixing", "BPE encoding"]
    docs, sizes = small, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).persist()
        assert docs.columns == small.columns
        sizes.append(docs.count())
    assert sizes[0] >= 0.98 * small.count() and sizes[1] == small.select("text").distinct().count() and sizes[2] <= sizes[1]
    text = {r.doc_id: r.text for r in small.collect()}
    vocabulary = bpe.vocabulary(bpe.default_vocabulary())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(rows) == sizes[3]
    for r in rows[:30]:
        assert r.n_tokens == len(vocabulary.encode(text[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_odd_rows_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == docs.columns
            assert stage(spark, docs, SMALL).count() <= 3 * docs.count()
