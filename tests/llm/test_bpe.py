import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(), st.text("ab 'sl\n\t1!<|endoftx>"), st.lists(st.sampled_from(["<|endoftext|>", " the", "'ll", "  ", "é", " ", "x"])).map("".join)))
def test_like_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    mine, other = bpe.vocabulary(PATH), tokenizers.Tokenizer.from_file(PATH) if not hasattr(test_like_the_library, "t") else test_like_the_library.t
    test_like_the_library.t = other
    ids = other.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == other.decode(ids, skip_special_tokens=False)


def test_long_pre_token(library):
    for text in ("a" * 5000, "abcde" * 1000, "日" * 999):
        assert bpe.vocabulary(PATH).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_cache_bound_changes_nothing():
    small = bpe.BytePairs(PATH, max_cached=2)
    text = "one two three one two three one"
    assert small.encode(text) == bpe.vocabulary(PATH).encode(text) and len(small.cache) <= 2


def test_every_document(small, library):
    rows = {r.doc_id: r for r in bpe.digest(small).collect()}
    for r in small.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert rows[r.doc_id].n_tokens == len(ids)
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, empty):
    assert bpe.digest(odd).count() == odd.count()
    assert bpe.digest(empty).count() == 0
    for r in bpe.encode(odd).join(odd.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        assert r.decoded == (r.text or "") and (r.text or not r.ids)
