import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import token_counts

COUNT = token_counts.counter(token_counts.default_ranks())
TEXT = st.one_of(st.text("ab 'sl\n\t1!é", max_size=40), st.lists(st.sampled_from(["don't ", "the cat ", "\n\n", "  ", "'", "ll", "a" * 300, " word word ", "1234", "　x"]), max_size=30).map("".join))


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 2000), st.integers(0, 2000), TEXT), max_size=6))
def test_edits_against_a_whole_count(text, edits):
    text = text * 8
    tree = token_counts.Tree(text, COUNT)
    assert tree.total == COUNT(text) and tree.chars[1] == len(text)
    for start, stop, new in edits:
        tree.edit(start, stop, new)
        start = min(start, len(text))
        text = text[:start] + new + text[max(start, min(stop, len(text))) :]
        assert "".join(tree.blocks) == text
        assert tree.total == COUNT(text)


def test_little_is_encoded_anew():
    rng = random.Random(1)
    tree = token_counts.Tree(" ".join("".join(rng.choices("abcdef", k=6)) for _ in range(20_000)), COUNT)
    tree.edit(70_000, 70_005, "new words")
    assert tree.encoded < 3 * token_counts.LEAF


def test_leaves_split():
    """Many edits at one place, and scripts without blanks: what is encoded anew stays bounded."""
    tree = token_counts.Tree("word " * 2000, COUNT)
    text = "word " * 2000
    for k in range(300):
        new = f"inserted passage number {k}, with a few words more " + "xyz " * 3
        tree.edit(5000, 5000, new)
        text = text[:5000] + new + text[5000:]
    assert tree.total == COUNT(text) and "".join(tree.blocks) == text
    assert tree.encoded < 300 * 4 * token_counts.LEAF and max(map(len, tree.blocks)) < 3 * token_counts.LEAF
    japanese = "日本語の文章、句読点がある。" * 2500
    tree = token_counts.Tree(japanese, COUNT)
    assert max(map(len, tree.blocks)) < 2 * token_counts.LEAF and tree.total == COUNT(japanese)
    tree.edit(20_000, 20_003, "新しい。")
    assert tree.total == COUNT(japanese[:20_000] + "新しい。" + japanese[20_003:]) and tree.encoded < 4 * token_counts.LEAF


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 40), TEXT), max_size=12))
def test_many_edits_with_small_leaves(edits):
    before, token_counts.LEAF = token_counts.LEAF, 16
    try:
        text = "one two, three's\n\n  four 5678 日本。語 " * 20
        tree = token_counts.Tree(text, COUNT)
        for start, n, new in edits:
            start = min(start, len(text))
            tree.edit(start, start + n, new)
            text = text[:start] + new + text[min(start + n, len(text)) :]
            assert "".join(tree.blocks) == text and tree.total == COUNT(text) == tree.tokens[1]
    finally:
        token_counts.LEAF = before


def plain(text, edits):
    for start, stop, new in edits:
        start = max(0, min(start, len(text)))
        text = text[:start] + new + text[max(start, min(stop, len(text))) :]
    return text


def test_query_edits(small, odd):
    for docs in (small, odd):
        rows = token_counts.sample_edits(docs).collect()
        got = sorted((str(r.doc_id), r.n_tokens, r.edited_tokens) for r in token_counts.count_with_edits(token_counts.sample_edits(docs)).collect())
        assert got == sorted((str(r.doc_id), COUNT(r.text or ""), COUNT(plain(r.text or "", [(e.start, e.stop, e.text) for e in r.edits]))) for r in rows)


def test_kept_trees(spark, small, empty):
    kept = token_counts.trees(small)
    edits = [(d, s, s * 31 % 400, s * 31 % 400 + s % 9, f" e{s}") for d in (0, 3, 5) for s in range(40)] + [(None, 1, 0, 5, "x"), (10**9, 1, 0, 5, "x"), (7, 1, None, None, None)]
    after = token_counts.totals(token_counts.apply_edits(kept, spark.createDataFrame(edits, "doc_id long, seq long, start int, stop int, text string")))
    want = {r.doc_id: COUNT(plain(r.text, [(a, b, t) for d, _, a, b, t in edits if d == r.doc_id and a is not None])) for r in small.collect()}
    assert {r.doc_id: r.n_tokens for r in after.collect()} == want
    assert token_counts.apply_edits(token_counts.trees(empty), spark.createDataFrame(edits, "doc_id long, seq long, start int, stop int, text string")).count() == 0
    assert token_counts.count_with_edits(token_counts.sample_edits(empty)).count() == 0


def test_sample_edits_of_odd_rows(odd, empty):
    rows = token_counts.count_with_edits(token_counts.sample_edits(odd)).collect()
    assert len(rows) == odd.count()
    none = next(r for r in rows if r.doc_id == 1)
    assert (none.n_tokens, none.edited_chars) == (0, len("\n\nEnd of text."))  # the cut after the first edit takes what that put in
    assert token_counts.count_with_edits(token_counts.sample_edits(empty)).count() == 0
