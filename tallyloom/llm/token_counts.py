"""Edit-aware token counts: a segment tree of pre-token blocks per document.

A leaf is a run of whole pre-tokens and its token count; inner nodes hold sums of characters and tokens. An edit
finds its leaves by descending the sums, re-encodes those and what context the pre-token pattern needs at their
edges, and updates the sums above them. The total is the root. A leaf that outgrows its size splits; the new leaves
take free places beside it, or the sums, not the encodings, are made anew with room between the leaves. Only a single
pre-token longer than a leaf, such as a run of letters without a blank, can't be cut: its tokens depend on all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN
from .common import map_batches, small_batches

#: Characters of a leaf, at least, where it is cut: it ends with the next pre-token that doesn't end in white space.
#: A leaf that an edit makes longer than twice that is cut.
LEAF = 512
#: The pre-token pattern looks at most so many characters past the end of a pre-token (a contraction's two letters).
AHEAD = 3
_PIECES = regex.compile(PATTERN).finditer


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def counter(path: str):
    """Text to its number of tokens; strings of special tokens are ordinary text. One per Python worker."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text)) if text else 0


def cut(text: str) -> list[str]:
    """Blocks that are encoded apart with the same tokens. A cut is the end of a pre-token whose last character isn't white
    space: what follows can change it only by its first AHEAD characters, and what precedes doesn't change what follows."""
    if len(text) <= 2 * LEAF:
        return [text]
    out, at = [], 0
    for piece in _PIECES(text):
        end = piece.end()
        if end - at >= LEAF and end < len(text) and not text[end - 1].isspace():
            out.append(text[at:end])
            at = end
    return [*out, text[at:]]


class Tree:
    """blocks: the leaves' texts; chars and tokens: sums in heap order, leaves from `size` on. Leaves may be empty."""

    def __init__(self, text: str, count):
        self.count, self.encoded = count, 0
        blocks = cut(text)
        self._build(blocks, list(map(count, blocks)))

    @classmethod
    def stored(cls, blocks: list[str], tokens: list[int], count) -> Tree:
        tree = cls.__new__(cls)
        tree.count, tree.encoded = count, 0
        tree._build(list(blocks), list(tokens))
        return tree

    def _build(self, blocks: list[str], tokens: list[int]) -> None:
        self.size = 1 << (len(blocks) - 1).bit_length()
        more = self.size - len(blocks)
        self.blocks = blocks + [""] * more
        self.chars = [0] * self.size + [len(b) for b in self.blocks]
        self.tokens = [0] * self.size + tokens + [0] * more
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        k = leaf + self.size
        self.blocks[leaf], self.chars[k], self.tokens[k] = text, len(text), tokens
        while k > 1:
            k //= 2
            self._sum(k)

    def _replace(self, first: int, last: int, blocks: list[str], tokens: list[int]) -> None:
        """Put leaves in the place of first to last, in empty leaves after them too; without room, spread all leaves out."""
        while last - first + 1 < len(blocks) and last + 1 < self.size and not self.blocks[last + 1]:
            last += 1
        if len(blocks) <= last - first + 1:
            for k in range(first, last + 1):
                new = k - first < len(blocks)
                if new or self.blocks[k]:
                    self._set(k, blocks[k - first] if new else "", tokens[k - first] if new else 0)
            return
        rows = [*zip(self.blocks[:first], self.tokens[self.size :], strict=False), *zip(blocks, tokens, strict=True), *zip(self.blocks[last + 1 :], self.tokens[self.size + last + 1 :], strict=True)]
        rows = [x for b, t in rows if b for x in ((b, t), ("", 0))]
        self._build([b for b, _ in rows], [t for _, t in rows])

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins; past the end: the last leaf with text."""
        at = max(0, min(at, self.chars[1] - 1))
        k, begins = 1, 0
        while k < self.size:
            k *= 2
            if at - begins >= self.chars[k]:
                begins += self.chars[k]
                k += 1
        return k - self.size, begins

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start to stop (clamped to the text) by new."""
        start = max(0, min(start, self.chars[1]))
        stop = max(start, min(stop, self.chars[1]))
        first, begins = self.find(start - AHEAD)
        last = max(first, self.find(stop)[0])
        old = "".join(self.blocks[first : last + 1])
        text = old[: start - begins] + new + old[stop - begins :]
        while True:  # until the leaves' end is again the end of a pre-token
            ahead, k = "", last + 1
            while k < self.size and not ahead.strip():
                ahead += self.blocks[k]
                k += 1
            if not ahead or text and not text[-1].isspace() and any(m.end() >= len(text) and m.end() == len(text) for m in _PIECES(text + ahead[: 64 + len(ahead) - len(ahead.lstrip())])):
                break
            last = k - 1
            text += ahead
        self.encoded += len(text)
        blocks = cut(text)
        self._replace(first, last, blocks, list(map(self.count, blocks)))


EDIT = "struct<start:int,stop:int,text:string>"
STATE = "doc_id bigint, blocks array<string>, tokens array<int>"


def trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, blocks, tokens: the tree of each document, to be kept. A null text is empty: one empty leaf."""
    path = path or default_ranks()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [Tree(t or "", counter(path)) for t in batch.column(1).to_pylist()]
        return pa.record_batch({"doc_id": batch.column(0), "blocks": pa.array([t.blocks for t in made], pa.list_(pa.string())), "tokens": pa.array([t.tokens[t.size :] for t in made], pa.list_(pa.int32()))})

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, STATE)


def apply_edits(kept: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """The trees after edits(doc_id, seq, start, stop, text), in the order of seq, each in the text that the one before left.

    Trees and edits stream through a task sorted by document, so a document with any number of edits holds one tree
    in memory. Edits of unknown documents and those without doc_id do nothing; trees must have distinct doc_ids
    (a null one passes unchanged). Null positions count as 0, null text as empty."""
    path = path or default_ranks()
    small_batches(kept.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    rows = kept.select("doc_id", F.lit(0).alias("kind"), none("long").alias("seq"), none("int").alias("start"), none("int").alias("stop"), none("string").alias("text"), "blocks", "tokens")
    more = edits.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.lit(1), F.col("seq").cast("long"), F.col("start").cast("int"), F.col("stop").cast("int"), "text", none("array<string>"), none("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, tree = None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch({"doc_id": pa.array([d for d, _ in done], pa.int64()), "blocks": pa.array([t.blocks for _, t in done], pa.list_(pa.string())), "tokens": pa.array([t.tokens[t.size :] for _, t in done], pa.list_(pa.int32()))})

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if tree:
                        done.append((doc, tree))
                    doc, tree = row["doc_id"], Tree.stored(row["blocks"], row["tokens"], counter(path))
                elif tree and row["doc_id"] == doc:
                    tree.edit(row["start"] or 0, row["stop"] or 0, row["text"] or "")
            if done:
                yield out(done)
        if tree:
            yield out([(doc, tree)])

    return rows.union(more).repartition("doc_id").sortWithinPartitions("doc_id", "kind", "seq").mapInArrow(run, STATE)


def totals(kept: DataFrame) -> DataFrame:
    """doc_id, n_tokens of kept trees."""
    return kept.select("doc_id", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"))


def count_with_edits(docs: DataFrame, edits: str = "edits", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, edited_tokens, edited_chars, encoded_chars: counts before and after each row's own array of EDITs.

    No shuffle. encoded_chars is what the edits had to encode anew. Null text: empty; null edits: none. Repeated rows
    and null ids each give their own row."""
    path = path or default_ranks()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            tree = Tree(text or "", counter(path))
            before = tree.total
            for e in changes or ():
                tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
            rows.append((before, tree.total, tree.chars[1], tree.encoded))
        names = ("n_tokens", "edited_tokens", "edited_chars", "encoded_chars")
        return pa.record_batch({"doc_id": batch.column(0)} | {c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(edits).cast(f"array<{EDIT}>").alias("edits")), run, "doc_id bigint, n_tokens bigint, edited_tokens bigint, edited_chars bigint, encoded_chars bigint")


def sample_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text, edits: an edit session for each document, from its own text: a replaced passage in the middle, words cut at a quarter, its last word again in front, and a line at the end.

    A null or empty text gets the same edits, of which those of passages that it doesn't have insert at its end or do
    nothing; repeated rows, null ids and an empty table stay as they are."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda start, stop, text: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), text.alias("text"))
    half, quarter = F.floor(n / 2), F.floor(n / 4)
    last = F.coalesce(F.regexp_extract("text", r"(\S*)\s*$", 1), F.lit(""))
    session = F.array(edit(half, half + 12, F.lit("edited passage's")), edit(quarter, quarter + 20, F.lit("")), edit(F.lit(0), F.lit(0), last), edit(n * 2 + 64, n * 2 + 64, F.lit("\n\nEnd of text.")))
    return docs.select("doc_id", "text", session.alias("edits"))
