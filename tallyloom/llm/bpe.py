"""Byte-level BPE: each pre-token is merged by a segment tree over its adjacent pair ranks.

A leaf holds (rank, position) of one adjacent pair, an inner node the smaller of its two children, so the
root is the leftmost pair of the lowest rank. A merge changes three leaves, each in logarithmic time; it
ends when the root holds no pair. A pre-token of any length costs n log n.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches

#: Fixed: the byte-level pre-token pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 62
_LOW = (1 << 32) - 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """A vocabulary with its merges, and a bounded cache of encoded pre-tokens.

    max_cached bounds the cache's entries. It has two halves: when the newer is full it becomes the older, whose entries
    come back to the newer when they are met again, so frequent pre-tokens stay. That changes no result.
    """

    def __init__(self, path: str, max_cached: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*vocab.values(), *self.special.values())
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.text_of = [str(i) for i in range(size)]
        self.byte_ids = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] << 24 | vocab[right]] = len(self.merged)
            self.merged.append(vocab[left + right])
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.max_cached = max_cached

    def merge(self, ids: list[int]) -> list[int]:
        """Merge until the root holds no pair."""
        n = len(ids) - 1
        if n < 1:
            return ids
        rank_of, merged = self.ranks.get, self.merged
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n):
            rank = rank_of(ids[i] << 24 | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        root = 1
        if tree[root] == _NONE:
            return ids
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while (best := tree[root]) != _NONE:
            i = best & _LOW
            j = after[i]
            ids[i] = merged[best >> 32]
            ids[j] = -1
            k = after[j]
            after[i] = k
            changes = []
            if k <= n:
                before[k] = i
                rank = rank_of(ids[i] << 24 | ids[k])
                changes.append((i, _NONE if rank is None else rank << 32 | i))
                changes.append((j, _NONE))
            else:
                changes.append((i, _NONE))
            h = before[i]
            if h >= 0:
                rank = rank_of(ids[h] << 24 | ids[i])
                changes.append((h, _NONE if rank is None else rank << 32 | h))
            for at, value in changes:
                at += size
                if tree[at] == value:
                    continue
                tree[at] = value
                while at > 1:
                    a, b = tree[at], tree[at ^ 1]
                    at >>= 1
                    if b < a:
                        a = b
                    if tree[at] == a:
                        break
                    tree[at] = a
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token that isn't in the newer half of the cache."""
        ids = self.older.get(piece) or tuple(self.merge([self.byte_ids[b] for b in piece.encode()]))
        if len(piece) <= 64:
            if len(self.cache) >= max(1, self.max_cached // 2):
                self.older = self.cache.copy()
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens in it become their ids."""
        out: list[int] = []
        put, cache = out.extend, self.cache
        for part in self.split(text):
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self.find(part):
                put(cache.get(piece) or self.piece(piece))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> BytePairs:
    """One per Python worker."""
    return BytePairs(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), decoded (the round trip's text). A null text counts as empty: no ids. Rows are
    independent: ties, repeated rows and null ids each give their own row; other columns are ignored."""
    path = path or default_vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = vocabulary(path)
        ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
        return pa.record_batch({"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(map(bpe.decode, ids), pa.string())})

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() gives, digested in the same task so that ids need not leave it."""
    path = path or default_vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = vocabulary(path)
        n, of_ids, of_text = [], [], []
        for text in batch.column(1).to_pylist():
            ids = bpe.encode(text or "")
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())})

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
