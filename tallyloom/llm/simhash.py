"""Near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is a row of bytes. The index posts it under the bytes at several positions; pairs that meet there
are tallied by the positional bytes they share, those under the guaranteed minimum go, and the rest are verified.

* `simhash`: 64 bits, 8 bytes. Two fingerprints that differ in at most 3 bits differ in at most 3 bytes, so they
  share at least 5, hence one of the 14 four-byte position sets of KEYS (every 5 of 8 positions hold one whole):
  no link is lost. A posting list on a single byte would hold 1/256 of all fingerprints and its pairs would grow
  with the square of the input; on four bytes it holds near-duplicates and next to no others.
* `sketch`: 256 positional bytes, each the low byte of a min-wise hash of the shingles. Two texts share a byte
  with a probability of their Jaccard similarity. A SimHash can't serve a similarity of 0.8: at that similarity
  64 bits differ in 10 on average, which guarantees no shared byte at all. Index and tally are the same, under a
  bar well below 0.8; such candidates are then verified by the exact Jaccard of their shingle-hash sets.

Posting lists are worked on by chunk pairs of bounded size, and a task emits a spanning forest of the links it
finds in a chunk pair, not the links: a list of m fingerprints gives fewer than m rows a chunk pair. Candidates are
verified where they meet: those of the forests first, then those that are apart still, with the sets beside the sketches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, if_small, map_batches, meet, settle, small_batches, written
from .components import components

BITS = 3
#: Fingerprints in a chunk of a posting list; a task compares two chunks at a time.
CHUNK = 512
SKETCH = 256
#: Least share of equal sketch bytes of a candidate: six standard errors under 0.8, so that no text of 0.8 is lost to noise.
SHARE = 0.65
#: Least Jaccard similarity of the shingle sets of near copies, as a fraction.
ALIKE = (4, 5)


def covering(n: int = 8, of: int = 5, k: int = 4) -> list[tuple[int, ...]]:
    """Sets of k positions such that any `of` of n positions hold one whole; greedily few."""
    left = set(combinations(range(n), of))
    out = []
    while left:
        best = max(combinations(range(n), k), key=lambda s: (sum(set(s) <= set(x) for x in left), [-x for x in s]))
        out.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return out


KEYS = covering()
#: For sketches: 16 disjoint sets of 4 positions out of 64; at a similarity of 0.8 all miss with a probability of 0.0002.
BANDS = [tuple(range(4 * i, 4 * i + 4)) for i in range(16)]


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles of the text, A-Z lowered, repeats included; fewer words: of the whole sequence; none: nothing."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    stops = (ends[k - 1 :] - 1).tolist()
    starts = [0, *ends[:-k].tolist()]
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64, len(starts))


def simhash(text: str | None, k: int = 3) -> int:
    """A bit is set if it is in over half of the hashes. Null, empty or blank: 0."""
    h = shingle_hashes(text, k)
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        counts += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def sketch(text: str | None, k: int = 5, size: int = SKETCH) -> bytes:
    """The low bytes of `size` min-wise hashes of the distinct shingles; empty for a text without words."""
    return _sketch_of(np.unique(shingle_hashes(text, k)), size)


def _sketch_of(h: np.ndarray, size: int = SKETCH) -> bytes:
    if not len(h):
        return b""
    factors = np.random.default_rng(42).integers(1, 1 << 63, size, np.uint64) | np.uint64(1)
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        x = h[at : at + 1024, None] * factors
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(0), out=least)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp (SimHash, most significant byte first) per row."""
    make = lambda t: simhash(t, k).to_bytes(8, "big")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(map(make, batch.column(1).to_pylist()), pa.binary())})

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, fp binary")


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, fp (sketch), digest of the shingle-hash set per row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, digest = [], []
        for text in batch.column(1).to_pylist():
            h = np.unique(shingle_hashes(text, k))
            fp.append(_sketch_of(h))
            digest.append(xxhash.xxh128_digest(h.tobytes()))
        return pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fp, pa.binary()), "digest": pa.array(digest, pa.binary())})

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, fp binary, digest binary")


def _shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(rep, text) to rep, digest and the sorted shingle-hash set as bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, k)).tobytes() for t in batch.column(1).to_pylist()]
        return pa.record_batch({"rep": batch.column(0), "digest": pa.array(map(xxhash.xxh128_digest, sets), pa.binary()), "hashes": pa.array(sets, pa.binary())})

    return map_batches(texts.select("rep", "text"), run, "rep bigint, digest binary, hashes binary")


class _Trees:
    """Disjoint sets."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def top(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        if (p := self.top(x)) == (q := self.top(y)):
            return False
        self.root[max(p, q)] = min(p, q)
        return True


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of the pairs (a, b), in order, that join two trees."""
    trees = _Trees()
    return [i for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if trees.join(x, y)]


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ALIKE or more; exact."""
    num, den = ALIKE
    if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * den >= (len(x) + len(y) - both) * num


def _linked(x: np.ndarray, y: np.ndarray, least: int, bits: int | None) -> np.ndarray:
    """Tally the positional bytes that rows of x share with rows of y; pairs that reach the least and hold when verified."""
    x, y = np.broadcast_arrays(x, y)
    same = (x == y).sum(1, dtype=np.int32)
    ok = same >= least
    if bits is not None and ok.any():
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(x[at] ^ y[at]).sum(1, dtype=np.int32) <= bits
    return ok


def _spans(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit begins, and its rows."""
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    return new, np.diff(np.r_[new, len(key)])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _by_units(flush):
    """Batches sorted by (key, i, j) to what flush makes of tables of whole units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in range(3)]
            if held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in range(3)] != [batch.column(c)[0].as_py() for c in range(3)]:
                yield flush(pa.Table.from_batches(held))
                held = []
            held.append(batch)
            table = pa.Table.from_batches(held)
            at = table.num_rows  # the last unit may go on in the next batch
            whole = np.flatnonzero((table.column("key").to_numpy() != last[0]) | (table.column("i").to_numpy() != last[1]) | (table.column("j").to_numpy() != last[2]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield flush(table.slice(0, cut))
                held = table.slice(cut, at - cut).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _candidates(unit: slice, i: int, j: int, chunk: np.ndarray, fp: np.ndarray, least: int, bits: int | None, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a unit that are linked, with the positional bytes they share; with group, only those of different groups."""
    left = unit.start + np.flatnonzero(chunk[unit] == i)
    right = left if i == j else unit.start + np.flatnonzero(chunk[unit] == j)
    found: list[list[np.ndarray]] = [[], [], []]
    for n, p in enumerate(left):
        others = right[n + 1 :] if i == j else right
        if group is not None:
            others = others[group[others] != group[p]]
        if len(others) and (ok := _linked(fp[p][None, :], fp[others], least, bits)).any():
            hit = others[ok]
            for column, x in zip(found, (np.full(len(hit), p), hit, (fp[p][None, :] == fp[hit]).sum(1, dtype=np.int32)), strict=True):
                column.append(x)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in found)


def _link_units(least: int, bits: int | None):
    """Rows (key, i, j, chunk, rep, fp) sorted by (key, i, j) to a spanning forest (a, b) of the links of each unit.

    The links that share most bytes come first, of those that share as many the ones between neighbours, so that the
    forest is made of likely links and of few hubs."""

    def flush(table: pa.Table) -> pa.RecordBatch:
        key, i, j, chunk, rep = (table.column(c).to_numpy() for c in ("key", "i", "j", "chunk", "rep"))
        fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint8).reshape(len(key), -1)
        new, sizes = _spans(key, i, j)
        starts = new[(sizes == 2) & (i[new] == j[new])]  # most lists: a pair
        ok = _linked(fp[starts], fp[starts + 1], least, bits) if len(starts) else np.empty(0, bool)
        out = [(rep[starts[ok]], rep[starts[ok] + 1])]
        others = (sizes > 2) | (sizes == 2) & (i[new] != j[new])
        for at, n in zip(new[others].tolist(), sizes[others].tolist(), strict=True):
            p, q, same = _candidates(slice(at, at + n), int(i[at]), int(j[at]), chunk, fp, least, bits)
            order = np.lexsort((q - p, -same))
            a, b = rep[p[order]], rep[q[order]]
            kept = _forest(a, b)
            out.append((a[kept], b[kept]))
        return _edges(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return _by_units(flush)


def _open_units(least: int):
    """Rows (key, i, j, chunk, rep, fp, component) sorted by (key, i, j) to (key, i, j, chunk, rep) of those with a candidate of another component in their unit."""

    def flush(table: pa.Table) -> pa.RecordBatch:
        key, i, j, chunk, component = (table.column(c).to_numpy() for c in ("key", "i", "j", "chunk", "component"))
        fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint8).reshape(len(key), -1)
        new, sizes = _spans(key, i, j)
        starts = new[(sizes == 2) & (i[new] == j[new])]
        starts = starts[component[starts] != component[starts + 1]]
        if len(starts):
            starts = starts[_linked(fp[starts], fp[starts + 1], least, None)]
        rows = [starts, starts + 1]
        others = (sizes > 2) | (sizes == 2) & (i[new] != j[new])
        for at, n in zip(new[others].tolist(), sizes[others].tolist(), strict=True):
            rows += _candidates(slice(at, at + n), int(i[at]), int(j[at]), chunk, fp, least, None, component)[:2]
        at = np.unique(np.concatenate(rows))
        return pa.record_batch({c: pa.array(table.column(c).to_numpy()[at], pa.int64()) for c in ("key", "i", "j", "chunk", "rep")})

    return _by_units(flush)


def _verify_units(least: int):
    """Rows (key, i, j, chunk, rep, fp, component, hashes) sorted by (key, i, j) to verified links (a, b) between components, a forest for each unit.

    All candidates of a unit are compared but those that verified links connect already."""

    def flush(table: pa.Table) -> pa.RecordBatch:
        key, i, j, chunk, rep, component = (table.column(c).to_numpy() for c in ("key", "i", "j", "chunk", "rep", "component"))
        fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint8).reshape(len(key), -1)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        found = []
        for at, n in zip(*(x.tolist() for x in _spans(key, i, j)), strict=True):
            trees = _Trees()
            for p, q, _ in zip(*(x.tolist() for x in _candidates(slice(at, at + n), int(i[at]), int(j[at]), chunk, fp, least, None, component)), strict=True):
                x, y = int(component[p]), int(component[q])
                if trees.top(x) != trees.top(y) and _alike(sets[p], sets[q]):
                    trees.join(x, y)
                    found.append((int(rep[p]), int(rep[q])))
        return _edges(*np.array(found, np.int64).reshape(-1, 2).T)

    return _by_units(flush)


def link(nodes: DataFrame, sets: list[tuple[int, ...]], least: int, bits: int | None, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect what is linked among nodes (rep bigint, fp binary; distinct): a forest for each unit of a posting list."""
    small_batches(nodes.sparkSession)
    return _posted(nodes, sets, chunk, "fp").mapInArrow(_link_units(least, bits), "a bigint, b bigint").distinct()


def _posted(nodes: DataFrame, sets: list[tuple[int, ...]], chunk: int, *carried: str) -> DataFrame:
    """Rows (key, i, j, chunk, rep, carried) of the posting lists of nodes, dealt into units.

    A posting list of more than `chunk` fingerprints is dealt into chunks by hash and each pair of chunks is a unit
    of its own, so that no task holds more than two chunks and none is left out. A list of m distinct fingerprints is
    copied m / chunk times and compared pair by pair, which is exact and grows with the square of m; lists are short
    because equal fingerprints are one node and a key holds four bytes: one list holds what agrees in half of a SimHash
    or in a band of a sketch, near-duplicates with different fingerprints and next to no others."""
    byte = lambda p: F.substring("fp", p + 1, 1)
    keys = F.array(*[F.xxhash64(F.lit(n), F.concat(*map(byte, s))) for n, s in enumerate(sets)])
    posted = nodes.select("rep", F.explode(keys).alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = posted.join(shared, "key").join(nodes, "rep").withColumn("chunks", F.ceil(F.col("n") / chunk))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("rep", "key"), F.col("chunks")))
    units = met.select("key", "chunk", "rep", *carried, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    return _in_units(units.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", *carried))


def _in_units(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep, hashes (the sorted shingle-hash set) of some nodes (rep, digest), made anew from their texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(if_small(wanted), "rep", "left_semi")
    return _shingle_sets(texts, k).join(nodes.select("rep", "digest"), ["rep", "digest"]).dropDuplicates(["rep"]).select("rep", "hashes")


def _verified(docs: DataFrame, nodes: DataFrame, k: int, least: int, chunk: int = CHUNK) -> DataFrame:
    """node, component of the nodes (rep, fp, digest) whose shingle sets are alike, chained.

    Only pairs that meet in a posting list are compared. First the likeliest candidates, a forest for each unit, are
    verified and what they connect is one; then, in each unit, those candidates that are still apart are, which are few:
    in a group of copies the forest connects nearly all. So the work grows with the candidates, not with the square of
    what chains of them connect, and no list of all pairs is made."""
    small_batches(docs.sparkSession)
    forest = written(link(nodes.select("rep", "fp"), BANDS, least, None, chunk))
    settle(docs.sparkSession)
    ends = written(forest.select(F.col("a").alias("rep")).union(forest.select("b")).distinct())
    sets = written(_sets(docs, nodes, ends, k))
    met = forest.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (batch.column(c).to_pylist() for c in (2, 3))
        return batch.select(["a", "b"]).filter(pa.array([_alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)], pa.bool_()))

    links = written(map_batches(met, alike, "a bigint, b bigint"))
    settle(docs.sparkSession)
    known = components(links).withColumnRenamed("node", "rep")
    # nodes of the forest are all that have a candidate at all
    placed = written(nodes.select("rep", "fp").join(ends, "rep").join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    still = written(_posted(placed, BANDS, chunk, "fp", "component").mapInArrow(_open_units(least), "key bigint, i bigint, j bigint, chunk bigint, rep bigint"))
    settle(docs.sparkSession)
    rest = _in_units(still.join(placed, "rep").join(sets, "rep").select("key", "i", "j", "chunk", "rep", "fp", "component", "hashes"))
    more = written(rest.mapInArrow(_verify_units(least), "a bigint, b bigint").distinct())
    found = components(links.union(more))
    discard(forest, sets, still, placed, ends)
    return found


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: documents whose k-word SimHash differs by at most 3 bits, chained.

    Null, empty and blank texts have fingerprint zero and link like any other. A row without doc_id has a
    fingerprint and no component. Repeated rows come back repeated; an empty table gives none."""
    rows = written(fingerprints(docs, k))
    nodes = written(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    groups = components(link(nodes.select("rep", "fp"), KEYS, 8 - BITS, BITS))
    joined = nodes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = meet(rows.filter("doc_id is not null"), joined, ["fp"], "n", total).unionByName(rows.filter("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return met.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, k: int = 5, share: float = SHARE, chunk: int = CHUNK) -> DataFrame:
    """Rows of docs without near copies: of each group of texts whose k-word shingles are alike to 0.8 or more, chained,
    that of the smallest doc_id stays. Null, empty and blank texts have no shingles and stay, as do rows without doc_id.

    Rows that repeat a doc_id stay or go together, by any of their texts; equal texts are alike, the smallest doc_id
    stays. All columns stay as they are, whatever their names; an empty table gives an empty one.
    share: the least share of equal sketch bytes of a candidate pair; whether it is a link is decided by the shingle sets."""
    least = int(np.ceil(share * SKETCH))
    words = written(sketches(docs, k).filter((F.length("fp") > 0) & F.col("doc_id").isNotNull()))
    nodes = written(words.groupBy("fp", "digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = _verified(docs, nodes, k, least, chunk).withColumnRenamed("node", "rep")
    groups = nodes.join(found, "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component_id"))
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gone = written(meet(words, groups, ["digest"], "n", total).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    return docs.join(if_small(gone), docs["doc_id"] == gone["doc_id"], "left_anti")
