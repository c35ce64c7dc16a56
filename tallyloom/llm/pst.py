"""Scoring by a probabilistic suffix tree over the bytes of the words.

A text is its words, A-Z lowered, joined by one blank and closed by an end symbol. The tree's states are byte
contexts of up to DEPTH bytes. A context is retained if its next-symbol counts diverge from its suffix's (their
likelihood gain in nats); each retained state's distribution is smoothed by its longest retained suffix's, down to
a uniform one, and a symbol is scored in the longest retained suffix of what precedes it.

`spelled_score` is the probability of every byte. `score` speaks of the same tokens as the base does: a word outside
the training vocabulary, with the blank after it, is the one unknown type at the base's probability f = 1 / (N + V + 1);
known words are spelled and share the other 1 - 2f (an unknown word may end the text or not), so tokens sum to 1 at most.

Nothing of the corpus goes to the driver or is broadcast. Blocks of documents ask for the words and grams they hold,
one row for each distinct one; joins answer them, and answers meet their block's documents by one shuffle, to be
scored in a stream that holds one block's answers at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fold, settle, small_batches, written

DEPTH = 5
#: Nats of likelihood that a context must gain over its suffix.
GAIN = 3.0
FOLDS, HELD = 7, 2
END = 10  # no word holds a line feed
#: A task passes its partial counts on when it holds so many.
HELD_ENTRIES = 1_000_000
_PAD = b"\n" * DEPTH
#: Bytes of texts whose grams are looked up at once.
PART = 500_000
#: Tasks that score; where blocks are more than a quarter of that, they share them.
MOST_TASKS = 100_000
#: Bytes of a file for each block that its documents are dealt into; bounds what a block's answers hold.
BLOCK_BYTES = 32 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of the texts (words joined by one blank) and their ends: it and the DEPTH bytes before it, packed;
    before a text are end symbols. And where each text begins among them.

    Of all texts at once: codes of pairs make those of four bytes, and both those of six."""
    raw = np.frombuffer(b"".join([x for t in texts for x in (_PAD, t, b"\n")]), np.uint8)
    pairs = raw[:-1].astype(np.uint16) << np.uint16(8) | raw[1:]
    fours = pairs[:-2].astype(np.uint32) << np.uint32(16) | pairs[2:]
    codes = fours[:-2].astype(np.int64) << 16 | pairs[4:]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(codes), bool)  # but for codes whose last byte is of a later text's padding
    pads = starts[1:] + DEPTH * np.arange(len(texts) - 1)
    inside[(pads[:, None] + np.arange(DEPTH)).ravel()] = False
    return codes[inside], starts


def _parts(texts: list, size=len) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PART bytes."""
    at = held = 0
    for k, t in enumerate(texts):
        if held and held + size(t) > PART:
            yield at, k
            at, held = k, 0
        held += size(t)
    if held or at < len(texts):
        yield at, len(texts)


def _blocks(docs: DataFrame) -> DataFrame:
    """block, train, doc_id, body. A block is a part of a file, by the file's size and the row's place in it, so every scan
    sees the same blocks, however its files are split and whatever rows repeat, and without a shuffle."""
    columns = ("doc_id", "text", "_metadata.file_path", "_metadata.file_size", "_metadata.row_index")
    try:
        place = docs.select(*columns)
    except AnalysisException:  # not read from Parquet files
        place = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select(*columns)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    part = F.pmod(F.xxhash64("row_index"), F.ceil(F.col("file_size") / BLOCK_BYTES))
    return place.select(F.xxhash64("file_path", part).alias("block"), (fold(F.col("doc_id"), FOLDS) != HELD).alias("train"), F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, bool], list[list[bytes]]]]:
    """((block, train), words of some texts) of a batch, about PART bytes of texts at a time."""
    rows = defaultdict(list)
    for block, train, body in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
        rows[block, train].append(body)
    for key, bodies in rows.items():
        for i, j in _parts(bodies):
            yield key, [*map(words_of, bodies[i:j])]


def _ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, train, body) to (block, word, n in training) of each word of a block. Words are counted as Arrow columns, which hold many of them in little memory."""
    held: dict[int, pa.Table] = {}
    raw: dict[int, list[pa.RecordBatch]] = defaultdict(list)

    def pack() -> None:
        for block, some in raw.items():
            tables = [pa.Table.from_batches(some), *([held[block]] if block in held else [])]
            summed = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
            held[block] = summed.rename_columns({"n_sum": "n"}).select(["word", "n"])
        raw.clear()

    def out() -> Iterator[pa.RecordBatch]:
        for block, table in held.items():
            for some in table.to_batches(max_chunksize=100_000):
                yield pa.record_batch({"block": pa.array(np.full(len(some), block), pa.int64()), "word": some["word"], "n": some["n"]})
        held.clear()

    waiting = 0
    for batch in batches:
        for (block, train), texts in _by_block(batch):
            counted = pa.array([w for words in texts for w in words], pa.binary()).value_counts()
            n = counted.field("counts").cast(pa.int64()) if train else pa.array(np.zeros(len(counted), np.int64))
            raw[block].append(pa.record_batch({"word": counted.field("values"), "n": n}))
            waiting += len(counted)
            if waiting > HELD_ENTRIES:
                pack()
                waiting = 0
                if sum(map(len, held.values())) > HELD_ENTRIES:
                    yield from out()
    pack()
    yield from out()


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def _ask_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, train, body) to (block, gram, n in training) of each gram of a block."""
    held: dict[int, list] = {}
    raw: dict[tuple[int, bool], list[np.ndarray]] = {}

    def pack() -> None:
        for (block, train), some in raw.items():
            codes, counts = np.unique(np.concatenate(some), return_counts=True)
            pair = held.setdefault(block, [[], []])
            pair[0].append(codes)
            pair[1].append(counts if train else np.zeros(len(codes), np.int64))
        raw.clear()
        for pair in held.values():
            if len(pair[0]) > 1:
                codes, counts = _merged(*pair)
                pair[0], pair[1] = [codes], [counts]

    def out() -> Iterator[pa.RecordBatch]:
        for block, (codes, counts) in held.items():
            yield pa.record_batch({"block": pa.array(np.full(len(codes[0]), block), pa.int64()), "gram": pa.array(codes[0], pa.int64()), "n": pa.array(counts[0], pa.int64())})
        held.clear()

    waiting = 0
    for batch in batches:
        for key, texts in _by_block(batch):
            codes = grams([b" ".join(words) for words in texts])[0]
            raw.setdefault(key, []).append(codes)
            waiting += len(codes)
            if waiting > 2_000_000:
                pack()
                waiting = 0
                if sum(len(p[0][0]) for p in held.values()) > 2 * HELD_ENTRIES:
                    yield from out()
    pack()
    yield from out()


def suffix_tree(counts: DataFrame, gain: float = GAIN) -> DataFrame:
    """(gram, n) over all grams to (gram, log10 of its last symbol's probability in the longest retained suffix).

    Level k holds the grams of k bytes of context. A context's rows are at most 256, so its window is bounded."""
    levels = [counts]
    for k in reversed(range(DEPTH)):
        mask = (1 << 8 * (k + 1)) - 1
        levels.insert(0, levels[0].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("n").alias("n")))
    tree = None
    for k, level in enumerate(levels):
        context = Window.partitionBy("context")
        rows = level.withColumn("context", F.shiftright("gram", 8))
        if tree is None:
            rows = rows.withColumn("up", F.lit(1 / 256))
            divergence = F.lit(float("inf"))
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(tree.select(F.col("gram").alias("suffix"), F.col("p").alias("up"), F.col("n").alias("up_n"), F.col("total").alias("up_total")), "suffix")
            term = F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") * F.col("up_total") / F.when(F.col("up_n") > 0, F.col("up_n"))))
            rows = rows.withColumn("gain", F.sum(term).over(context))
            divergence = F.col("gain") - F.col("total") * F.log(F.when(F.col("total") > 0, F.col("total")))
        rows = rows.withColumn("total", F.sum("n").over(context)).withColumn("types", F.count_if(F.col("n") > 0).over(context))
        retained = (F.col("total") > 0) & (divergence > gain)
        tree = rows.select("gram", "n", "total", F.when(retained, (F.col("n") + F.col("types") * F.col("up")) / (F.col("total") + F.col("types"))).otherwise(F.col("up")).alias("p"))
    return tree.select("gram", F.log10("p").alias("lp"))


#: Odd multipliers of the hash of words; the next one is taken where two words of a block share a hash.
_MULTIPLIERS = tuple((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 for k in range(8))


def word_hashes(raw: np.ndarray, multiplier: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (its separator) of each word of bytes whose words are closed by one blank or line feed.

    A word's hash is the sum of its bytes times powers of the multiplier, modulo 2**64, cut out of one running sum."""
    stops = np.flatnonzero((raw == 32) | (raw == END))
    begins = np.concatenate(([0], stops[:-1] + 1))
    begins, stops = begins[stops > begins], stops[stops > begins]
    power = np.full(len(raw), multiplier, np.uint64)
    power[:1] = 1
    np.multiply.accumulate(power, out=power)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)))
    inverse = np.full(len(raw), pow(multiplier, -1, 2**64), np.uint64)
    inverse[:1] = 1
    np.multiply.accumulate(inverse, out=inverse)
    return (upto[stops] - upto[begins]) * inverse[begins], begins, stops


class _Answers:
    """What a block's documents ask for: counts of its words, and log-probabilities of its grams.

    Words are found by hash. A document's words are among the block's, so where the block's have hashes that all differ,
    no word is taken for another."""

    def __init__(self) -> None:
        self.words: list[pa.RecordBatch] = []
        self.codes, self.probs = [], []
        self.ready = False

    def take(self, kind: int, rows: pa.RecordBatch) -> None:
        if kind == 0:
            self.words.append(rows.select(["body", "id"]))
        else:  # copies: a view would keep all columns of its batch
            self.codes.append(rows.column("id").to_numpy().copy())
            self.probs.append(rows.column("value").to_numpy().copy())

    def settle(self) -> None:
        if self.ready:
            return
        known = pa.Table.from_batches(self.words).group_by("body").aggregate([("id", "max")])  # a word may have been asked for twice
        end = pc.equal(known["body"], b"\n")
        self.ends = known.filter(end)["id_max"][0].as_py()
        known = known.filter(pc.invert(end))
        counts, words, self.words = known["id_max"].to_numpy(), known["body"], None
        for self.multiplier in _MULTIPLIERS:
            parts = (np.frombuffer(b"\n".join([*words.slice(at, 50_000).to_pylist(), b""]), np.uint8) for at in range(0, len(words), 50_000))
            self.hashes = pd.Index(np.concatenate([np.empty(0, np.uint64), *(word_hashes(raw, self.multiplier)[0] for raw in parts)]))
            if self.hashes.is_unique:
                break
        else:
            raise ValueError("no multiplier tells the words of a block apart")
        self.counts = counts
        codes, at = np.unique(np.concatenate(self.codes), return_index=True)
        self.codes, self.probs = pd.Index(codes), np.concatenate(self.probs)[at]
        self.ready = True


def scored(texts: list[bytes], answers: _Answers, f: float) -> list[np.ndarray]:
    """n_tokens, n_known, base_score, score, spelled_score of texts, each an array: words joined by one blank each."""
    codes, starts = grams(texts)
    at = answers.codes.get_indexer(codes)
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    hashes, begins, stops = word_hashes(raw, answers.multiplier)
    which = answers.hashes.get_indexer(hashes)
    if at.min() < 0 or which.min(initial=0) < 0:
        raise ValueError("a block holds a gram or a word that it didn't ask for")
    lp = answers.probs[at].astype(np.float64)
    upto = np.concatenate(([0.0], np.cumsum(lp)))
    c, n = answers.counts[which], len(texts)
    owner = np.searchsorted(starts, begins, "right") - 1
    of_texts = lambda weights: np.bincount(owner, weights, n)
    ends = np.append(starts[1:], len(lp)) - 1
    tokens, known = of_texts(np.ones(len(c))) + 1, of_texts(c > 0)
    base = of_texts(np.log10(c + 1)) + np.log10(answers.ends + 1) + tokens * np.log10(f)
    # a known word is spelled with the blank after it; the end of a text is spelled in any case
    spelled = of_texts(np.where(c > 0, upto[stops + (raw[stops] == 32)] - upto[begins], 0.0)) + lp[ends]
    share = np.log10(1 - 2 * f) if f < 0.5 else 0.0
    score = spelled + (tokens - 1 - known) * np.log10(f) + known * share
    return [tokens.astype(np.int64), (known + (answers.ends > 0)).astype(np.int64), base, score, upto[ends + 1] - upto[starts]]


def _score(f: float, train_tokens: int):
    """Rows (block, kind, id, value, held, body) sorted by (block, kind): a block's words (0) and grams (1), then its documents (2)."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelled_score"]

    def documents(rows: pa.RecordBatch, answers: _Answers) -> Iterator[pa.RecordBatch]:
        answers.settle()
        bodies = rows.column("body").to_pylist()
        for i, j in _parts(bodies):
            tokens, known, base, score, spelled = scored([b" ".join(words_of(body)) for body in bodies[i:j]], answers, f)
            yield pa.record_batch([rows.column("id").slice(i, j - i), rows.column("held").slice(i, j - i), tokens, known, np.full(j - i, train_tokens, np.int64), base, score, spelled], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answers = None, _Answers()
        for batch in batches:
            blocks, parts = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(parts) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, answers = blocks[a], _Answers()
                if parts[a] < 2:
                    answers.take(int(parts[a]), batch.slice(a, b - a))
                else:
                    yield from documents(batch.slice(a, b - a), answers)

    return run


def score(docs: DataFrame, gain: float = GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score per row; null texts count as empty: one token, the end.

    Learns from rows whose crc32(doc_id as text) mod FOLDS isn't HELD; a null id counts as the empty text in folds.
    With no training rows every probability is that of the uniform distribution. Repeated rows come back repeated."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _blocks(docs)
    asked = rows.select("block", "train", "body")
    words = asked.mapInArrow(_ask_words, "block bigint, word binary, n bigint")
    ends = rows.groupBy("block").agg(F.lit(b"\n").alias("word"), F.count_if("train").alias("n"))
    inquiries = written(words.union(ends))
    blocks = inquiries.filter(F.col("word") == F.lit(b"\n")).count()
    settle(spark)
    # a common word has a row in every block: summed before the shuffle, and joined back by a join that Spark can split
    counted = written(inquiries.groupBy("word").agg(F.sum("n").alias("c")))
    settle(spark)
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    known = written(inquiries.select("block", "word").join(counted, "word"))
    discard(inquiries, counted)
    settle(spark)
    found = asked.mapInArrow(_ask_grams, "block bigint, gram bigint, n bigint")  # cheaper to run again than to keep
    counts = written(found.groupBy("gram").agg(F.sum("n").alias("n")))
    settle(spark)
    tree = written(suffix_tree(counts, gain))
    discard(counts)
    settle(spark)
    answers = found.select("block", "gram").join(tree, "gram")
    none = lambda kind: F.lit(None).cast(kind)
    met = (
        known.select("block", F.lit(0).alias("kind"), F.col("c").alias("id"), none("float").alias("value"), none("boolean").alias("held"), F.col("word").alias("body"))
        .union(answers.select("block", F.lit(1), "gram", F.col("lp").cast("float"), none("boolean"), none("binary")))
        .union(rows.select("block", F.lit(2), "doc_id", none("float"), ~F.col("train"), "body"))
    )
    # by number: merged into few tasks, as small partitions are else, blocks would be sorted together at a greater cost of memory
    dealt = met.repartition(max(1, min(4 * blocks, MOST_TASKS)), "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(_score(1.0 / (n + v + 1), int(n)), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, spelled_score double")
