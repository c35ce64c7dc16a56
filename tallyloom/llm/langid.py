"""Language ID by multilingual mixture inference.

Each language has a likelihood of byte trigrams, counted over all training rows (sums over Spark, no sample).
For each document expectation-maximisation estimates the languages' proportions from its trigrams; the set of
languages grows from the largest proportion on while the penalised likelihood rises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches, small_batches

#: Trigrams are hashed to so many counters, so a model has a bounded size: this times the number of languages.
GRAMS = 1 << 16
MAX_LANGS = 500
ROUNDS = 12
#: Price of one more language, times the logarithm of the number of trigrams.
PENALTY = 4.0
#: Every fold but 0 of so many is for training.
FOLDS = 5
UNKNOWN = "und"
#: A text is rejected if its languages explain a trigram no better than this log-likelihood: that of an even choice.
FLOOR = -float(np.log(GRAMS))
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Codes of the byte trigrams of the lower-cased text, ASCII non-letters as blanks, runs of three blanks left out."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.uint16)
    packed = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    packed = packed[packed != 0x202020]
    return ((packed * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, at most GRAMS however long the text, and their counts."""
    if len(codes) < 4096:
        return np.unique(codes, return_counts=True)
    n = np.bincount(codes, minlength=GRAMS)
    found = np.flatnonzero(n)
    return found, n[found]


def has_letter(text: str | None) -> bool:
    return bool(text) and (not text.isascii() or text.lower() != text.upper()) and any(map(str.isalpha, text))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed within the task; a full table is passed on and begun again."""
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        at = {lang: np.flatnonzero(n) for lang, n in held.items()}
        return pa.record_batch({"lang": pa.array([lang for lang, x in at.items() for _ in range(len(x))], pa.string()), "gram": pa.array(np.concatenate([*at.values()]), pa.int32()), "n": pa.array(np.concatenate([held[lang][x] for lang, x in at.items()]), pa.int64())})

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in held:
                if len(held) >= 64:
                    yield out()
                    held.clear()
                held[lang] = np.zeros(GRAMS, np.int64)
            if len(text) < 20_000:
                np.add.at(held[lang], grams(text), 1)
            else:
                held[lang] += np.bincount(grams(text), minlength=GRAMS)
    if held:
        yield out()


class Model:
    """langs, and the log-likelihood of each trigram code under each."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.1
        self.loglik = np.ascontiguousarray(np.log(smooth / smooth.sum(0))).astype(np.float32)

    def mixture(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation and their log-likelihood. x: distinct trigrams x L log-likelihoods; n: how often each occurs."""
        top = x.max(1, keepdims=True)
        p = np.exp(x - top)
        pi = np.full(x.shape[1], 1 / x.shape[1], np.float32)
        for _ in range(ROUNDS if x.shape[1] > 1 else 0):
            new = pi * (p.T @ (n / (p @ pi))) / n.sum()
            done = np.abs(new - pi).max() < 1e-3
            pi = new
            if done:
                break
        return pi, float(n @ (np.log(p @ pi) + top[:, 0]))

    def infer(self, text: str | None) -> tuple[list[str], list[float], float]:
        """Languages of the text from the largest share on, their shares, and the log-likelihood of a trigram; nothing is known of a text without letters."""
        if not self.langs or not has_letter(text):
            return [], [], -np.inf
        codes, n = _distinct(grams(text))
        if not len(codes):
            return [], [], -np.inf
        x, total = self.loglik[codes], int(n.sum())
        n = n.astype(np.float32)
        shares, _ = self.mixture(x, n)
        order = np.argsort(-shares, kind="stable")
        best, lik = (order[:1], np.ones(1)), float(n @ x[:, order[0]])
        for k in range(2, len(order) + 1):
            if shares[order[k - 1]] < 0.02:
                break
            some, more = self.mixture(x[:, order[:k]], n)
            if more - PENALTY * np.log(total) <= lik:
                break
            best, lik = (order[:k], some), more
        rank = np.argsort(-best[1], kind="stable")
        return [self.langs[best[0][r]] for r in rank], [float(best[1][r]) for r in rank], lik / total

    def predict(self, text: str | None) -> tuple[str, float, list[str]]:
        """Main language, its share, and the languages of the text from the largest share on."""
        langs, shares, _ = self.infer(text)
        return (langs[0], min(1.0, shares[0]), langs) if langs else (UNKNOWN, 0.0, [])

    def known(self, text: str | None) -> bool:
        """Whether the languages inferred for a text, however many, explain it."""
        return self.infer(text)[2] > FLOOR


def fit(docs: DataFrame) -> Model:
    """Counts over all rows with a text and a lang whose fold isn't 0. What reaches the driver is at most GRAMS counters a language."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0)).select("lang", "text")
    sums = rows.mapInArrow(_counts, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("counts")).orderBy("lang").limit(MAX_LANGS + 1).toArrow()
    if packed.num_rows > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counts = np.zeros((GRAMS, packed.num_rows))
    for k, row in enumerate(packed.column("counts")):
        found = row.values
        counts[found.field("gram").to_numpy(), k] = found.field("n").to_numpy()
    return Model(packed.column("lang").to_pylist(), counts)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs per row. Only the text decides. A null text or one without a letter,
    and every text when there was nothing to learn from, is `und` with score 0. A null id counts as the empty text
    in folds (held out). Repeated rows come back repeated, an empty table gives none. More than MAX_LANGS languages
    to learn from are an error, as the model would outgrow what a task holds."""
    model = model or fit(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.predict(t) for t in batch.column(2).to_pylist()]
        return pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64()), "langs": pa.array([x[2] for x in found], pa.list_(pa.string()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text")
    return map_batches(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double, langs array<string>")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows of docs whose text is in known languages: one or a mixture of any number that explains its trigrams better than
    an even choice. Null texts, those without a letter and those in no known language go. All columns, lang too, stay
    as they are. Rows are judged apart: repeated ones stay or go together; an empty table gives an empty one. A table
    without training rows loses all rows; more than MAX_LANGS languages are an error."""
    model = model or fit(docs)
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(map(model.known, batch.column(at).to_pylist()), pa.bool_()))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)
