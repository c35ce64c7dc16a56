import math
import random
from zlib import crc32

import numpy as np
import pytest

from tallyloom.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures(spark, small):
    model = langid.fit(small)
    by = {}
    for r in small.collect():
        by.setdefault(r.lang, []).append(r.text[:3000])
    en, fr, de = " ".join(by["en"][:4]), " ".join(by["fr"][:4]), " ".join(by["de"][:4])
    n = min(map(len, (en, fr, de)))
    main, share, langs = model.predict(en[: n // 4] + fr[: 3 * n // 4])
    assert main == "fr" and langs == ["fr", "en"] and 0.6 < share < 0.9
    assert set(model.predict(en[:n] + fr[:n] + de[:n])[2]) == {"en", "fr", "de"}
    assert model.predict(en[:n])[1:] == (1.0, ["en"])


def plain_mixture(model, codes):
    """Expectation-maximisation over every trigram one by one, in doubles."""
    x = model.loglik.astype(np.float64)[codes]

    def em(some):
        p = [[math.exp(v) for v in row] for row in x[:, some]]
        pi = [1 / len(some)] * len(some)
        for _ in range(langid.ROUNDS if len(some) > 1 else 0):
            sums = [0.0] * len(some)
            for row in p:
                total = sum(a * b for a, b in zip(pi, row, strict=True))
                for k, v in enumerate(row):
                    sums[k] += pi[k] * v / total
            new = [s / len(p) for s in sums]
            done = max(abs(a - b) for a, b in zip(new, pi, strict=True)) < 1e-3
            pi = new
            if done:
                break
        return pi, sum(math.log(sum(a * b for a, b in zip(pi, row, strict=True))) for row in p)

    shares, _ = em(list(range(len(model.langs))))
    order = sorted(range(len(shares)), key=lambda k: -shares[k])
    best, lik = ([order[0]], [1.0]), em(order[:1])[1]
    for k in range(2, len(order) + 1):
        if shares[order[k - 1]] < 0.02:
            break
        some, more = em(order[:k])
        if more - langid.PENALTY * math.log(len(codes)) <= lik:
            break
        best, lik = (order[:k], some), more
    return sorted(((s, model.langs[k]) for k, s in zip(*best, strict=True)), reverse=True)


def test_against_a_plain_em(small):
    model = langid.fit(small)
    texts = [r.text for r in small.collect() if r.text]
    mixed = [a[:400] + " " + b[:300] + " " + c[:200] for a, b, c in zip(texts, texts[7:], texts[19:], strict=False)]
    checked = 0
    for text in [*texts[:60], *mixed[:40]]:
        codes = langid.grams(text[:2000])
        if langid.has_letter(text[:2000]) and len(codes):
            want, (main, share, langs) = plain_mixture(model, codes), model.predict(text[:2000])
            assert [lang for _, lang in want] == langs and main == langs[0] and share == pytest.approx(want[0][0], abs=1e-3)
            checked += 1
    assert checked > 60


def test_long_texts_take_bounded_memory(small):
    model = langid.fit(small)
    text = " ".join(r.text for r in small.collect() if r.lang == "en" and r.text)
    long = text * (4_000_000 // len(text) + 1)
    assert len(langid._distinct(langid.grams(long))[0]) <= langid.GRAMS
    assert model.predict(long)[::2] == ("en", ["en"])


def test_even_mixtures_stay_and_noise_goes(spark, small):
    model = langid.fit(small)
    by = {}
    for r in small.collect():
        if r.text and len(r.text) > 600:
            by.setdefault(r.lang, r.text[:600])
    assert len(by) >= 4 and model.known(" ".join(by.values()))
    rng = random.Random(3)
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(400))
    assert not model.known(noise) and not model.known(None) and not model.known("123")
    assert sum(map(model.known, (r.text for r in small.collect()))) >= 0.98 * small.count()


def test_only_training_rows_count(spark, small):
    held = small.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    assert langid.fit(held).langs == []
    assert {r.lang_pred for r in langid.identify(held).collect()} == {"und"}


def test_odd_rows(odd, empty, small):
    model = langid.fit(small)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    pred = {r.doc_id: r for r in rows}
    assert {pred[i].lang_pred for i in (1, 2, 3, 11)} == {"und"} and pred[11].score == 0
    assert pred[9].lang_pred == "de" and pred[4].lang_pred == "en"
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 11})
    assert langid.keep_identified(odd).count() <= odd.count() and langid.keep_identified(empty).count() == 0
