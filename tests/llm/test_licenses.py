import random
import re
from re import _parser as parser

import pytest

from tallyloom.llm import licenses
from tallyloom.llm.license_rules import LEVELS

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
PLANTED = [
    ("Licensed under the Apache License, Version 2.0.", "apache-2"), ("Released under the MIT License.", "mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc,cc-by-nc-4.0"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2-or-later"), ("// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "apache-2-llvm"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the", "mit"),
    ("see https://creativecommons.org/licenses/by-sa/4.0/ for more", "cc-by-sa-4.0"), ("Es kommt mit Lizenz, a license without a name", "")
]


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    words = words_of(text)
    places = [(i, label) for label, phrase in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def brute_resolved(hits):
    """The rule stated pair by pair."""
    kept = []
    for level in range(len(LEVELS)):
        free = [h for h in hits if h[2].level == level and not any(h[0] < k[1] and k[0] < h[1] for k in kept)]
        within = lambda h, o: o[0] <= h[0] and h[1] <= o[1] and (o[:2] != h[:2] or o[2].place < h[2].place)
        kept += [h for h in free if not any(within(h, o) for o in free)]
    return sorted(kept, key=lambda h: (h[0], h[1], h[2].place))


def written_by(pattern, rng):
    """A text that the pattern matches."""
    def one(op, arg):
        if op is parser.LITERAL:
            return chr(arg)
        if op is parser.NOT_LITERAL:
            return "q"
        if op is parser.IN:
            if arg[0][0] is parser.NEGATE:
                return "q"
            kind, value = rng.choice(arg)
            return chr(value if kind is parser.LITERAL else rng.randint(*value))
        if op is parser.SUBPATTERN:
            return some(arg[3])
        if op is parser.BRANCH:
            return some(rng.choice(arg[1]))
        if op is parser.MAX_REPEAT:
            return "".join(some(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        assert op in (parser.ASSERT, parser.ASSERT_NOT), op
        return ""

    some = lambda items: "".join(one(op, arg) for op, arg in items)
    return some(parser.parse(pattern.pattern.decode()))


def test_every_match_of_every_rule_passes_its_gate():
    rng = random.Random(4)
    assert len(licenses.rules()) > 250
    for rule in licenses.rules():
        for _ in range(30):
            text = f" {written_by(rule.pattern, rng)} ".encode()
            assert rule.pattern.search(text), (rule, text)
            assert rule in licenses.tried(set(text.split())), (rule, text)


def test_resolution_against_pairs():
    rng, rules = random.Random(8), licenses.rules()
    for _ in range(400):
        hits = []
        for _ in range(rng.randint(0, 25)):
            a = rng.randint(0, 40)
            hits.append((a, a + rng.randint(1, 12), rng.choice(rules)))
        hits = list({h[:2] + (h[2].place,): h for h in hits}.values())
        assert licenses.resolved(hits) == brute_resolved(hits)


@pytest.mark.parametrize("which", ["small", "odd", "planted"])
def test_against_brute_force(spark, request, which):
    if which == "planted":
        long = "word " * 30_000 + "under the MIT license. " * 40 + "cc by nc cc by nc " * 3 + "x " * 20_000
        docs = spark.createDataFrame([(1, long), (2, "—under the mit license"), (3, "under the mit license—"), (4, "Apache License\n\n Version\t2"), (5, "ÜNDER the MIT licenses")] + [(9, t) for t, _ in PLANTED] * 2, "doc_id bigint, text string")
    else:
        docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    want = []
    for doc_id, text in rows:
        joined = f" {' '.join(words_of(text))} ".encode()
        stay = brute_resolved(licenses.matches(joined, list(licenses.rules())))
        base = brute_base(text)
        labels = {h[2].label for h in stay} | set(filter(None, base[4].split(",")))
        best = max([list(LEVELS.values())[h[2].level] for h in stay] + [LEVELS["notice"]] * (base[1] > 0), default=0.0)
        want.append((doc_id, *base, ",".join(sorted(labels)), best))
    assert sorted(map(tuple, licenses.report(docs).collect()), key=str) == sorted(want, key=str)


def test_planted_lines_and_clean_texts(spark):
    docs = spark.createDataFrame([(k, f"Some prose before. {t} And after.") for k, (t, _) in enumerate(PLANTED)], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in licenses.report(docs).collect()}
    assert [got[k] for k in range(len(PLANTED))] == [labels for _, labels in PLANTED]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = given.select("doc_id", given.text.rlike(r"(?i)licen[sc]e|cc by").alias("has")).join(licenses.report(given), "doc_id").collect()
    assert all((r.score > 0.5) == r.has and (r.labels in ("", "all-rights-reserved")) != r.has for r in rows)


def test_spans_hold_the_matched_words(spark):
    docs = spark.createDataFrame([(1, "A line. Licensed under the Apache License, Version 2.0! (c) All rights reserved."), (2, None)], "doc_id bigint, text string")
    got = sorted(map(tuple, licenses.spans(docs).collect()))
    assert got == [(1, "all-rights-reserved", "hint", 11, 14, "all rights reserved"), (1, "apache-2", "notice", 2, 10, "licensed under the apache license version 2 0")]


def test_empty_table(empty):
    assert licenses.report(empty).count() == 0 and licenses.spans(empty).count() == 0
