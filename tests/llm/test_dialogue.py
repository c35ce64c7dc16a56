import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import dialogue
from tallyloom.llm import dialogue_costs as dc

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        code = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def key(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())


def cheapest(rows):
    """(cost, audit, roles and texts) by a shortest-path search over all edits, of ties the least audit."""
    must = {}
    seen = set()
    for k, (_, _, role, text) in enumerate(rows):
        bare = text.rstrip(WHITE)
        must[k] = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
    import heapq

    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, last, made = heapq.heappop(heap)
        if (k, last) in done:
            continue
        done.add((k, last))
        if k == len(rows) and last in ("", "a"):
            return cost, audit, [x for x in made], [must[i] for i in range(len(rows))]
        grow = next(c for c in legal[last] if c in "ua")
        name = {"u": "user", "a": "assistant"}[grow]
        heapq.heappush(heap, (cost + 3, audit + "I", k, grow, (*made, f"{name}:")))
        if k < len(rows):
            _, _, role, text = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, last, made))
            if must[k] not in ("blank", "duplicate"):
                more = 3 * (must[k] == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, grow, (*made, f"{name}:{text}")))
                if role[:1] and role[0] in legal[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, role[0], (*made, f"{role}:{text}")))


def brute(original, rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    out = []
    for conv in {r[0] for r in original}:
        mine = sorted(by[conv], key=key)
        cost, audit, made, faults = cheapest(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=str)


def made_up(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            rows.append((conv or None, rng.choice([turn, turn, turn, None, turn // 2]), role, rng.choice(["Yes.", "No", " \n", "", None, "Why? ", "A. b", f"number {turn}!", f"number {turn}"])))
    return rows


def same(spark, rows, parts=None):
    convs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "turn as part", "role as fault", "1 as piece")
    if parts:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hurt = dialogue.damage(convs)
        assert sorted((tuple(r)[:4] for r in hurt.filter("not dropped").collect()), key=str) == sorted(damaged(rows), key=str)
        assert sorted(map(tuple, dialogue.repair(hurt, F.col("dropped")).collect()), key=str) == brute(rows, damaged(rows))
        assert sorted(map(tuple, dialogue.repair(convs).collect()), key=str) == brute(rows, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    same(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations_whole_and_in_pieces(spark, monkeypatch, seed):
    rows = made_up(seed, 60, 12)
    same(spark, rows)
    same(spark, rows, parts=True)


def test_one_conversation_of_many_ranges_and_pieces(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {t}.", f"text {t}", "ok."])) for t in range(3000)] + [(7, 5, "user", "again and again.")] * 1500 + [(8, 1, "user", "Hi.")]
    rows += [(9, None, "user", "x" * 200_000), (9, None, "assistant", "y." * 200_000)]
    convs = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, dialogue.repair(convs).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, rows)


def test_turns_are_the_repaired_conversation(spark):
    rows = made_up(9, 40, 9)
    convs = spark.createDataFrame(rows, SCHEMA)
    digests = {r.conv_id: (r.audit, r.repaired_sha256) for r in dialogue.repair(convs).collect()}
    by = defaultdict(list)
    for r in sorted(dialogue.repaired_turns(convs).collect(), key=lambda r: (r.part, r.piece, r.place)):
        by[r.conv_id].append(r)
    for conv, (audit, sha) in digests.items():
        assert "".join(r.edit for r in by[conv]) == audit
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in by[conv] if r.edit != "D").encode()).hexdigest() == sha


def test_pieces_chain_to_the_whole():
    """A matrix a piece, chained, costs what the whole costs, for every split."""
    rng = np.random.default_rng(3)
    role, must, late = rng.integers(0, 4, (9, 5)), rng.random((9, 5)) < 0.2, rng.random((9, 5)) < 0.3
    late &= ~must
    whole = dc.costs(role, must, late, np.repeat(dc.ENDING[:, None], 5, 1))
    for cut in range(10):
        behind = dc.costs(role[cut:], must[cut:], late[cut:], np.repeat(dc.ENDING[:, None], 5, 1))
        ahead = dc.costs(role[:cut], must[:cut], late[:cut], behind[0])
        assert (ahead[0] == whole[0]).all() or cut == 0


def test_empty_table(spark):
    convs = spark.createDataFrame([], SCHEMA)
    assert dialogue.repair(convs).count() == 0 and dialogue.repaired_turns(convs).count() == 0
