"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and then
alternating user and assistant turns.

Rows are dealt by ranges of (conversation, turn), so that one conversation may fill many tasks. A task repairs the
conversations that lie within its range by the tensors of `dialogue_costs`, bucketed by length. A conversation at the
edge of a range, or of over PIECE rows, is left in pieces: a piece's costs are a small matrix from its states to those
of the next piece; matrices are chained backwards, edits of each piece traced from any state, states chained forwards.

Edits: K keep 0; R rerole to user or assistant 3; D delete 4, a must for blank rows and duplicates; I insert an empty
user or assistant turn 3; a truncated row that is not deleted adds 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import dialogue_costs as dc
from .common import map_batches, small_batches, written

#: Rows and bytes of text of a piece at most (a longer text is a piece of its own).
PIECE, PIECE_BYTES = 1024, 8 << 20
_WHITE = "\t\n\x0b\x0c\r "
#: First fault of a row; duplicates are found among the rows of the conversation.
FINE, BLANK, TRUNCATED = 0, 1, 3

_FACTS = ["turn", "gone", "role_code", "fault", "digest"]
_TURN = [*_FACTS, "role", "text"]
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
_EDITED = "array<struct<edit: string, role: string, text: string>>"
_RESULT = f"conv_id long, gaps long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string, turns {_EDITED}"
_FIRST = f"{_RESULT}, part int, piece int, rows array<struct<turn: long, gone: boolean, role_code: tinyint, fault: tinyint, digest: binary, role: string, text: string>>"
_PLACE = "conv_id long, part int, piece int"
_PROFILE = f"{_PLACE}, codes binary, first_role tinyint, last_role tinyint, low long, high long, distinct_turns long, blank long, duplicate long, truncated long, illegal long"


def damage(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows damaged by crc32(`conv_id:turn`) mod 20, nulls as one space each: 0 drops the
    row (it stays with `dropped` set, for its conversation's sake), 1 empties the text, 2 takes its full stops, exclamation
    and question marks, 3 repeats the row, 4 makes it the user's. Rows without columns of these names are an error."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("__code") == 1, "").when(F.col("__code") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(F.col("__code") == 4, "user").otherwise(space("role"))
    rows = convs.select("conv_id", "turn", "role", "text").withColumn("__code", code)
    rows = rows.withColumn("__twice", F.explode(F.when(F.col("__code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("__code") == 0).alias("dropped"))


def _ranged(convs: DataFrame, gone: Column) -> DataFrame:
    """Rows with what can be told from each alone, dealt and sorted by conversation, turn (nulls first), digest of role and text.

    The row's own number comes last, so that rows that equal one another can lie in different ranges too."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), gone.alias("gone"), blank("role").alias("role"), blank("text").alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(_WHITE))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED).cast("tinyint")
    code = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(dc.OTHER).cast("tinyint")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    rows = rows.select("conv_id", "turn", "gone", code.alias("role_code"), fault.alias("fault"), digest.alias("digest"), *[F.when(~F.col("gone"), F.col(c)).otherwise("").alias(c) for c in ("role", "text")])
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")]
    return rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")


def _starts(ids: pa.Array) -> np.ndarray:
    """Where a run of equal ids starts; nulls are one id."""
    none, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    return np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (none[1:] != none[:-1])))) if len(ids) else np.zeros(0, np.int64)


def _edited(audit: str, state: int, roles: list[str], texts: list[str]) -> list[dict]:
    """What each edit makes of the turns: edit, role, text; a deleted turn has those it had."""
    out, k = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else (roles[k], texts[k])
        k += letter != "I"
        if letter == "K":
            state = dc.KEPT[dc.INITIALS.index(role[0])][state]
        elif letter != "D":
            state = dc.NEXT[state]
            role = "user" if state == dc.USER else "assistant"
        out.append({"edit": letter, "role": role, "text": text})
    return out


def _lines(edited: list[dict]) -> str:
    return "\n".join(f"{e['role']}:{e['text']}" for e in edited if e["edit"] != "D")


def _illegal(before, after):
    """Whether role codes side by side are neither su, ua nor au."""
    return ((before != 0) | (after != 1)) & ((before != 1) | (after != 2)) & ((before != 2) | (after != 1))


class _Rows:
    """Flat rows of several conversations (or pieces) with their faults, without the rows that are gone."""

    def __init__(self, owner: np.ndarray, n: int, rows: pa.StructArray, firsts: list[set[bytes]] | None = None) -> None:
        stays = ~rows.field("gone").to_numpy(zero_copy_only=False)
        self.rows, self.owner, self.n = rows.filter(pa.array(stays)), owner[stays], n
        self.role, fault = (self.rows.field(c).to_numpy() for c in ("role_code", "fault"))
        digest = self.rows.field("digest").to_pylist()
        again = pd.DataFrame({"o": self.owner, "d": digest}).duplicated().to_numpy()
        if firsts is not None:  # pieces: what their conversation has seen in earlier pieces
            again = again | np.fromiter((d not in firsts[o] for o, d in zip(self.owner, digest, strict=True)), bool, len(digest))
        self.blank = fault == BLANK
        self.duplicate = again & ~self.blank
        self.must = self.blank | self.duplicate
        self.late = (fault == TRUNCATED) & ~self.must
        self.lengths = np.bincount(self.owner, minlength=n)
        self.begin = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]

    def count(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner[: len(of)], of, self.n).astype(np.int64)

    def illegal(self) -> np.ndarray:
        return self.count((self.owner[1:] == self.owner[:-1]) & _illegal(self.role[:-1], self.role[1:]))

    def turns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Smallest and largest turn (as objects, None without one) and number of distinct ones, a conversation each."""
        known = ~self.rows.field("turn").is_null().to_numpy(zero_copy_only=False)
        value, owner = self.rows.field("turn").fill_null(0).to_numpy()[known], self.owner[known]
        lengths = np.bincount(owner, minlength=self.n)
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        low, high = np.full(self.n, None, object), np.full(self.n, None, object)
        has = lengths > 0
        low[has], high[has] = value[first[has]].tolist(), value[(first + lengths - 1)[has]].tolist()
        fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))[: len(value)]
        return low, high, np.bincount(owner, fresh, self.n).astype(np.int64)

    def buckets(self) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """For each length: which conversations have it, and their roles, musts and lates, time-major."""
        for which in dc.by_length(self.lengths):
            yield which, [dc.columns(v, self.begin[which], int(self.lengths[which[0]])) for v in (self.role, self.must, self.late)]


def _repaired(ids: pa.Array, rows: pa.StructArray, starts: np.ndarray, turns: bool) -> dict:
    """Columns of the results of whole conversations that lie side by side."""
    n = len(starts)
    r = _Rows(np.repeat(np.arange(n), np.diff(np.append(starts, len(rows)))), n, rows)
    audit, cost = [""] * n, np.zeros(n, np.int64)
    for which, (role, must, late) in r.buckets():
        cost_of = dc.costs(role, must, late, np.repeat(dc.ENDING[:, None], len(which), 1))
        strings, _ = dc.trace(cost_of, role, must, late, np.zeros(len(which), np.int64), np.ones(len(which), bool))
        cost[which] = cost_of[0][dc.NOTHING]
        for k, s in zip(which, strings, strict=True):
            audit[k] = s
    roles, texts = r.rows.field("role").to_pylist(), r.rows.field("text").to_pylist()
    edited = [_edited(a, dc.NOTHING, roles[b : b + m], texts[b : b + m]) for a, b, m in zip(audit, r.begin, r.lengths, strict=True)]
    low, high, distinct = r.turns()
    gaps = [0 if a is None else b - a + 1 - int(d) for a, b, d in zip(low, high, distinct, strict=True)]
    return {
        "conv_id": ids.take(pa.array(starts)), "gaps": pa.array(gaps, pa.int64()), "blank": r.count(r.blank), "duplicate": r.count(r.duplicate), "truncated": r.count(r.late),
        "illegal": r.illegal(), "cost": cost, "audit": audit, "repaired_sha256": [hashlib.sha256(_lines(e).encode()).hexdigest() for e in edited],
        "turns": edited if turns else [None] * n,
    }


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the schema; columns that are not given are null."""
    n = len(columns["conv_id"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _cut(turns: bool, schema: pa.Schema):
    """Sorted rows of a range: results of the conversations that surely lie within it, and pieces of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, None
        loose = True  # the first conversation at hand may have rows elsewhere: before this range, or in pieces made

        def structs(batch: pa.RecordBatch) -> pa.StructArray:
            return pa.StructArray.from_arrays([batch[c] for c in _TURN], _TURN)

        def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal made
            size, at = np.cumsum(pc.binary_length(batch["text"]).to_numpy()), 0
            while at < len(batch):
                upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE_BYTES, "right"))
                upto = min(max(upto, at + 1), at + PIECE, len(batch))
                rows = structs(batch.slice(at, upto - at))
                yield _batch({"conv_id": batch["conv_id"].slice(at, 1), "part": [part], "piece": [made], "rows": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows).cast(schema.field("rows").type)}, schema)
                made, at = made + 1, upto

        for batch in filter(len, batches):
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            starts = _starts(batch["conv_id"])
            if loose and len(starts) > 1:
                yield from pieces(batch.slice(0, int(starts[1])))
                batch, starts, loose = batch.slice(int(starts[1])), starts[1:] - starts[1], False
            if last := int(starts[-1]):
                yield _batch(_repaired(batch["conv_id"], structs(batch.slice(0, last)), starts[:-1], turns), schema)
            held = batch.slice(last)
            if len(held) >= PIECE or pc.sum(pc.binary_length(held["text"])).as_py() >= PIECE_BYTES:
                yield from pieces(held)
                held, loose = None, True
        if held is not None:
            yield from pieces(held)  # its conversation may go on in the next range

    return run


def _profiles(schema: pa.Schema):
    """Pieces to their counts, a byte a turn (role, must, late), and the least costs from each state to each (`matrix`)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, n = batch["rows"], len(batch)
        r = _Rows(np.repeat(np.arange(n), pc.list_value_length(rows).to_numpy()), n, rows.flatten(), [set(m or ()) for m in batch["firsts"].to_pylist()])
        codes = (r.role | r.must << 2 | r.late << 3).astype(np.uint8)
        matrix = np.empty((n, 16), np.int64)
        for which, turns in r.buckets():
            unit = np.repeat(np.where(np.eye(4, dtype=bool), 0, dc.NEVER), len(which), axis=1)
            matrix[which] = dc.costs(*(np.tile(t, (1, 4)) for t in turns), unit)[0].reshape(16, len(which)).T
        low, high, distinct = r.turns()
        slices = [slice(b, b + m) for b, m in zip(r.begin, r.lengths, strict=True)]
        return _batch({
            "conv_id": batch["conv_id"], "part": batch["part"], "piece": batch["piece"], "codes": [codes[s].tobytes() for s in slices], "matrix": matrix.tolist(), "low": low, "high": high, "distinct_turns": distinct,
            "first_role": [int(r.role[s][0]) if m else None for s, m in zip(slices, r.lengths, strict=True)], "last_role": [int(r.role[s][-1]) if m else None for s, m in zip(slices, r.lengths, strict=True)],
            "blank": r.count(r.blank), "duplicate": r.count(r.duplicate), "truncated": r.count(r.late), "illegal": r.illegal(),
        }, schema)

    return run


def _backward(schema: pa.Schema):
    """Pieces of each conversation from the last to the first: the least costs behind each (`tail`), and whether it ends there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tail = False, dc.ENDING
        at = None
        for batch in filter(len, batches):
            tails, ends = [], []
            for conv, matrix in zip(batch["conv_id"].to_pylist(), batch["matrix"].to_pylist(), strict=True):
                ends.append(not seen or conv != at)
                if ends[-1]:
                    seen, at, tail = True, conv, dc.ENDING
                tails.append(tail.tolist())
                tail = np.minimum((np.array(matrix).reshape(4, 4) + tail).min(axis=1), dc.NEVER)
            yield _batch({c: batch[c] for c in batch.schema.names if c != "matrix"} | {"tail": tails, "ends": ends}, schema)

    return run


def _traced(schema: pa.Schema):
    """Pieces with the edits from each of the four states: audits, the states they lead to, what they cost."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = pc.binary_length(batch["codes"]).to_numpy()
        codes, begin = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8), np.concatenate(([0], np.cumsum(lengths)))[:-1]
        tail, ends = np.array(batch["tail"].to_pylist(), np.int64), batch["ends"].to_numpy(zero_copy_only=False)
        audits, leads, spent = np.empty((len(batch), 4), object), np.empty((len(batch), 4), np.int64), np.empty((len(batch), 4), np.int64)
        for which in dc.by_length(lengths):
            code = dc.columns(codes, begin[which], int(lengths[which[0]]))
            turns = code & 3, code >> 2 & 1, code >> 3
            cost = dc.costs(*turns, tail[which].T)
            for s in range(4):
                audits[which, s], leads[which, s] = dc.trace(cost, *turns, np.full(len(which), s), ends[which])
                spent[which, s] = cost[0][s] - np.where(ends[which], 0, tail[which, leads[which, s]])
        return _batch({c: batch[c] for c in batch.schema.names} | {"audits": audits.tolist(), "leads": leads.tolist(), "spent": spent.tolist()}, schema)

    return run


def _forward(schema: pa.Schema):
    """Pieces of each conversation from the first to the last: the state that each begins in, its edits, and its counts as part of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at, state, role, turn = False, None, dc.NOTHING, None, None
        for batch in filter(len, batches):
            rows = batch.to_pylist()
            for r in rows:
                if not seen or r["conv_id"] != at:
                    seen, at, state, role, turn = True, r["conv_id"], dc.NOTHING, None, None
                r["state"], r["audit"], r["cost"] = state, r["audits"][state], r["spent"][state]
                state = r["leads"][state]
                if r["first_role"] is not None:
                    r["illegal"] += role is not None and _illegal(role, r["first_role"])
                    role = r["last_role"]
                if r["low"] is not None:
                    r["distinct_turns"] -= r["low"] == turn
                    turn = r["high"]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _mended(turns: bool, schema: pa.Schema):
    """Pieces met with their edits: the repaired lines."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, kept = [], []
        for rows, audit, state in zip(batch["rows"].to_pylist(), batch["audit"].to_pylist(), batch["state"].to_pylist(), strict=True):
            stay = [r for r in rows if not r["gone"]]
            edited = _edited(audit, state, [r["role"] for r in stay], [r["text"] for r in stay])
            lines.append(_lines(edited) if any(e["edit"] != "D" for e in edited) else None)
            kept.append(edited if turns else None)
        return _batch({c: batch[c] for c in schema.names if c in batch.schema.names} | {"lines": lines, "turns": kept}, schema)

    return run


def _sealed(schema: pa.Schema):
    """Pieces of each conversation in order, one at a time: sums, the whole audit, the digest of all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at = False, None

        def result() -> pa.RecordBatch:
            gaps = 0 if low is None else high - low + 1 - distinct
            return _batch({"conv_id": [at], "gaps": [gaps], "audit": ["".join(audit)], "repaired_sha256": [sha.hexdigest()]} | {c: [v] for c, v in sums.items()}, schema)

        for batch in filter(len, batches):
            for r in batch.to_pylist():
                if not seen or r["conv_id"] != at:
                    if seen:
                        yield result()
                    seen, at, sums, audit, sha, begun, low, high, distinct = True, r["conv_id"], dict.fromkeys(_COUNTS, 0), [], hashlib.sha256(), False, None, None, 0
                for c in _COUNTS:
                    sums[c] += r[c]
                audit.append(r["audit"])
                distinct += r["distinct_turns"]
                if r["low"] is not None:
                    low, high = r["low"] if low is None else low, r["high"]
                if r["lines"] is not None:
                    sha.update(("\n" * begun + r["lines"]).encode())
                    begun = True
        if seen:
            yield result()

    return run


def _joined(cut: DataFrame, turns: bool) -> DataFrame:
    """Pieces with their edits and lines, from the cut's pieces."""
    pieces = cut.filter("piece is not null")
    facts = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in _FACTS]))
    seen = pieces.select("conv_id", "part", "piece", F.explode(facts).alias("r")).filter(~F.col("r.gone") & (F.col("r.fault") != BLANK))
    first = seen.groupBy("conv_id", "r.digest").agg(F.min(F.struct("part", "piece")).alias("at"))
    firsts = first.groupBy("at.part", "at.piece").agg(F.collect_list("digest").alias("firsts"))  # within a piece
    known = pieces.select("conv_id", "part", "piece", facts.alias("rows")).join(firsts, ["part", "piece"], "left")
    profile = f"{_PROFILE}, matrix array<long>"
    chained = map_batches(known, _profiles(_arrow(profile)), profile).repartition("conv_id")
    tailed = f"{_PROFILE}, tail array<long>, ends boolean"
    behind = chained.sortWithinPartitions("conv_id", F.desc("part"), F.desc("piece")).mapInArrow(_backward(_arrow(tailed)), tailed)
    traced = f"{tailed}, audits array<string>, leads array<tinyint>, spent array<long>"
    ahead = map_batches(behind, _traced(_arrow(traced)), traced).sortWithinPartitions("conv_id", "part", "piece")
    edits = f"{_PLACE}, state tinyint, audit string, low long, high long, distinct_turns long, {', '.join(f'{c} long' for c in _COUNTS)}"
    chosen = ahead.mapInArrow(_forward(_arrow(edits)), edits)
    met = pieces.select("part", "piece", "rows").join(chosen, ["part", "piece"])
    mended = f"{_PLACE}, audit string, lines string, turns {_EDITED}, low long, high long, distinct_turns long, {', '.join(f'{c} long' for c in _COUNTS)}"
    return map_batches(met, _mended(turns, _arrow(mended)), mended)


def _first_cut(convs: DataFrame, gone: Column | None, turns: bool) -> DataFrame:
    small_batches(convs.sparkSession)
    return written(_ranged(convs, F.lit(False) if gone is None else gone).mapInArrow(_cut(turns, _arrow(_FIRST)), _FIRST))


def repair(convs: DataFrame, gone: Column | None = None) -> DataFrame:
    """A row a conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    convs has conv_id, turn, role, text; other columns are ignored. Turns are taken in order, nulls first, ties by the
    digest of role and text. Nulls in role and text count as one space, so such a text is blank; a null conv_id is a
    conversation. Rows where `gone` holds only say that their conversation exists: without other rows it gets zeros, an
    empty audit and the digest of the empty text. Repeated rows are duplicates. An empty table gives no rows.
    Nothing of a conversation's texts is held but PIECE rows; its result is one row, with one letter an edit."""
    cut = _first_cut(convs, gone, False)
    pieces = _joined(cut, False).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    names = [c.split()[0] for c in _RESULT.split(", ")[:9]]
    return cut.filter("piece is null").select(*names).unionByName(pieces.mapInArrow(_sealed(_arrow(_RESULT)), _RESULT).select(*names))


def repaired_turns(convs: DataFrame, gone: Column | None = None) -> DataFrame:
    """The edits themselves, a row each: conv_id, part, piece, place, edit (D, I, K or R), role, text.

    In the order of (part, piece, place), rows other than D are the repaired conversation; a row of D has what was deleted."""
    cut = _first_cut(convs, gone, True)
    whole = cut.filter("piece is null").select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("piece"), "turns")
    every = whole.unionByName(_joined(cut, True).select("conv_id", "part", "piece", "turns"))
    return every.select("conv_id", "part", "piece", F.posexplode("turns").alias("place", "turn")).select("conv_id", "part", "piece", "place", "turn.edit", "turn.role", "turn.text")
