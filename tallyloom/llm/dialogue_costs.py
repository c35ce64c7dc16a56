"""Cheapest edits of conversations of one length, as a dynamic programme over time-major NumPy tensors.

A column is a conversation (or a piece of one), a row of the tensor a turn. The states are what has been emitted so
far: nothing, a system turn, a user turn last, an assistant turn last. Edits and their costs are those of `dialogue`.
"""

from __future__ import annotations

import numpy as np

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: First letters of roles that a legal conversation has, by code; any other role is OTHER.
INITIALS, OTHER = "sua", 3
#: State after a user or assistant turn emitted in each state: the only one that is legal there.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: State after keeping a role (row) in a state (column); 4 where that is illegal.
KEPT = np.array([[SYSTEM, 4, 4, 4], [USER, USER, 4, USER], [4, 4, ASSISTANT, 4], [4, 4, 4, 4]])
DELETE, INSERT, REROLE, LATE = 4, 3, 3, 3
NEVER = 1 << 40
#: Cost of ending in each state: a conversation is over after nothing or an assistant turn, else turns are inserted.
ENDING = np.array([0, 2 * INSERT, INSERT, 0])


def _staying(must: np.ndarray, late: np.ndarray) -> np.ndarray:
    """What not deleting a turn adds."""
    return np.where(must != 0, np.int64(NEVER), LATE * late.astype(np.int64))


def costs(role: np.ndarray, must: np.ndarray, late: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Least cost from before each turn on, by state: [turns + 1, 4, columns]. role, must (be deleted), late (costs more
    if it stays): [turns, columns]; tail: the cost after the last turn, [4, columns]."""
    out = np.empty((len(role) + 1, 4, role.shape[1]), np.int64)
    out[-1] = tail
    after = np.full((5, role.shape[1]), NEVER)  # the fifth state is for illegal keeps
    for t in range(len(role) - 1, -1, -1):
        after[:4] = out[t + 1]
        stays = _staying(must[t], late[t])
        keep = np.take_along_axis(after, KEPT[role[t]].T, axis=0)
        now = np.minimum(np.minimum(keep, after[NEXT] + REROLE) + stays, after[:4] + DELETE)
        user, assistant = now[USER].copy(), now[ASSISTANT].copy()
        now[USER], now[ASSISTANT] = np.minimum(user, assistant + INSERT), np.minimum(assistant, user + INSERT)
        now[:2] = np.minimum(now[:2], now[USER] + INSERT)
        out[t] = np.minimum(now, NEVER)
    return out


def trace(cost: np.ndarray, role: np.ndarray, must: np.ndarray, late: np.ndarray, state: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The cheapest edits from `state` on, of ties the ASCII-least letters: a string a column, and the states at the end.

    Letters are taken one by one in their order D, I, K, R wherever the rest still costs the least. Turns are inserted
    behind the last one only in columns that end there."""
    turns, columns = role.shape
    state, each = state.copy(), np.arange(columns)
    letters: list[np.ndarray] = []
    for t in range(turns + 1):
        here = cost[t]
        while True:
            left = here[state, each]
            drop = cost[t + 1][state, each] + DELETE == left if t < turns else ~ends
            insert = ~drop & (here[NEXT[state], each] + INSERT == left)
            if not insert.any():
                break
            letters.append(np.where(insert, ord("I"), 0).astype(np.uint8))
            state = np.where(insert, NEXT[state], state)
        if t == turns:
            break
        stays, kept = _staying(must[t], late[t]), KEPT[role[t], state]
        keep = ~drop & (kept < 4) & (cost[t + 1][np.minimum(kept, 3), each] + stays == left)
        letters.append(np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R"))).astype(np.uint8))
        state = np.where(drop, state, np.where(keep, kept, NEXT[state]))
    rows = np.array(letters, np.uint8).reshape(len(letters), columns).T
    return [row.tobytes().replace(b"\0", b"").decode() for row in rows], state


def by_length(lengths: np.ndarray) -> list[np.ndarray]:
    """Positions of the conversations of each length."""
    order = np.argsort(lengths, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []


def columns(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """[length, columns] of flat values, a column from each start."""
    return values[starts[None, :] + np.arange(length)[:, None]]
