"""Cheapest edits of turn sequences, and the ASCII-least of the cheapest, for many sequences at once.

A sequence of turns is edited until its role initials read ``(s?(ua)+)?``. A node is a place between
turns and a state of that pattern; arcs are the edits, named by their initials. The cost program runs
backwards over the nodes of all sequences side by side. The arcs on cheapest ways are then ranked by
prefix doubling: nodes get ranks by the first initial of their least audit, then by the first two, four,
eight and so on, from the ranks of a node and of the node that its pointer has reached; the least ways
are read off the doubled pointers. Everything is numpy over whole blocks.
"""

from __future__ import annotations

import numpy as np

EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet; the last turn was of that role
STATES = 4
#: fixed values: costs of the edits and of a truncated turn that stays
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
EDITS = b"DIKR"  # in the order of their codes
FAR = 1 << 60  # no way
FINAL = np.array([0, FAR, FAR, 0])  # a sequence may end before any turn or after an assistant's

#: turns as bytes: the role initial, in capitals if truncated; x is any other role; d must go
KINDS = b"dsuaxSUAX"
_KIND = np.full(256, -1)
_KIND[list(KINDS)] = np.arange(len(KINDS))
_EXTRA = np.array([0, 0, 0, 0, 0] + [TRUNCATED] * 4)
_NONE = STATES  # a column of FAR behind the four states
_TURN = np.array([USER, USER, ASSISTANT, USER])  # where an inserted or rerolled turn leads
_KEEP = np.full((len(KINDS), STATES), _NONE)
for _at, _initial in enumerate(KINDS.decode().lower()):
    if _initial == "s":
        _KEEP[_at, EMPTY] = SYSTEM
    if _initial == "u":
        _KEEP[_at, [EMPTY, SYSTEM, ASSISTANT]] = USER
    if _initial == "a":
        _KEEP[_at, USER] = ASSISTANT
_REROLE = np.where(np.arange(len(KINDS))[:, None] == 0, _NONE, _TURN)


class Block:
    """Sequences of ``KINDS`` with the cost to go from each state at their end.

    ``last`` tells which sequences end there; the others are parts of longer ones, whose next part
    pays for what is inserted at the border.
    """

    def __init__(self, kinds: list[bytes], end: np.ndarray, last: np.ndarray):
        self.lengths = np.array([len(k) for k in kinds], dtype="i8")
        self.base = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.kind = _KIND[np.frombuffer(b"d".join([*kinds, b""]), dtype="u1")]  # one more place per sequence
        self.closing = np.zeros(len(self.kind), dtype=bool)
        self.closing[self.base + self.lengths] = True
        self.insert = ~self.closing
        self.insert[(self.base + self.lengths)[last]] = True
        self.cost = self._costs(end, last)

    def _costs(self, end: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least cost to go from each place and state."""
        cost = np.full((len(self.kind), STATES + 1), FAR)
        first = end.astype("i8")
        cost[self.base + self.lengths, :STATES] = np.where(last[:, None], _with_inserts(first), first)
        longest = np.argsort(-self.lengths, kind="stable")
        lengths, base = self.lengths[longest], self.base[longest]
        for back in range(1, int(lengths[0]) + 1 if len(lengths) else 0):
            active = np.searchsorted(-lengths, -back, side="right")
            at = base[:active] + lengths[:active] - back
            kind, onward = self.kind[at], cost[at + 1]
            stay = np.minimum(
                np.take_along_axis(onward, _KEEP[kind], 1) + KEEP, np.take_along_axis(onward, _REROLE[kind], 1) + REROLE
            )
            cost[at, :STATES] = _with_inserts(np.minimum(onward[:, :STATES] + DELETE, stay + _EXTRA[kind][:, None]))
        return np.minimum(cost, FAR)

    def arcs(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, edit) -> whether it lies on a cheapest way, and the node it leads to."""
        places, states = len(self.kind), np.arange(STATES)
        after = np.minimum(np.arange(places) + 1, places - 1)
        steps = (
            (DELETE, np.broadcast_to(states, (places, STATES)), after, ~self.closing),
            (INSERT, np.broadcast_to(_TURN, (places, STATES)), np.arange(places), self.insert),
            (KEEP + _EXTRA[self.kind][:, None], _KEEP[self.kind], after, ~self.closing),
            (REROLE + _EXTRA[self.kind][:, None], _REROLE[self.kind], after, ~self.closing),
        )
        here = self.cost[:, :STATES]
        good, to = np.zeros((places, STATES, len(steps)), dtype=bool), np.zeros((places, STATES, len(steps)), dtype="i8")
        for edit, (price, state, place, allowed) in enumerate(steps):
            onward = np.take_along_axis(self.cost[place], state, 1)
            good[:, :, edit] = allowed[:, None] & (onward < FAR) & (here == onward + price)
            to[:, :, edit] = place[:, None] * STATES + np.minimum(state, STATES - 1)
        return good.reshape(-1, len(steps)), to.reshape(-1, len(steps))

    def paths(self, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The least audit from each start node, and the state in which it ends."""
        good, to = self.arcs()
        ranks, pointers, steps = rank_nodes(good, to)
        # the arcs that lead on with the least initial and then the least ranked audit
        order = np.where(good, np.arange(len(EDITS)) * (len(ranks) + 1) + ranks[to], FAR)
        edit = np.argmin(order, axis=1)
        offsets, at = _ranges(steps[starts]), np.repeat(starts, steps[starts])
        for k, pointer in enumerate(pointers):
            move = (offsets >> k) & 1 == 1
            at[move] = pointer[at[move]]
        letters = np.frombuffer(EDITS, dtype="u1")[edit[at]].tobytes()
        ends = np.cumsum(steps[starts])
        audits = [letters[e - n : e] for e, n in zip(ends.tolist(), steps[starts].tolist())]
        return audits, pointers[-1][starts] % STATES

    def nodes(self, state: int) -> np.ndarray:
        """The first node of each sequence in a state."""
        return self.base * STATES + state


def rank_nodes(good: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Ranks of the nodes by their least audits, the pointers 1, 2, 4 ... edits on, and audit lengths.

    Two arcs of a node never bear the same initial, so the least audit of any length has one end and a
    pointer is all that a node needs to remember. A node without arcs points to itself; its audit is
    empty and comes first. The last pointers are the ends, so the last ranks are those of whole audits.
    """
    nodes = np.arange(len(good))
    ends = ~good.any(axis=1)
    first = np.argmax(good, axis=1)
    ranks = np.unique(np.where(ends, 0, 1 + first), return_inverse=True)[1].astype("i8")
    pointers = [np.where(ends, nodes, to[nodes, first])]
    steps = np.where(ends, 0, 1)
    while not ends[pointers[-1]].all():
        reached = pointers[-1]
        ranks = np.unique(ranks * len(nodes) + ranks[reached], return_inverse=True)[1].astype("i8")
        steps = steps + steps[reached]
        pointers.append(reached[reached])
    return ranks, pointers, steps


def _with_inserts(cost: np.ndarray) -> np.ndarray:
    """The least cost if turns may be inserted first."""
    user = np.minimum(cost[:, USER], cost[:, ASSISTANT] + INSERT)
    assistant = np.minimum(cost[:, ASSISTANT], cost[:, USER] + INSERT)
    early = np.minimum(cost[:, [EMPTY, SYSTEM]], user[:, None] + INSERT)
    return np.column_stack([early, user, assistant])


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each count, in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def whole(kinds: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Cost and least audit of whole sequences."""
    if not kinds:
        return [], []
    ones = np.ones(len(kinds), dtype=bool)
    block = Block(kinds, np.broadcast_to(FINAL, (len(kinds), STATES)), ones)
    audits, _ = block.paths(block.nodes(EMPTY))
    return block.cost[block.base, EMPTY].tolist(), audits


def crossing(kinds: list[bytes], last: np.ndarray) -> np.ndarray:
    """(part, state at its start, state at its end) -> least cost, for parts of sequences.

    A last part ends in no state; the cost of ending is in all four columns.
    """
    out = np.empty((len(kinds), STATES, STATES), dtype="i8")
    for state in range(STATES):
        end = np.where(last[:, None], FINAL, np.where(np.arange(STATES) == state, 0, FAR))
        block = Block(kinds, end, last)
        out[:, :, state] = block.cost[block.base, :STATES]
    return out


def parts(kinds: list[bytes], end: np.ndarray, last: np.ndarray) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Least audits of parts, the states they end in and their costs to go, for each state at the start,
    given the cost to go from each state at the end."""
    if not kinds:
        return [], np.empty((0, STATES), "i8"), np.empty((0, STATES), "i8")
    block, count = Block(kinds, end, last), len(kinds)
    audits, states = block.paths(np.concatenate([block.nodes(state) for state in range(STATES)]))
    return [audits[i::count] for i in range(count)], states.reshape(STATES, count).T, block.cost[block.base, :STATES]


def repaired(audit: bytes, roles: list[str], texts: list[str], state: int = EMPTY) -> tuple[list[str], int]:
    """The turns ``role:text`` that an audit leaves, and the state after them."""
    out, at = [], 0
    for edit in audit.decode():
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            role, text = roles[at], texts[at]
            state = SYSTEM if state == EMPTY and role[:1] == "s" else int(_TURN[state])
        else:
            state = int(_TURN[state])
            role, text = ("user" if state == USER else "assistant"), ("" if edit == "I" else texts[at])
        at += edit != "I"
        out.append(f"{role}:{text}")
    return out, state
