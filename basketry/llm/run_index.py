"""Run-length index of a group of byte strings: repeats found from a run-compressed BWT.

The suffixes of all strings are sorted; the Burrows-Wheeler transform keeps the byte before each. Only
at the ends of its runs are positions sampled and compared with their neighbour in the order: within
a run the match just goes on from one byte before, so the matching statistics of all other positions
follow from the samples by streaming over the text. Repetitive strings have few runs.

Where only matches of a certain length are wanted, ``repeated_parts`` first cuts out what occurs once.
"""

from __future__ import annotations

import numpy as np

_SYMBOLS = 7  # of 9 bits, in the first sort key
WINDOW = 64  # bytes that must occur twice for a part to stay
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def repeated_parts(text: np.ndarray, starts: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where parts begin and end that hold every match of ``least`` (``WINDOW`` or more) bytes, and the string each is from.

    A match lies in windows that all stand elsewhere in the group too. Windows are hashed by sums of powers
    and counted in a table by some bits of the hash, those that are not alone again by others: one that
    repeats is never lost, a few others may stay. Runs of them are the parts.
    """
    n, none = len(text), np.empty(0, dtype="i8")
    if n < max(least, WINDOW):
        return none, none, none
    lengths = np.diff(np.r_[starts, n])
    with np.errstate(over="ignore"):
        ahead, back = np.full(n + 1, _BASE, dtype="u8"), np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype="u8")
        ahead[0] = back[0] = 1
        ahead, back = np.cumprod(ahead), np.cumprod(back)
        sums = np.concatenate([np.zeros(1, dtype="u8"), np.cumsum((text.astype("u8") + np.uint64(1)) * ahead[:n])])
        window = (sums[WINDOW:] - sums[:-WINDOW]) * back[: n - WINDOW + 1]
        window = (window ^ (window >> np.uint64(29))) * np.uint64(_BASE) + np.repeat(group, lengths)[: len(window)].astype("u8")
        window = (window ^ (window >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    rest = (np.repeat(starts + lengths, lengths) - np.arange(n))[: len(window)]
    kept = np.flatnonzero(rest >= WINDOW)
    for shift in (40, 20, 0):
        slots = 1 << max(10, int(2 * len(kept)).bit_length())
        slot = ((window[kept] >> np.uint64(shift)) & np.uint64(slots - 1)).astype("i8")
        kept = kept[np.bincount(slot, minlength=slots)[slot] > 1]
    if not len(kept):
        return none, none, none
    owner = np.searchsorted(starts, kept, side="right") - 1
    first = np.flatnonzero(np.r_[True, (np.diff(kept) != 1) | (np.diff(owner) != 0)])
    last = np.r_[first[1:], len(kept)] - 1
    begin, end = kept[first], kept[last] + WINDOW
    long = end - begin >= least
    return begin[long], end[long], owner[first][long]


class RunLengthIndex:
    """Of strings in groups; a match is looked for among the strings of the same group.

    ``text`` is all strings in a row, ``starts`` where each begins, ``group`` its group, ascending.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, group: np.ndarray):
        n = len(text)
        ends = np.append(starts[1:], n)[: len(starts)]
        lengths = ends - starts
        self.text, self.n = text, n
        self.first = np.zeros(n, dtype=bool)
        self.first[starts] = True
        self.rest = np.repeat(ends, lengths) - np.arange(n)  # bytes left in the own string
        self.group = np.repeat(group, lengths)
        order = self._sort()
        before = np.where(self.first, -1 - np.arange(n), text[np.arange(n) - 1].astype("i8"))  # a start is unlike all others
        same_run = before[order[1:]] == before[order[:-1]]
        inside = self.group[order[1:]] == self.group[order[:-1]]
        border = np.flatnonzero(~same_run & inside)  # between order[i] and order[i + 1]
        #: the run-compressed transform: byte before the run and where it begins in the order
        self.run_starts = np.r_[0, np.flatnonzero(~(same_run & inside)) + 1] if n else np.empty(0, dtype="i8")
        self.run_heads = before[order[self.run_starts]] if n else before
        #: samples: the last position of a run and the first of the next
        self.run_ends, self.next_starts = order[border], order[border + 1]

    def _sort(self) -> np.ndarray:
        n = self.n
        key = np.zeros(n, dtype="i8")
        for k in range(_SYMBOLS):  # a byte plus one; zero after the end of the string
            symbol = np.zeros(n, dtype="i8")
            symbol[: n - k] = self.text[k:].astype("i8") + 1
            key = (key << 9) | np.where(self.rest > k, symbol, 0)
        order = np.lexsort((key, self.group))
        changed = (key[order[1:]] != key[order[:-1]]) | (self.group[order[1:]] != self.group[order[:-1]])
        rank = np.empty(n, dtype="i8")
        rank[order] = np.r_[0, np.cumsum(changed)] if n else 0
        depth, longest = _SYMBOLS, int(self.rest.max(initial=0))
        while depth < longest and n and rank[order[-1]] < n - 1:
            second = np.zeros(n, dtype="i8")
            more = np.flatnonzero(self.rest > depth)
            second[more] = rank[more + depth] + 1
            both = rank * (n + 1) + second
            # only positions whose rank is shared move
            shared = np.bincount(rank, minlength=n)[rank[order]] > 1
            moving = order[shared]
            order[shared] = moving[np.argsort(both[moving], kind="stable")]
            rank[order] = np.r_[0, np.cumsum(both[order[1:]] != both[order[:-1]])]
            depth *= 2
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common part of the strings from ``a`` and from ``b`` on, by halving steps."""
        most = np.minimum(self.rest[a], self.rest[b])
        length = np.zeros(len(a), dtype="i8")
        alive = np.arange(len(a))
        while len(alive):
            step = 64
            at = length[alive]
            room = np.minimum(most[alive] - at, step)
            x = (a[alive] + at)[:, None] + np.arange(step)
            y = (b[alive] + at)[:, None] + np.arange(step)
            equal = self.text[np.minimum(x, self.n - 1)] == self.text[np.minimum(y, self.n - 1)]
            equal &= np.arange(step)[None, :] < room[:, None]
            run = np.where(equal.all(axis=1), step, equal.argmin(axis=1))
            length[alive] += run
            alive = alive[run == step]
        return length

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of the longest match that also starts elsewhere in the group."""
        best = np.zeros(self.n, dtype="i8")
        for s in range(0, len(self.run_ends), 1 << 15):
            a, b = self.run_ends[s : s + (1 << 15)], self.next_starts[s : s + (1 << 15)]
            common = self._common(a, b)
            np.maximum.at(best, a, common)
            np.maximum.at(best, b, common)
        # a match of length l at a position is one of l - 1 at the next
        reach = np.maximum.accumulate(best + np.arange(self.n))
        return np.maximum(np.minimum(reach - np.arange(self.n), self.rest), 0)

    def long_matches(self, least: int) -> np.ndarray:
        """Positions at which a match of ``least`` bytes or more starts."""
        return np.flatnonzero(self.matching_statistics() >= least)
