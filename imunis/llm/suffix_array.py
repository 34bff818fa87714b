"""Suffix array of many short byte strings, by two-stage sorting in numpy.

Suffixes end with their string and are told apart up to ``depth`` bytes. A
suffix smaller than its successor (the suffix one byte later) is sorted
directly. The others follow by induction: scanning the buckets of first bytes
in ascending order, each suffix puts its predecessor, if that is larger, at the
next free place of the predecessor's bucket. A bucket is scanned at once, as an
array; only runs of one byte take it in several steps.
"""

from __future__ import annotations

import numpy as np


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k:len(data) + k] << np.uint64(56 - 8 * k)
    return out


class Suffixes:
    """Strings laid out one behind the other, each followed by a separator that is smaller than any byte."""

    def __init__(self, strings: list[bytes], depth: int):
        self.depth = depth
        sizes = np.array([len(s) for s in strings], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
        self.data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        n = len(self.data)
        self.string = np.repeat(np.arange(len(strings)), sizes + 1)
        #: Bytes from each position to its string's end; 0 at separators.
        self.left = (self.first + sizes)[self.string] - np.arange(n)
        self.symbol = np.where(self.left == 0, 0, self.data.astype(np.int16) + 1)
        self.eight = _eight(self.data)

    def smaller_than_next(self) -> np.ndarray:
        """Whether each suffix is smaller than its successor; separators count as such."""
        step = np.zeros(len(self.symbol), np.int16)
        step[:-1] = self.symbol[1:] - self.symbol[:-1]
        step[self.symbol == 0] = 1
        # Equal neighbours are as their next unequal ones.
        decided = np.where(step != 0, np.arange(len(step)), len(step) - 1)
        decided = np.minimum.accumulate(decided[::-1])[::-1]
        return step[decided] > 0

    def sort_directly(self, at: np.ndarray) -> np.ndarray:
        """Positions ordered by the bytes of their suffixes up to the depth; one that ends there before one with zero bytes."""
        if not len(at):
            return at
        left = np.minimum(self.left[at], self.depth)
        short = np.flatnonzero(left < self.depth)
        if len(short):  # later a stable sort keeps this order among equal bytes
            order = np.argsort(left, kind="stable")
            at, left = at[order], left[order]
            short = np.flatnonzero(left < self.depth)
        padded = np.concatenate([self.data, np.zeros(self.depth, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, self.depth)[at]
        if len(short):
            rows[short] = np.where(np.arange(self.depth) < left[short, None], rows[short], 0)
        return at[np.argsort(rows.view(f"S{self.depth}").ravel(), kind="stable")]

    def array(self, least: int = 1) -> np.ndarray:
        """All positions with ``least`` bytes or more to their string's end, in order of their suffixes up to the depth.

        The suffixes that these are induced from are sorted along with them.
        """
        symbol, small = self.symbol, self.smaller_than_next()
        asked = self.left >= max(least, 1)
        needed = asked.copy()
        edge = np.flatnonzero(asked & ~small)
        while len(edge):  # a larger suffix is placed by its successor
            edge = edge[~needed[edge + 1]] + 1
            needed[edge] = True
            edge = edge[~small[edge]]
        direct = np.flatnonzero(small & needed & (symbol > 0))
        direct = self.sort_directly(direct)
        direct_by = np.split(direct, np.searchsorted(symbol[direct], np.arange(1, 257)))
        induced = needed & ~small
        waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
        out = []
        for c in range(257):
            if c == 0:
                bucket = np.flatnonzero((symbol == 0) & needed)
            else:
                parts = waiting[c]
                run = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                while len(run):  # predecessors with the same first byte, one step of the run at a time
                    run = run[run > 0] - 1
                    run = run[(symbol[run] == c) & induced[run]]
                    parts.append(run)
                bucket = np.concatenate([*parts, direct_by[c]])
                out.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[(symbol[before] > c) & induced[before]]
            if len(before):
                to = symbol[before]
                order = np.argsort(to, kind="stable")
                before, to = before[order], to[order]
                edges = np.flatnonzero(np.diff(to)) + 1
                for part in np.split(before, edges):
                    waiting[symbol[part[0]]].append(part)
        order = np.concatenate(out) if out else np.zeros(0, np.int64)
        return order[asked[order]]

    def common_prefixes(self, order: np.ndarray) -> np.ndarray:
        """Length of the prefix that each suffix of ``order`` shares with the one before it, up to the depth; first 0."""
        a, b = order[:-1], order[1:]
        most = np.minimum(np.minimum(self.left[a], self.left[b]), self.depth)
        out = np.zeros(len(order), np.int64)
        live = np.arange(len(a))
        for k in range(-(-self.depth // 8)):
            if not len(live):
                break
            differ = self.eight[np.minimum(a[live] + 8 * k, len(self.data) - 1)] ^ self.eight[np.minimum(b[live] + 8 * k, len(self.data) - 1)]
            same = np.zeros(len(live), np.int64)
            for j in range(8):
                same += (differ >> np.uint64(56 - 8 * j)) == 0
            out[live + 1] += same
            live = live[differ == 0]
        out[1:] = np.minimum(out[1:], most)
        return out
