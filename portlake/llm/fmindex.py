"""FM-index of a sequence of word numbers, read both ways, exact for patterns up to a fixed number of words.

Rotations of the sequence are sorted by their first `depth` words only, by prefix doubling.  That is all that a pattern
of at most `depth` words can see, and it keeps the intervals and the last-to-first mapping of such patterns exact.
All patterns of one length are extended at once, as arrays.
"""

from __future__ import annotations

import numpy as np

#: The number that parts pieces; a pattern never holds it.
BREAK = 0


def rotations(codes: np.ndarray, depth: int) -> np.ndarray:
    """Where the rotations of `codes` begin, in the order of their first `depth` numbers, equal ones by place."""
    rank, known = codes.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        step = min(known, depth - known)
        rank = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        order = np.argsort(rank, kind="stable")
        ranked = rank[order]
        rank = np.empty(len(codes), np.int64)
        rank[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1]))
        known += step
    return order


class OneWay:
    """The Burrows-Wheeler transform of a sequence, and where each of its entries leads."""

    def __init__(self, codes: np.ndarray, depth: int):
        self.bwt = codes[rotations(codes, depth) - 1]
        self.follow = np.empty(len(codes), np.int32)  # a shard has far fewer words
        self.follow[np.argsort(self.bwt, kind="stable")] = np.arange(len(codes), dtype=np.int32)
        self.breaks = np.append(np.zeros(1, np.int32), np.cumsum(self.bwt == BREAK, dtype=np.int32))

    def inner(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many entries of each interval are no break."""
        return size - (self.breaks[lo + size] - self.breaks[lo])

    def extensions(self, lo: np.ndarray, size: np.ndarray, symbols: int) -> tuple[np.ndarray, ...]:
        """All extensions of the patterns with these intervals: (pattern, number put before it, begin of the interval, its size,
        entries of the pattern's interval with a smaller number)."""
        total = int(size.sum())
        pattern = np.repeat(np.arange(len(lo)), size)
        at = np.arange(total) + np.repeat(lo - (np.cumsum(size) - size), size)
        key, first, count = np.unique(pattern * symbols + self.bwt[at], return_index=True, return_counts=True)
        of, symbol = np.divmod(key, symbols)
        below = np.cumsum(count) - count
        below -= (np.cumsum(size) - size)[of]
        keep = symbol != BREAK
        return of[keep], symbol[keep], self.follow[at[first[keep]]], count[keep], below[keep]


class Patterns:
    """Patterns of one length: their words, their intervals in both directions and how often they occur."""

    def __init__(self, words: list[np.ndarray], lo: np.ndarray, back: np.ndarray, size: np.ndarray):
        self.words, self.lo, self.back, self.size = words, lo, back, size

    def where(self, keep: np.ndarray) -> Patterns:
        return Patterns([w[keep] for w in self.words], self.lo[keep], self.back[keep], self.size[keep])


class BothWays:
    """Index of `codes` (which begin with a break) and of their reverse; intervals are kept in step."""

    def __init__(self, codes: np.ndarray, symbols: int, depth: int):
        self.symbols = symbols
        self.count = np.bincount(codes, minlength=symbols)
        self.begin = np.concatenate([[0], np.cumsum(self.count)])
        self.left, self.right = OneWay(codes, depth), OneWay(codes[::-1], depth)

    def single(self, words: np.ndarray) -> Patterns:
        """The patterns of one word."""
        return Patterns([words], self.begin[words], self.begin[words], self.count[words])

    def extended(self, p: Patterns, leftwards: bool) -> Patterns:
        """Every pattern that has one more word on one side, with its occurrences."""
        if leftwards:
            of, word, lo, size, below = self.left.extensions(p.lo, p.size, self.symbols)
            return Patterns([word, *[w[of] for w in p.words]], lo, p.back[of] + below, size)
        of, word, back, size, below = self.right.extensions(p.back, p.size, self.symbols)
        return Patterns([*[w[of] for w in p.words], word], p.lo[of] + below, back, size)

    def inner(self, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences with a word before them, and with a word after them, in the same piece."""
        return self.left.inner(p.lo, p.size), self.right.inner(p.back, p.size)
