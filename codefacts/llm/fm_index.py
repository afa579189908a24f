"""A bidirectional FM-index over a delimited vocabulary, searched for many words at a time."""

from __future__ import annotations

from functools import cached_property

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The order of all rotations, by doubling the length they are compared at."""
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (rank.max() + 1) + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        steps = np.diff(key[order], prepend=key[order[0]]) != 0
        rank = np.empty_like(key)
        rank[order] = np.cumsum(steps)
        if rank[order[-1]] == len(text) - 1:
            return order
        k *= 2


class Half:
    """One direction: the last column of the sorted rotations as a wavelet matrix, for steps to the left in ``text``."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])
        column = text[suffix_order(text) - 1]
        self.ones, self.zeros = [], []
        base = np.zeros(1 << self.bits, np.int64)  # where each symbol starts after the last level
        place = np.arange(1 << self.bits)
        for level in range(self.bits - 1, -1, -1):
            bit = (column >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            self.ones.append(ones)
            self.zeros.append(len(column) - int(ones[-1]))
            up = (place >> level) & 1 == 1
            base = np.where(up, self.zeros[-1] + ones[base], base - ones[base])
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        self.base = base

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ranks of the patterns with ``symbol`` before them, and how many had a smaller one there."""
        smaller = np.zeros_like(lo)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            smaller += np.where(up, (hi - lo) - (b - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        shift = self.before[symbol] - self.base[symbol]
        return lo + shift, hi + shift, smaller

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """(parent, symbol, lo, hi, smaller) for every symbol that stands before a pattern."""
        parent, symbol, smaller = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            none = (hi - lo) - (b - a)
            down, up = none > 0, b > a
            parent = np.concatenate([parent[down], parent[up]])
            symbol = np.concatenate([symbol[down] << 1, symbol[up] << 1 | 1])
            smaller = np.concatenate([smaller[down], (smaller + none)[up]])
            lo, hi = np.concatenate([(lo - a)[down], zeros + a[up]]), np.concatenate([(hi - b)[down], zeros + b[up]])
        shift = self.before[symbol] - self.base[symbol]
        return parent, symbol, lo + shift, hi + shift, smaller


class Vocabulary:
    """Words between delimiters, ``|w1|w2|...|``, indexed in both directions.

    ``words`` are sorted and differ. The pattern ``|w|`` has the rank of ``w`` among the words plus one, since only the end
    of the text sorts before them.
    """

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)  # the delimiter comes first
        self.text = np.searchsorted(self.alphabet, points).astype(np.int64)

    @cached_property
    def leftward(self) -> Half:
        return Half(self.text, len(self.alphabet))

    @cached_property
    def rightward(self) -> Half:
        return Half(self.text[::-1].copy(), len(self.alphabet))

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All symbols of the words one after the other (-1: not in the index), where each starts, and their lengths."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return np.where(self.alphabet[at] == points, at, -1), np.cumsum(sizes) - sizes, sizes

    def near(self, queries: list[str], exact: str) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all words one insertion, deletion or replacement away whose ``exact`` half, "left" or
        "right", is the query's: the half is matched as it stands, then the pattern grows across the other half with
        one error. The left half has length // 2 symbols. Pairs are distinct and sorted."""
        left = exact == "left"
        half = self.rightward if left else self.leftward
        codes, starts, sizes = self.codes(queries if left else [q[::-1] for q in queries])
        stop = sizes // 2 if left else sizes - sizes // 2
        # a pattern: its query, place in it, ranks in the direction it grows, and its first rank in the other one
        q = np.arange(len(queries))
        p, lo, hi, other = np.zeros_like(q), np.zeros_like(q), np.full_like(q, half.before[1]), np.zeros_like(q)
        whole = []
        while len(q):
            ready = p == stop[q]
            whole.append([a[ready] for a in (q, p, lo, hi, other)])
            q, p, lo, hi, other = (a[~ready] for a in (q, p, lo, hi, other))
            q, p, lo, hi, other = self._exact(half, q, p, lo, hi, other, codes, starts)
        q, p, lo, hi, other = (np.concatenate(a) for a in zip(*whole, strict=True)) if whole else (q, p, lo, hi, other)
        erred = [a[:0] for a in (q, p, lo, hi, other)]
        found, turn = [], 0
        while len(q) or len(erred[0]):
            more = [erred]
            # without an error so far: any symbol but the delimiter may be inserted or replace the next, or one is left out
            at, symbol, lo2, hi2, smaller = half.children(lo, hi)
            letter = symbol > 0
            at, symbol, lo2, hi2, smaller = (a[letter] for a in (at, symbol, lo2, hi2, smaller))
            inside = p < sizes[q]
            following = np.where(inside, codes[np.minimum(starts[q] + p, len(codes) - 1)] if len(codes) else -1, -1)
            grown = [q[at], p[at], lo2, hi2, other[at] + smaller]
            more.append(grown)
            same, next_ = symbol == following[at], inside[at]
            replaced = [grown[0], grown[1] + 1, *grown[2:]]
            more.append([a[next_ & ~same] for a in replaced])
            more.append([a[inside] for a in (q, p + 1, lo, hi, other)])
            q, p, lo, hi, other = (a[next_ & same] for a in replaced)
            eq, ep, elo, ehi, eother = (np.concatenate(a) for a in zip(*more, strict=True))
            ended = ep == sizes[eq]
            a, b, smaller = half.step(elo[ended], ehi[ended], np.zeros(int(ended.sum()), np.int64))
            is_word = b > a
            rank = (eother[ended] + smaller) if left else a
            found.append((eq[ended][is_word], rank[is_word] - 1))
            rest = [x[~ended] for x in (eq, ep, elo, ehi, eother)]
            erred = list(self._exact(half, *rest, codes, starts))
            turn += 1
            if turn % 8 == 0:  # in runs of one letter, errors at different places lead to the same pattern
                by = np.lexsort(erred[:4])
                fresh = np.any([np.diff(a[by], prepend=-1) != 0 for a in erred[:4]], axis=0)
                erred = [a[by][fresh] for a in erred]
        if not found:
            return q, q
        pairs = np.unique(np.stack([np.concatenate(a) for a in zip(*found, strict=True)]), axis=1)
        return pairs[0], pairs[1]

    @staticmethod
    def _exact(half, q, p, lo, hi, other, codes, starts):
        """The patterns grown by the next symbol of their queries; those without a match are gone."""
        symbol = codes[starts[q] + p]
        known = symbol >= 0
        q, p, lo, hi, other, symbol = (a[known] for a in (q, p, lo, hi, other, symbol))
        lo, hi, smaller = half.step(lo, hi, symbol)
        some = hi > lo
        return q[some], p[some] + 1, lo[some], hi[some], (other + smaller)[some]
