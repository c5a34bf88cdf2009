"""Levenshtein distances by bit vectors, one query or many at once, and a BK-tree over words."""

from __future__ import annotations

import numpy as np


def distance(a: str, b: str) -> int:
    """The Levenshtein distance of two words; a bit per character of a."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, d = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus = down | ~(h | up) & full
        minus = up & h
        d += bool(plus & top) - bool(minus & top)
        plus = (plus << 1 | 1) & full
        up = (minus << 1 | ~(x | plus)) & full
        down = plus & x
    return d


class Queries:
    """Words to be looked up together: those of up to 64 characters as bit columns, longer ones as they are."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        letters = sorted({c for w in words for c in w})
        self.code = {c: k for k, c in enumerate(letters)}
        self.eq = np.zeros((len(letters) + 1, len(words)), dtype=np.uint64)
        for q, w in enumerate(words):
            if len(w) <= 64:
                for k, c in enumerate(w):
                    self.eq[self.code[c], q] |= np.uint64(1 << k)

    def distances(self, word: str, at: np.ndarray) -> np.ndarray:
        """Distances of `word` to the queries at the given places."""
        n = self.length[at]
        d = n.copy()
        one = np.uint64(1)
        top = np.where(n > 0, one << np.maximum(n - 1, 0).astype(np.uint64), np.uint64(0))
        up, down = np.full(len(at), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
        for c in word:
            eq = self.eq[self.code.get(c, -1), at]
            x = eq | down
            h = (((eq & up) + up) ^ up) | eq
            plus = down | ~(h | up)
            minus = up & h
            d += (plus & top) != 0
            d -= (minus & top) != 0
            plus = plus << one | one
            minus = minus << one
            up = minus | ~(x | plus)
            down = plus & x
        for k in np.flatnonzero((n > 64) | (n == 0)):
            d[k] = distance(self.words[at[k]], word)
        return d


class Tree:
    """A BK-tree: a node per word, children by their distance to it."""

    def __init__(self, words: list[str]) -> None:
        self.words = list(dict.fromkeys(words))
        self.children: list[dict[int, int]] = [{} for _ in self.words]
        for k in range(1, len(self.words)):
            at = 0
            while True:
                d = distance(self.words[at], self.words[k])
                if d not in self.children[at]:
                    self.children[at][d] = k
                    break
                at = self.children[at][d]

    def within(self, queries: list[str], limits: np.ndarray) -> list[list[tuple[int, str]]]:
        """Per query, every word of the tree within its limit, with the distance.

        All queries go down together; a branch at distance e of a node is taken only by queries whose
        own distance d to the node has |d - e| within their limit (the triangle inequality).
        """
        out: list[list[tuple[int, str]]] = [[] for _ in queries]
        if not self.words or not queries:
            return out
        q = Queries(queries)
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, at = stack.pop()
            d = q.distances(self.words[node], at)
            lim = limits[at]
            for k in np.flatnonzero(d <= lim):
                out[at[k]].append((int(d[k]), self.words[node]))
            for e, child in self.children[node].items():
                go = np.abs(d - e) <= lim
                if go.any():
                    stack.append((child, at[go]))
        return out
