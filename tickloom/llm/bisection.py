"""Recursive graph bisection: documents that share terms come to stand near one another.

The graph joins documents with their terms. A node of documents is cut into halves such that writing the gaps
between a term's documents takes few bits: a term in d of a half's n documents costs d * log2(n / (d + 1)). In rounds, the
documents whose moves save most on either side change places in pairs, until no pair saves anything; then each half is cut in
the same way. A cut keeps, for each term, what it costs less on one side than on the other, so that documents which were not there
when it was made are sent to a side by the same costs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ROUNDS = 12


def bits(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Cost of the gaps of terms that stand in d of n documents."""
    return d * np.log2(np.maximum(n, 1) / (d + 1.0))


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, minlength=n)


@dataclass
class Cuts:
    """For each level and node the terms' cost on side 1 less that on side 0, and the sum from which on side 0 is taken."""

    costs: list[np.ndarray] = field(default_factory=list)
    least: list[np.ndarray] = field(default_factory=list)

    def leaves(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """The leaf of each of n documents, from its (row, term) pairs."""
        node = np.zeros(n, dtype=np.int64)
        for costs, least in zip(self.costs, self.least, strict=True):
            node = 2 * node + (summed(rows, costs[node[rows], terms], n) < least[node])
        return node


def _exchange(node: np.ndarray, side: np.ndarray, gain: np.ndarray, nodes: int) -> np.ndarray:
    """Documents that change sides: in each node the i-th best of side 0 with the i-th best of side 1, while both save."""
    order = np.lexsort((-gain, side, node))
    key = 2 * node[order] + side[order]
    rank = np.arange(len(order)) - np.searchsorted(key, key)
    width = int(rank.max()) + 1
    gains = np.full((2 * nodes, width), -np.inf)
    gains[key, rank] = gain[order]
    pair = gains[0::2] + gains[1::2] > 1e-9
    return order[pair[key // 2, rank]]


def bisect(rows: np.ndarray, terms: np.ndarray, n: int, n_terms: int, depth: int, rounds: int = ROUNDS) -> Cuts:
    """The cuts of n documents, given as (row, term) pairs without repeats, ``depth`` levels deep."""
    cuts, node = Cuts(), np.zeros(n, dtype=np.int64)
    for level in range(depth):
        nodes = 1 << level
        order = np.argsort(node, kind="stable")
        sizes = np.bincount(node, minlength=nodes)
        side = np.empty(n, dtype=np.int64)
        side[order] = (np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)) % 2
        for last in range(rounds, -1, -1):
            degree = np.bincount((2 * node[rows] + side[rows]) * n_terms + terms, minlength=2 * nodes * n_terms).reshape(nodes, 2, n_terms)
            size = np.bincount(2 * node + side, minlength=2 * nodes).reshape(nodes, 2, 1)
            if not last:
                break
            now = bits(size, degree)
            less, more = now - bits(size, np.maximum(degree - 1, 0)), bits(size, degree + 1) - now
            saved = less - more[:, ::-1]
            gain = summed(rows, saved[node[rows], side[rows], terms], n)
            moved = _exchange(node, side, gain, nodes)
            if not len(moved):
                break
            side[moved] ^= 1
        extra = bits(size, degree + 1) - bits(size, degree)
        costs = (extra[:, 1] - extra[:, 0]).astype(np.float32)
        total = summed(rows, costs[node[rows], terms], n)
        least = np.zeros(nodes)
        for k in range(nodes):
            if len(own := total[node == k]):
                least[k] = np.median(own)
        cuts.costs.append(costs)
        cuts.least.append(least)
        node = 2 * node + (total < least[node])
    return cuts
