"""Context-tree weighting over byte contexts, on sorted arrays.

The next byte is a path of eight binary decisions; each decision has a tree of
its own over the bytes before it. A node is (the last d bytes, the bits of the
next byte decided so far) and holds how often a zero and a one followed. Its
Krichevsky-Trofimov estimate is weighed half and half with the product of its
children, the nodes that know one more byte; so a prediction mixes the
estimates of all depths 0 to D. A context that training never met goes by the
deepest one that it did.

A key is D context bytes, nearest first, and the next byte, in one 64-bit number;
a node is a context (missing bytes zero) and the heap index (1 to 255) of its bits.
Sorted by context, the children of a node lie together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Depths up to this are shared by all shards; below it a shard holds whole subtrees.
TOP = 2
_HALVES = np.cumsum(np.concatenate([[0.0], np.log(np.arange(65536) + 0.5)]))
_ONES = np.cumsum(np.concatenate([[0.0], np.log(np.arange(65536) + 1.0)]))


def log_rising(n: np.ndarray, table: np.ndarray, start: float) -> np.ndarray:
    """log of start (start + 1) ... (start + n - 1): from the table, else by Stirling's series."""
    small = table[np.minimum(n, len(table) - 1)]
    if not len(n) or n.max() < len(table):
        return small
    x = n + start
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x)
    return np.where(n < len(table), small, series - (0.5 * np.log(np.pi) if start == 0.5 else 0.0))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log probability that the KT estimator gives to any sequence of so many zeros and ones."""
    return log_rising(zeros, _HALVES, 0.5) + log_rising(ones, _HALVES, 0.5) - log_rising(zeros + ones, _ONES, 1.0)


def context_keys(stream: np.ndarray, depth: int) -> np.ndarray:
    """The key of every byte of ``stream`` but the first ``depth``."""
    n = len(stream) - depth
    keys = stream[depth:].astype(np.uint64)
    for d in range(1, depth + 1):
        keys |= stream[depth - d : depth - d + n].astype(np.uint64) << np.uint64(8 * (depth + 1 - d))
    return keys


@dataclass
class Nodes:
    """Nodes of one depth, sorted by ``key`` (context << 8 | heap index)."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    #: log of the product of the children's weighted probabilities.
    below: np.ndarray

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """log of the weighted probability, and the KT estimate's share in it."""
        own = log_kt(self.zeros, self.ones)
        both = np.logaddexp(own, self.below) - np.log(2.0)
        return both, np.exp(own - both - np.log(2.0))

    def chance(self) -> np.ndarray:
        """The KT estimate of a one."""
        return (self.ones + 0.5) / (self.zeros + self.ones + 1.0)


def grouped(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the sums of the values, and where each row went."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(key) else np.empty(0, bool)
    starts = np.flatnonzero(first)
    to = np.empty(len(key), np.int64)
    to[order] = np.cumsum(first) - 1
    sums = (np.add.reduceat(v[order], starts) if len(key) else v for v in values)
    return (ordered[starts], *sums, to)


def leaf_nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[Nodes, list[np.ndarray]]:
    """Nodes of the deepest level from sorted distinct keys; per decision, the node of each key."""
    parts, rows = [], []
    context, byte = keys & ~np.uint64(0xFF), keys & np.uint64(0xFF)
    for bit in range(8):
        node = context | ((np.uint64(1) << np.uint64(bit)) | (byte >> np.uint64(8 - bit)))
        is_one = (byte >> np.uint64(7 - bit)) & np.uint64(1) == 1
        first = np.concatenate([[True], node[1:] != node[:-1]])  # keys are sorted, so equal nodes are neighbours
        starts = np.flatnonzero(first)
        ones = np.add.reduceat(np.where(is_one, counts, 0), starts)
        total = np.add.reduceat(counts, starts)
        parts.append((node[starts], total - ones, ones))
        rows.append(np.cumsum(first) - 1)
    key, zeros, ones = (np.concatenate([p[k] for p in parts]) for k in range(3))
    at = np.cumsum([0] + [len(p[0]) for p in parts])
    return Nodes(key, zeros, ones, log_kt(zeros, ones)), [r + a for r, a in zip(rows, at, strict=False)]


def lift(nodes: Nodes, depth: int, level: int) -> tuple[Nodes, np.ndarray]:
    """The nodes one level up (``level`` context bytes left of ``depth``), and each node's parent."""
    weighted = nodes.below if level + 1 == depth else nodes.weighted()[0]  # the deepest level has its estimate only
    spare = np.uint64(8 * (depth - level + 1))
    parent = (nodes.key >> spare << spare) | (nodes.key & np.uint64(0xFF))
    key, zeros, ones, below, to = grouped(parent, nodes.zeros, nodes.ones, weighted)
    return Nodes(key, zeros, ones, below), to


@dataclass
class Mix:
    """What depths down to a level have settled: the prediction so far, what it took, and the weight that is left."""

    final: np.ndarray
    taken: np.ndarray
    left: np.ndarray


def mix_down(nodes: Nodes, to: np.ndarray | None, above: Mix | None, deepest: bool) -> Mix:
    """Predictions of a level from those of the level above; ``to`` is each node's parent there."""
    taken = above.taken[to] if above else np.zeros(len(nodes.key))
    left = above.left[to] if above else np.ones(len(nodes.key))
    chance = nodes.chance()
    seen = nodes.zeros + nodes.ones > 0
    inherited = above.final[to] if above else np.full(len(nodes.key), 0.5)
    share = np.ones(len(nodes.key)) if deepest else nodes.weighted()[1]
    final = np.where(seen, taken + left * chance, inherited)
    return Mix(final, np.where(seen, taken + left * share * chance, inherited), np.where(seen, left * (1 - share), 0.0))


class Subtrees:
    """The tree over sorted distinct ``keys``, from ``depth`` up to ``top`` context bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> None:
        nodes, self.rows = leaf_nodes(keys, counts)
        self.byte = keys & np.uint64(0xFF)
        self.levels, self.parents = [nodes], []
        for level in range(depth - 1, top - 1, -1):
            nodes, to = lift(nodes, depth, level)
            self.levels.append(nodes)
            self.parents.append(to)

    def log_probabilities(self, mix: Mix) -> np.ndarray:
        """log10 probability of each key's byte, from the mix at the top level."""
        for k in range(len(self.levels) - 2, -1, -1):
            mix = mix_down(self.levels[k], self.parents[k], mix, k == 0)
        out = np.zeros(len(self.byte))
        for bit, rows in enumerate(self.rows):
            one = mix.final[rows]
            out += np.log10(np.where((self.byte >> np.uint64(7 - bit)) & np.uint64(1) == 1, one, 1 - one))
        return out
