"""Upper bounds on the scores of blocks of points, and exact search that skips blocks by them (TOP-1).

``Clusters`` groups dense unit vectors around centres: a point is no nearer to a question than the
angle between the question and the centre less the radius of the cluster allows. ``Impacts`` groups
rows of word counts by their heaviest bucket and keeps the greatest weight of every bucket in a
block: no row of it scores more than the question's weights times those.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Scores are compared after rounding at six places; a bound must be lower by this to rule a block out.
SLACK = 2e-6
#: Rows of a block of impacts, centres of a chunk at most, and rounds in which the centres settle.
ROWS, CENTRES, ROUNDS = 128, 128, 3
#: Rows of which ``Impacts`` holds unit vectors at once.
_UNITS = 2048


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64, copy=False)
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths != 0)


class Clusters:
    """Blocks of neighbouring unit vectors. Rows are in id order and ``members`` are their numbers."""

    def __init__(self, vectors: np.ndarray):
        unit = _unit(vectors)
        n = min(CENTRES, max(1, int(len(unit) ** 0.5)))
        centres = unit[np.linspace(0, len(unit) - 1, n).astype(np.int64)] if len(unit) else np.zeros((0, vectors.shape[1]))
        for _ in range(ROUNDS):
            own = (unit @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            some, start = np.unique(own[by := np.argsort(own, kind="stable")], return_index=True)
            if len(some):
                sums[some] = np.add.reduceat(unit[by], start)
            moved = _unit(sums)
            centres = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, moved, centres)
        near = unit @ centres.T
        own = near.argmax(axis=1)
        self.members, self.centres, radii = [], [], []
        for c in range(len(centres)):
            at = np.flatnonzero(own == c)
            if len(at):
                self.members.append(at)
                self.centres.append(centres[c])
                # A zero vector scores 0 with everything: at a right angle to all centres.
                angles = np.arccos(np.clip(near[at, c], -1, 1))
                empty = np.abs(unit[at]).sum(axis=1) == 0
                radii.append(np.pi if empty.any() else angles.max())
        self.radii = np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest score that a row of each block can have with each question."""
        angles = np.arccos(np.clip(_unit(queries) @ np.array(self.centres).T, -1, 1))
        return np.cos(np.maximum(angles - self.radii - 1e-7, 0))


class Impacts:
    """Blocks of rows with the same heavy buckets. A bucket on many rows is cut like any other, into one weight per block."""

    def __init__(self, vectors: np.ndarray):
        most, heavy = np.zeros(len(vectors)), np.zeros(len(vectors), np.int64)
        if vectors.size:
            for at in range(0, len(vectors), _UNITS):
                unit = _unit(vectors[at : at + _UNITS])
                most[at : at + _UNITS], heavy[at : at + _UNITS] = unit.max(axis=1), unit.argmax(axis=1)
        order = np.lexsort((-most, heavy)) if vectors.size else np.arange(len(vectors))
        self.members = [np.sort(order[i : i + ROWS]) for i in range(0, len(order), ROWS)]
        width = vectors.shape[1] if vectors.ndim > 1 else 0
        self.most, self.least = np.zeros((len(self.members), width)), np.zeros((len(self.members), width))
        for i, m in enumerate(self.members):
            unit = _unit(vectors[m])
            if width:
                self.most[i], self.least[i] = unit.max(axis=0), unit.min(axis=0)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        unit = _unit(queries)
        return np.maximum(unit, 0) @ self.most.T + np.minimum(unit, 0) @ self.least.T


METHODS: dict[str, Callable[[np.ndarray], Clusters | Impacts]] = {"clusters": Clusters, "impacts": Impacts}


def prune_pairs(blocks: Clusters | Impacts, queries: np.ndarray, best, meet: Callable) -> tuple[int, int]:
    """Bring ``best`` to the best rows of each question; returns the pairs of blocks and questions, and how many of them were skipped.

    Each question first meets the block with its highest bound; the ``k``-th score from there rules out
    most of the others. ``meet`` compares rows with questions, both by number.
    """
    bounds = blocks.bounds(queries)
    first, done = bounds.argmax(axis=1), 0

    def visit(block: int, asked: np.ndarray) -> None:
        nonlocal done
        done += len(asked)
        meet(rows=blocks.members[block], columns=asked)

    for block in np.unique(first):
        visit(block, np.flatnonzero(first == block))
    for block in np.argsort(-bounds.max(axis=0), kind="stable"):
        visit(block, np.flatnonzero((first != block) & (bounds[:, block] + SLACK >= best.score[:, -1])))
    pairs = len(blocks.members) * len(queries)
    return pairs, pairs - done
