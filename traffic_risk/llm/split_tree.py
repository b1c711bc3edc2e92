"""A two-level tree of split points over vectors, searched by distance ranges.

Brin: Near neighbor search in large metric spaces (1995), the geometric near-neighbour access tree; the cells are those of Uhlmann's
generalised hyperplanes with many split points: a vector goes to the nearest one.

The search is by inner product. A vector x of squared norm q gets one more coordinate, sqrt(M - q) with M the largest squared norm of
all, and an anchor a gets 0 there. Then the squared distance of a and x is |a|^2 + M - 2 a.x, so a window of inner products is
an annulus around the anchor. Every split point holds the least and largest distance to the vectors of each cell beside
it; a cell goes if, for any split point, the triangle inequality keeps all its vectors out of the annulus. Distances are floating point and
get a slack that is far above their error; products are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

FAN = 16
"""Split points of a node, at most: 256 cells of the second level."""


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices, exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    largest = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class SplitTree:
    points: list[np.ndarray]
    """Split points: the first level's, then those of every cell."""
    top: int
    """Largest squared norm of all vectors."""
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    """Least distance of a cell's vectors to the split points of the first level, then to those of its node."""
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    """Largest of these distances; below ``low`` where the cell has no vector."""

    @property
    def slack(self) -> float:
        return 1e-6 * (1.0 + float(self.top) ** 0.5)

    def rest(self, rows: np.ndarray) -> np.ndarray:
        """The added coordinate of vectors."""
        return np.sqrt(np.maximum(self.top - (rows.astype(np.float64) ** 2).sum(axis=1), 0.0))

    def between(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances of vectors to split points."""
        inner = products(rows, points) + self.rest(rows)[:, None] * self.rest(points)[None, :]
        return np.sqrt(np.maximum(2.0 * self.top - 2.0 * inner, 0.0))

    def from_anchors(self, anchors: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances of anchors to split points."""
        return self.radius(anchors, products(anchors, points))

    def radius(self, anchors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance of the anchors (rows) at which a vector has the score."""
        own = (anchors.astype(np.float64) ** 2).sum(axis=1) + float(self.top)
        return np.sqrt(np.maximum(own[:, None] - 2.0 * scores, 0.0))

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of every vector, and its distances to the split points of both levels (nan: no such point)."""
        told = np.full((len(rows), 2 * FAN), np.nan)
        first = self.between(rows, self.points[0])
        node = first.argmin(axis=1)
        told[:, : first.shape[1]] = first
        leaf = np.zeros(len(rows), dtype=np.int64)
        for n in np.unique(node):
            mine = np.flatnonzero(node == n)
            second = self.between(rows[mine], self.points[1 + n])
            told[mine, FAN : FAN + second.shape[1]] = second
            leaf[mine] = n * FAN + second.argmin(axis=1)
        return leaf, told

    def reach(self, anchors: np.ndarray, node: int) -> np.ndarray:
        """Distances of anchors to the first level's split points and those of one node (nan: no such point)."""
        told = np.full((len(anchors), 2 * FAN), np.nan)
        for at, points in ((0, self.points[0]), (FAN, self.points[1 + node])):
            told[:, at : at + len(points)] = self.from_anchors(anchors, points)
        return told

    def open(self, reach: np.ndarray, low: np.ndarray, high: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """Whether vectors whose distances to the split points are within ``low`` and ``high`` can be in each anchor's annulus."""
        nearest = np.nanmax(np.maximum(reach - high, low - reach), axis=1)
        farthest = np.nanmin(reach + high, axis=1)
        return (nearest <= outer + self.slack) & (farthest >= inner - self.slack)

    def open_cells(self, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> list[int]:
        """The cells that are open for any of the anchors."""
        found = []
        for node in range(len(self.points) - 1):
            reach = self.reach(anchors, node)
            for leaf in range(node * FAN, node * FAN + len(self.points[1 + node])):
                if leaf < len(self.low) and not np.isnan(self.low[leaf, 0]):
                    if self.open(reach, self.low[leaf], self.high[leaf], inner, outer).any():
                        found.append(leaf)
        return found


def spread_points(rows: np.ndarray, tree: SplitTree, most: int) -> np.ndarray:
    """Split points far from each other: after the first, always the row farthest from those taken."""
    chosen = [0]
    gap = tree.between(rows, rows[:1])[:, 0]
    while len(chosen) < min(most, len(rows)):
        far = int(gap.argmax())
        if gap[far] <= tree.slack:
            break
        chosen.append(far)
        gap = np.minimum(gap, tree.between(rows, rows[far : far + 1])[:, 0])
    return rows[chosen]


def grow(sample: np.ndarray, top: int) -> SplitTree:
    """A tree over the sample's split points; ranges follow from all vectors."""
    tree = SplitTree([], top)
    tree.points = [spread_points(sample, tree, FAN)]
    node = tree.between(sample, tree.points[0]).argmin(axis=1)
    for n in range(len(tree.points[0])):
        tree.points.append(spread_points(sample[node == n], tree, FAN))
    return tree
