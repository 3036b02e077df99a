"""What two shapes have in common, by slabs between vertices and crossings. Small helpers for Arrow batches.

Shapes are lists of rings in any order and orientation; a point is inside where it lies within an odd
number of them, so concave rings, holes and several parts need nothing of their own.
"""

from __future__ import annotations

import numpy as np

Ring = list[tuple[float, float]]


def edges_of(rings: list[Ring]) -> np.ndarray:
    """(x1, y1, x2, y2) of all edges that are not upright, from left to right; rings may be closed or not."""
    out = [(*a, *b) if a[0] < b[0] else (*b, *a) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]]) if a[0] != b[0]]
    return np.array(out, float).reshape(-1, 4)


def crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x of all points where an edge of ``a`` crosses one of ``b``."""
    slope = lambda e: (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    sa, sb = slope(a)[:, None], slope(b)[None, :]
    ca, cb = (a[:, 1] - slope(a) * a[:, 0])[:, None], (b[:, 1] - slope(b) * b[:, 0])[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (cb - ca) / (sa - sb)
    low, high = np.maximum(a[:, 0][:, None], b[:, 0][None, :]), np.minimum(a[:, 2][:, None], b[:, 2][None, :])
    return x[np.isfinite(x) & (x > low) & (x < high)]


def spans(edges: np.ndarray, x: float) -> tuple[np.ndarray, np.ndarray]:
    """(heights at x, edges) of the edges over x, from below; each second gap between them is inside."""
    over = np.flatnonzero((edges[:, 0] < x) & (edges[:, 2] > x))
    e = edges[over]
    y = e[:, 1] + (x - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    order = np.argsort(y, kind="stable")
    return y[order], over[order]


def trapezoids(a: list[Ring], b: list[Ring]) -> list[tuple[float, float, float, float, float, float]]:
    """(x1, x2, low1, low2, high1, high2) of slabs that together are the common part of two shapes."""
    first, second = edges_of(a), edges_of(b)
    if not len(first) or not len(second):
        return []
    both = np.vstack([first, second])
    left, right = max(first[:, 0].min(), second[:, 0].min()), min(first[:, 2].max(), second[:, 2].max())
    xs = np.unique(np.concatenate([both[:, 0], both[:, 2], crossings(both, both)]))
    xs = xs[(xs >= left) & (xs <= right)]
    at = lambda e, x: e[1] + (x - e[0]) * (e[3] - e[1]) / (e[2] - e[0])
    out = []
    for x1, x2 in zip(xs[:-1].tolist(), xs[1:].tolist()):
        middle = (x1 + x2) / 2
        (ya, ea), (yb, eb) = spans(first, middle), spans(second, middle)
        for i in range(0, len(ya) - 1, 2):
            for j in range(0, len(yb) - 1, 2):
                low = first[ea[i]] if ya[i] >= yb[j] else second[eb[j]]
                high = first[ea[i + 1]] if ya[i + 1] <= yb[j + 1] else second[eb[j + 1]]
                if max(ya[i], yb[j]) < min(ya[i + 1], yb[j + 1]):
                    out.append((x1, x2, at(low, x1), at(low, x2), at(high, x1), at(high, x2)))
    return out


def common_area(a: list[Ring], b: list[Ring]) -> float:
    return float(sum((x2 - x1) * (h1 - l1 + h2 - l2) / 2 for x1, x2, l1, l2, h1, h2 in trapezoids(a, b)))
