"""Masks of pictures as runs of pixels, filled shapes as runs, and what they share. Small helpers for Arrow batches."""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: a mask's byte counts from here on.
SET = 128

Points = list[tuple[float, float]]


def decoded(mask: str | None, width: int | None, height: int | None) -> np.ndarray | None:
    """The bytes of a mask in base64; None if they are not one for each pixel."""
    if not mask or not width or not height or width < 0 or height < 0:
        return None
    try:
        data = base64.b64decode(mask)
    except (binascii.Error, ValueError):
        return None
    return np.frombuffer(data, np.uint8) if len(data) == width * height else None


def runs_of(flags: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of set pixels, rows one after another."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def filled(shape: Points, width: int, height: int) -> np.ndarray:
    """(start, end) of the pixels whose centres lie in a shape, points as shares of width and height: two crossings at a time along each row."""
    out = []
    ring = list(zip(shape, [*shape[1:], *shape[:1]]))
    for row in range(height):
        y = (row + 0.5) / height
        xs = sorted((bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in ring if (ay > y) != (by > y))
        for a, b in zip(xs[::2], xs[1::2]):
            # A centre is inside from the first crossing on and before the second.
            first, last = (min(width, max(0, int(np.ceil(x * width - 0.5)))) for x in (a, b))
            if first < last:
                out.append((row * width + first, row * width + last))
    return np.array(out, np.int64).reshape(-1, 2)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Pixels that stand in both lists of sorted runs: the lists are merged, and what is covered twice counts."""
    at = np.concatenate([a.ravel(), b.ravel()])
    step = np.concatenate([np.tile([1, -1], len(a)), np.tile([1, -1], len(b))])
    order = np.argsort(at, kind="stable")
    covered = np.cumsum(step[order])[:-1]
    return int(np.diff(at[order])[covered == 2].sum())


def area(shape: Points) -> float:
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(shape, [*shape[1:], *shape[:1]]))) / 2


def overlap(mask: np.ndarray, width: int, height: int, shape: Points) -> float:
    """What a mask and a shape share, over the mask's pixels and what the shape's area has besides."""
    own = runs_of(mask >= SET)
    total = int((own[:, 1] - own[:, 0]).sum())
    if not total or len(shape) < 3:
        return 0.0
    hit = shared(own, filled(shape, width, height))
    union = total + max(0.0, area(shape) * width * height - hit)
    return hit / union


def box_overlap(a: Points, b: Points) -> float:
    """Intersection over union of the boxes around two shapes."""
    (ax, ay), (bx, by) = zip(*a), zip(*b)
    wide = min(max(ax), max(bx)) - max(min(ax), min(bx))
    high = min(max(ay), max(by)) - max(min(ay), min(by))
    if wide <= 0 or high <= 0:
        return 0.0
    sizes = sum((max(x) - min(x)) * (max(y) - min(y)) for x, y in ((ax, ay), (bx, by)))
    return wide * high / (sizes - wide * high)


def mask_overlaps(rows: DataFrame, key: str) -> DataFrame:
    """(key, pixels, hits, overlap) of each row's mask (mask in base64, width, height) and shape (x, y as shares).

    A mask that is missing, not base64 or not one byte a pixel has null pixels and hits and overlaps with nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for mask, width, height, points in zip(*(batch.column(c).to_pylist() for c in ("mask", "width", "height", "shape"))):
                data, shape = decoded(mask, width, height), [(p["x"], p["y"]) for p in points or []]
                own = None if data is None else runs_of(data >= SET)
                out[0].append(None if own is None else int((own[:, 1] - own[:, 0]).sum()))
                out[1].append(None if own is None else shared(own, filled(shape, width, height)))
                out[2].append(0.0 if data is None else overlap(data, width, height, shape))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=[key, "pixels", "hits", "overlap"])

    return rows.select(key, "mask", "width", "height", "shape").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, pixels long, hits long, overlap double")
