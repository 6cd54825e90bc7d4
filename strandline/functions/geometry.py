"""Map rings as arrays: delta decoding, stitching, clipping to a box and thinning, in numpy over Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def decoded(deltas: np.ndarray, scale: tuple[float, float], origin: tuple[float, float]) -> np.ndarray:
    """Coordinates of an arc from its quantized steps."""
    return np.cumsum(np.asarray(deltas, float).reshape(-1, 2), axis=0) * scale + origin


def stitched(refs: list[int], arcs: list[np.ndarray]) -> np.ndarray:
    """One ring from arc numbers; ``~i`` takes arc i backwards, joints stand once."""
    parts = [arcs[i] if i >= 0 else arcs[~i][::-1] for i in refs]
    return np.concatenate([parts[0], *(p[1:] for p in parts[1:])]) if parts else np.zeros((0, 2))


def clipped(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of a ring inside (west, south, east, north): one half-plane after another."""
    ring = np.asarray(ring, float).reshape(-1, 2)
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        if not len(ring):
            return ring
        before = np.roll(ring, 1, axis=0)
        deep, deep_before = sign * (ring[:, axis] - bound), sign * (before[:, axis] - bound)
        enters = (deep >= 0) != (deep_before >= 0)
        share = np.divide(deep_before, deep_before - deep, out=np.zeros(len(ring)), where=enters)
        cross = before + share[:, None] * (ring - before)
        cross[:, axis] = bound
        # At most a crossing and the point itself come from each step along the ring.
        both = np.stack([cross, ring], 1).reshape(-1, 2)
        ring = both[np.stack([enters, deep >= 0], 1).reshape(-1)]
    return ring


def thinned(ring: np.ndarray, step: float = 0.1) -> np.ndarray:
    """The ring with points at least ``step`` apart from the one kept before, two places; empty under four points."""
    kept: list[np.ndarray] = []
    for p in np.asarray(ring, float).reshape(-1, 2):
        if not kept or np.abs(p - kept[-1]).sum() >= step:
            kept.append(np.round(p, 2))
    return np.array(kept) if len(kept) >= 4 else np.zeros((0, 2))


def ring_in_box(ring: Column, box: tuple[float, float, float, float], step: float = 0.1) -> Column:
    """An array of [lon, lat] clipped and thinned; null stays null."""
    run = lambda s: s.map(lambda r: None if r is None else [list(map(float, p)) for p in thinned(clipped(np.array([list(p) for p in r]), box), step)])
    return F.pandas_udf(lambda s: pd.Series(run(s), dtype=object), ArrayType(ArrayType(DoubleType())))(ring)
