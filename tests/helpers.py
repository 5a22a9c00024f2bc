"""Small surfaces and plain single-machine answers to test against."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd


def surface(spark, z: np.ndarray, survey: str = "s", drop=None):
    rows, cols = np.indices(z.shape)
    pdf = pd.DataFrame({"survey_id": survey, "row": rows.ravel(), "col": cols.ravel(), "z": z.ravel().astype(float)})
    if drop is not None:
        pdf = pdf[~drop[pdf["row"], pdf["col"]]]
    return spark.createDataFrame(pdf)


def grid(df, col: str, shape) -> np.ndarray:
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", col).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out


def flood_labels(mask: np.ndarray) -> dict:
    """Smallest cell of each 4-connected region, by flood fill."""
    seen, out = np.zeros_like(mask, bool), {}
    for i, j in zip(*np.nonzero(mask)):
        if seen[i, j]:
            continue
        todo, members = [(i, j)], []
        seen[i, j] = True
        while todo:
            a, b = todo.pop()
            members.append((a, b))
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    todo.append((c, d))
        low = min(members)
        for m in members:
            out[m] = low[0] * 4294967296 + low[1]
    return out


def filled(z: np.ndarray) -> np.ndarray:
    """Lowest draining level of every cell of a complete grid, 8 neighbours, edge cells drain."""
    h, w = z.shape
    level = np.full(z.shape, np.inf)
    heap = [(z[i, j], i, j) for i in range(h) for j in range(w) if i in (0, h - 1) or j in (0, w - 1)]
    for v, i, j in heap:
        level[i, j] = v
    heapq.heapify(heap)
    while heap:
        v, i, j = heapq.heappop(heap)
        if v > level[i, j]:
            continue
        for a in range(max(i - 1, 0), min(i + 2, h)):
            for b in range(max(j - 1, 0), min(j + 2, w)):
                n = max(v, z[a, b])
                if n < level[a, b]:
                    level[a, b] = n
                    heapq.heappush(heap, (n, a, b))
    return level
