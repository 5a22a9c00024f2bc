"""Depression filling over a whole survey: every cell rises to the lowest level at which it can drain (8 neighbours).

Ground next to a missing cell drains out. A cell drains along lower cells to a pit, so its level is the larger of its own
height and its pit's level, and only pits and block rims need a graph. Each block finds its pits and the lowest passes
between their basins with whole-array steps, and is reduced to the spill levels between the cells of its rim (a minimum
spanning forest, at most one edge per rim cell). The rim graph of all blocks is solved for the lowest barrier to the
outside, and each block's pits then take their levels from its rim. Block tasks are bounded by the block; a survey's rim
graph is contracted by joins and aggregations until it is small enough for one bounded task, surveys beside each other.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscan.operators.blocks import BLOCK, BLOCK_KEYS, pack, tiled
from fellscan.operators.components import FINISH_EDGES
from fellscan.session import cut_lineage

OUTSIDE = -1
AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def _grid(pdf: pd.DataFrame, block: int) -> tuple[np.ndarray, int, int]:
    """Elevations of the block padded by one cell (NaN where absent), and the lattice position of its corner."""
    r0, c0 = int(pdf["_br"].iloc[0]) * block - 1, int(pdf["_bc"].iloc[0]) * block - 1
    z = np.full((block + 2, block + 2), np.nan)
    z[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = pdf["z"].to_numpy(float)
    return z, r0, c0


def _outlets(z: np.ndarray) -> np.ndarray:
    """Cells with a missing neighbour, over the unpadded block."""
    gone, n = np.isnan(z), z.shape[0] - 2
    out = np.zeros((n, n), bool)
    for dr, dc in AROUND:
        out |= gone[1 + dr:1 + dr + n, 1 + dc:1 + dc + n]
    return out


def _basins(z: np.ndarray) -> tuple[np.ndarray, int, pd.DataFrame]:
    """Basin of each unpadded cell (-1 where absent), their number, and the lowest pass ``(u, v, w)`` of basins that touch."""
    inner = np.zeros_like(z, bool)
    inner[1:-1, 1:-1] = np.isfinite(z[1:-1, 1:-1])
    cells = np.flatnonzero(inner)
    cells = cells[np.argsort(z.ravel()[cells], kind="stable")]
    rank = np.full(z.size, len(cells))
    rank[cells] = np.arange(len(cells))  # a strict order, so that flats drain too
    rank = rank.reshape(z.shape)
    lowest, n = rank[1:-1, 1:-1].copy(), z.shape[0] - 2
    for dr, dc in AROUND:
        np.minimum(lowest, rank[1 + dr:1 + dr + n, 1 + dc:1 + dc + n], out=lowest)
    down = np.empty(len(cells), np.int64)
    here = rank[1:-1, 1:-1]
    down[here[here < len(cells)]] = lowest[here < len(cells)]
    while not np.array_equal(further := down[down], down):
        down = further
    pits, basin_of = np.unique(down, return_inverse=True)
    basin = np.full(z.size, -1)
    basin[cells] = basin_of
    basin = basin.reshape(z.shape)
    parts = []
    for dr, dc in [(0, 1), (1, -1), (1, 0), (1, 1)]:
        there = (slice(1 + dr, 1 + dr + n), slice(1 + dc, 1 + dc + n))
        u, v, w = basin[1:-1, 1:-1], basin[there], np.maximum(z[1:-1, 1:-1], z[there])
        touch = (u >= 0) & (v >= 0) & (u != v)
        parts.append(np.stack([np.minimum(u, v)[touch], np.maximum(u, v)[touch], w[touch]]))
    u, v, w = np.concatenate(parts, axis=1)
    order = np.lexsort((w, v, u))
    u, v, w = u[order].astype(np.int64), v[order].astype(np.int64), w[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return basin, len(pits), pd.DataFrame({"u": u[first], "v": v[first], "w": w[first]})


def _spill_edges(block: int):
    width = block + 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, r0, c0 = _grid(pdf, block)
        basin, n, passes = _basins(z)
        rim = np.zeros_like(z, bool)
        rim[[1, -2], :], rim[:, [1, -2]] = True, True
        rim &= basin >= 0
        drain = np.zeros_like(rim)
        drain[1:-1, 1:-1] = _outlets(z)
        drain &= basin >= 0
        ident = (np.arange(width)[:, None] + r0) * 4294967296 + np.arange(width)[None, :] + c0
        # vertices: basins, then rim cells, then the outside; the latter two are what the edges are wanted between
        n_rim = int(rim.sum())
        graph = pd.concat([
            passes,
            pd.DataFrame({"u": basin[rim], "v": n + np.arange(n_rim), "w": z[rim]}),
            pd.DataFrame({"u": basin[drain], "w": z[drain]}).groupby("u", as_index=False)["w"].min().assign(v=n + n_rim),
        ]).sort_values("w", kind="stable")
        rep: list[int | None] = [None] * n + ident[rim].tolist() + [OUTSIDE]
        parent = list(range(len(rep)))
        edges: list[tuple[int, int, float]] = []
        for a, b, level in zip(graph["u"].tolist(), graph["v"].tolist(), graph["w"].tolist()):
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            while parent[b] != b:
                parent[b] = parent[parent[b]]
                b = parent[b]
            if a != b:
                if rep[a] is not None and rep[b] is not None:
                    edges.append((rep[a], rep[b], level))
                parent[b] = a
                rep[a] = rep[b] if rep[a] is None else rep[a]
        for dr, dc in AROUND:  # contacts with neighbouring blocks, stated once by the lower cell
            rows, cols = np.nonzero(rim)
            nr, nc = rows + dr, cols + dc
            other = ((nr == 0) | (nr == width - 1) | (nc == 0) | (nc == width - 1)) & np.isfinite(z[nr, nc])
            u, v = (rows[other] + r0) * 4294967296 + cols[other] + c0, (nr[other] + r0) * 4294967296 + nc[other] + c0
            w = np.maximum(z[rows[other], cols[other]], z[nr[other], nc[other]])
            edges += [e for e in zip(u.tolist(), v.tolist(), w.tolist()) if e[0] < e[1]]
        out = pd.DataFrame(edges, columns=["u", "v", "w"])
        out.insert(0, "scope", pdf["survey_id"].iloc[0])
        return out

    return run


def _reach(edges: pd.DataFrame, heap: list[tuple[float, int]]) -> dict[int, float]:
    """Lowest barrier from the starting (level, vertex) pairs to every vertex of a bounded graph."""
    near: dict[int, list[tuple[float, int]]] = {}
    for u, v, w in zip(edges["u"].tolist(), edges["v"].tolist(), edges["w"].tolist()):
        near.setdefault(u, []).append((w, v))
        near.setdefault(v, []).append((w, u))
    done: dict[int, float] = {}
    heapq.heapify(heap)
    while heap:
        level, node = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = level
        for w, other in near.get(node, ()):
            if other not in done:
                heapq.heappush(heap, (max(level, w), other))
    return done


def _solve(edges: pd.DataFrame) -> pd.DataFrame:
    """Lowest barrier to the outside for every vertex of one scope."""
    done = _reach(edges, [(float("-inf"), OUTSIDE)])
    done.pop(OUTSIDE, None)
    return pd.DataFrame({"scope": edges["scope"].iloc[0], "id": list(done), "level": list(done.values())})


def spill_levels(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """``(scope, id, level)``: for each vertex the smallest possible maximum edge weight on a path to ``OUTSIDE``.

    Each round, every vertex that drew tails and whose cheapest edge leads to a vertex that drew heads (or outside) is
    merged into it. A merged vertex's level is the larger of that edge and its new home's level, so unwinding the
    rounds backwards gives exact levels. Rounds end when no scope holds more than ``finish_edges`` edges.
    """
    scope_type = edges.schema["scope"].dataType.simpleString()

    def tidy(df: DataFrame) -> DataFrame:
        lean = df.where("u <> v").select("scope", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
        return cut_lineage(lean.groupBy("scope", "u", "v").agg(F.min("w").alias("w")))

    current, rounds = tidy(edges), []
    while not current.groupBy("scope").count().where(F.col("count") > finish_edges).isEmpty():
        both = current.union(current.select("scope", F.col("v").alias("u"), F.col("u").alias("v"), "w")).where(F.col("u") != OUTSIDE)
        order = F.struct("w", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), F.col("v").alias("to"))
        pick = both.groupBy("scope", F.col("u").alias("id")).agg(F.min(order).alias("m"))
        coin = lambda c: F.pmod(F.xxhash64(F.lit(len(rounds)), F.col(c)), F.lit(2)) == 1
        chosen = pick.select("scope", "id", F.col("m.to").alias("to"), F.col("m.w").alias("w"))
        hooks = cut_lineage(chosen.where(~coin("id") & (coin("to") | (F.col("to") == OUTSIDE)) | (F.col("to") == OUTSIDE)))
        rounds.append(hooks)
        hu = hooks.select("scope", F.col("id").alias("u"), F.col("to").alias("tu"))
        hv = hooks.select("scope", F.col("id").alias("v"), F.col("to").alias("tv"))
        moved = current.join(hu, ["scope", "u"], "left").join(hv, ["scope", "v"], "left")
        current = tidy(moved.select("scope", F.coalesce("tu", "u").alias("u"), F.coalesce("tv", "v").alias("v"), "w"))
    levels = current.groupBy("scope").applyInPandas(_solve, f"scope {scope_type}, id bigint, level double")
    for hooks in reversed(rounds):
        home = levels.select("scope", F.col("id").alias("to"), "level")
        merged = hooks.join(home, ["scope", "to"], "left").select("scope", "id", F.greatest("w", F.coalesce("level", "w")).alias("level"))
        levels = levels.unionByName(merged)
    return cut_lineage(levels) if rounds else levels


def _flood(block: int, keep: list[str]):
    width = block + 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, r0, c0 = _grid(pdf, block)
        own = pdf[pdf["_own"].to_numpy()]
        base = own[["survey_id", "row", "col", "z", *keep]].reset_index(drop=True)
        at = (own["row"].to_numpy() - r0) * width + own["col"].to_numpy() - c0
        basin, n, passes = _basins(z)
        drain = np.zeros_like(z, bool)
        drain[1:-1, 1:-1] = _outlets(z)
        drain &= basin >= 0
        known = own["level"].notna().to_numpy() & (basin.ravel()[at] >= 0)
        starts = np.concatenate([z[drain], own["level"].to_numpy(float)[known]]), np.concatenate([basin[drain], basin.ravel()[at[known]]])
        lowest = pd.Series(starts[0]).groupby(starts[1]).min()
        done = _reach(passes, list(zip(lowest.tolist(), lowest.index.tolist())))
        levels = np.full(n + 1, np.nan)  # the last one for absent cells
        levels[list(done)] = list(done.values())
        return base.assign(filled=np.maximum(z.ravel()[at], levels[basin.ravel()[at]]))

    return run


def fill_depressions(s: DataFrame, block: int = BLOCK, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """Surface plus ``filled``."""
    keep = [c for c in s.columns if c not in ("survey_id", "row", "col", "z")]
    types = {f.name: f.dataType.simpleString() for f in s.schema}
    edges = (
        tiled(s.select("survey_id", "row", "col", "z"), 1, block, exchange=False).groupBy(*BLOCK_KEYS)
        .applyInPandas(_spill_edges(block), f"scope {types['survey_id']}, u bigint, v bigint, w double")
    )
    levels = spill_levels(edges, finish_edges).select(F.col("scope").alias("survey_id"), F.col("id").alias("_cell"), "level")
    blocks = tiled(s, 1, block, exchange=False).withColumn("_cell", pack()).join(levels, ["survey_id", "_cell"], "left")
    schema = ", ".join(f"{k} {types[k]}" for k in ("survey_id", "row", "col", "z", *keep)) + ", filled double"
    return blocks.drop("_cell").groupBy(*BLOCK_KEYS).applyInPandas(_flood(block, keep), schema)


def fill_difference(s: DataFrame, block: int = BLOCK) -> DataFrame:
    return fill_depressions(s, block).withColumn("fill_diff", F.col("filled") - F.col("z"))
