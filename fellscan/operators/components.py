"""Connected components over edge tables, and region labelling of cell masks in two levels.

Graph tables are ``(scope, u, v)``: edges never leave their scope (a survey, a tile, or one constant). Contraction
follows the published randomised scheme for databases: every vertex hooks to the neighbour with the smallest hash,
edges are rewritten to the hooks and deduplicated, and the vertex count falls geometrically.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellscan.operators.blocks import BLOCK, block_of, pack
from fellscan.session import cut_lineage, hold

FINISH_EDGES = 1_000_000  # a graph of at most this many edges (24 MB) is finished in one task; larger ones contract first
HOMES = 500_000  # squares whose clusters are broadcast (24 MB); more are joined by a shuffle


def min_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member index of each vertex's component (vectorised hooking and pointer jumping)."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_edges = low != high
        if not open_edges.any():
            return parent
        np.minimum.at(parent, high[open_edges], low[open_edges])
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = list(batches)
    if not frames:
        return
    edges = pd.concat(frames, ignore_index=True)
    vertices = pd.concat([edges[["scope", "u"]].rename(columns={"u": "id"}), edges[["scope", "v"]].rename(columns={"v": "id"})])
    vertices = vertices.drop_duplicates().sort_values(["scope", "id"], ignore_index=True)
    index = pd.MultiIndex.from_frame(vertices)
    u = index.get_indexer(pd.MultiIndex.from_frame(edges[["scope", "u"]]))
    v = index.get_indexer(pd.MultiIndex.from_frame(edges[["scope", "v"]]))
    vertices["root"] = vertices["id"].to_numpy()[min_labels(len(vertices), u, v)]
    yield vertices


def connected_components(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """``(scope, id, root)`` for every vertex that has an edge; ``root`` is the component's smallest id."""
    id_type = edges.schema["u"].dataType.simpleString()
    scope_type = edges.schema["scope"].dataType.simpleString()
    current = cut_lineage(
        edges.where("u <> v").select("scope", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )
    hooks: list[DataFrame] = []
    first_vertices = None
    while True:
        n = current.count()
        if n <= finish_edges:
            last = current.coalesce(1).mapInPandas(_finish, f"scope {scope_type}, id {id_type}, root {id_type}")
            break
        both = current.union(current.select("scope", F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.xxhash64(F.lit(len(hooks)), F.col(c))
        near = both.groupBy("scope", F.col("u").alias("id")).agg(F.min(F.struct(rank("v").alias("h"), F.col("v").alias("id"))).alias("m"))
        own = F.struct(rank("id").alias("h"), F.col("id").alias("id"))
        hook = cut_lineage(near.select("scope", "id", F.least("m", own)["id"].alias("root")))
        hooks.append(hook)
        if first_vertices is None:
            first_vertices = hook.select("scope", "id")
        to_u = hook.select("scope", F.col("id").alias("u"), F.col("root").alias("ru"))
        to_v = hook.select("scope", F.col("id").alias("v"), F.col("root").alias("rv"))
        current = cut_lineage(
            current.join(to_u, ["scope", "u"]).join(to_v, ["scope", "v"]).where("ru <> rv")
            .select("scope", F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        )
    if not hooks:
        return last
    # Compose from the smallest graph outwards; a root may serve many vertices, which AQE's skew join splits.
    for hook in reversed(hooks):
        nxt = last.select("scope", F.col("id").alias("root"), F.col("root").alias("far"))
        last = hook.join(nxt, ["scope", "root"], "left").select("scope", "id", F.coalesce("far", "root").alias("root"))
    last = cut_lineage(last)
    smallest = last.groupBy("scope", "root").agg(F.min("id").alias("low"))
    return last.join(smallest, ["scope", "root"]).select("scope", "id", F.col("low").alias("root"))


# ---- masks ---------------------------------------------------------------------------------------------------------

def label_grid(present: np.ndarray, eight: bool = False) -> np.ndarray:
    """Component label per true pixel (0 outside), labels ordered by first pixel in row-major order."""
    start = present.copy()
    start[:, 1:] &= ~present[:, :-1]
    run = np.cumsum(start.ravel()).reshape(present.shape)
    pairs = []
    shifts = [(slice(None), slice(None))] if not eight else [
        (slice(None), slice(None)), (slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))
    ]
    for upper, lower in shifts:
        a, b = present[:-1, upper], present[1:, lower]
        both = a & b
        pairs.append(np.stack([run[:-1, upper][both], run[1:, lower][both]], axis=1))
    joined = np.unique(np.concatenate(pairs), axis=0) - 1 if pairs else np.empty((0, 2), int)
    n = int(run[-1, -1]) if run.size else 0
    labels = min_labels(n, joined[:, 0], joined[:, 1]) + 1 if n else np.empty(0, int)
    return np.where(present, labels[np.maximum(run - 1, 0)] if n else 0, 0)


def _label_block(keep: list[str], eight: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r0, c0 = rows.min(), cols.min()
        grid = np.zeros((rows.max() - r0 + 1, cols.max() - c0 + 1), bool)
        grid[rows - r0, cols - c0] = True
        labels = label_grid(grid, eight)[rows - r0, cols - c0]
        packed = rows.astype("int64") * 4294967296 + cols.astype("int64")
        return pdf[keep].assign(part=pd.Series(packed, index=pdf.index).groupby(labels).transform("min"))

    return run


def label(mask: DataFrame, block: int = BLOCK, eight: bool = False, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """Add ``region_id`` (the region's smallest packed cell) to a mask; 4-connected unless ``eight``.

    Blocks are labelled on their own, only seam contacts become graph edges, and block labels are mapped to regions
    by one join whose key repeats at most block**2 times. Other columns ride along.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mask.schema) + ", part bigint"
    parts = (
        mask.withColumn("_br", block_of("row", block)).withColumn("_bc", block_of("col", block))
        .groupBy("survey_id", "_br", "_bc").applyInPandas(_label_block(mask.columns, eight), schema)
    )
    return join_parts(parts, block, eight, finish_edges=finish_edges)


def join_parts(parts: DataFrame, block: int, eight: bool = False, same: list[str] | None = None, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """Regions from per-block labels ``part``: labels meeting across a block seam (and alike in ``same``) become one ``region_id``."""
    same = same or []
    parts = hold(parts)
    r, c = F.col("row"), F.col("col")
    down, right = F.pmod(r + 1, F.lit(block)) == 0, F.pmod(c + 1, F.lit(block)) == 0
    steps = [(1, 0, down), (0, 1, right)]
    if eight:
        steps += [(1, 1, down | right), (1, -1, down | (F.pmod(c, F.lit(block)) == 0))]
    contact = F.filter(
        F.array(*[F.when(cond, F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"))) for dr, dc, cond in steps]), lambda x: x.isNotNull()
    )
    seam = (F.pmod(r, F.lit(block)) == 0) | (F.pmod(c, F.lit(block)) == 0)
    if eight:
        seam = seam | right
    asking = parts.withColumn("_s", F.explode(contact)).select(
        "survey_id", (r + F.col("_s.dr")).alias("row"), (c + F.col("_s.dc")).alias("col"), F.col("part").alias("u"), *same
    )
    edges = (
        asking.join(parts.where(seam).select("survey_id", "row", "col", F.col("part").alias("v"), *same), ["survey_id", "row", "col", *same])
        .select(F.col("survey_id").alias("scope"), "u", "v")
    )
    roots = connected_components(edges, finish_edges).select(F.col("scope").alias("survey_id"), F.col("id").alias("part"), "root")
    keep = [x for x in parts.columns if x != "part"]
    return parts.join(roots, ["survey_id", "part"], "left").select(*keep, F.coalesce("root", "part").alias("region_id"))


def drop_small(labelled: DataFrame, min_cells: int) -> DataFrame:
    """Keep regions of at least ``min_cells``; sizes are pre-aggregated, then joined back."""
    sizes = labelled.groupBy("survey_id", "region_id").agg(F.count("*").alias("cells")).where(F.col("cells") >= min_cells)
    return labelled.join(sizes, ["survey_id", "region_id"])


# ---- points --------------------------------------------------------------------------------------------------------

def _spread(side: float, reach: int):
    """Lattice offsets (dx, dy), each unordered pair once, whose cells can hold points within the radius."""
    steps = [(dx, dy) for dx in range(0, reach + 1) for dy in range(-reach, reach + 1) if (dx, dy) > (0, 0)]
    return F.array(*[F.struct(F.lit(a).cast("bigint").alias("dx"), F.lit(b).cast("bigint").alias("dy")) for a, b in steps])


def _extent(points: DataFrame, *keys: str, more: list[Column] | None = None) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), *(more or [])
    )


def eps_clusters(df: DataFrame, eps: float, x: str = "x", y: str = "y", id_col: str = "id", scope: str | None = None,
                 brute: int = 4096, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """Add ``cluster_id`` = smallest id among points chained by steps of at most ``eps`` (density clustering, minimum 1).

    Points in one square of side eps/sqrt(2) are always together, so squares are the graph's vertices. Two squares are
    joined or rejected by the extents of their points, or joined where the outermost points of one are near those of the
    other. Pairs still undecided matter only between squares that nothing has joined so far: those with few points are
    compared directly and the rest are quartered per side and looked at again. No square ever emits all its pairs, however
    full, and rows get their cluster by their square.
    """
    scope_col = F.col(scope).cast("string") if scope else F.lit("all")
    side0 = eps / 2**0.5 * (1 - 1e-9)
    square = lambda c: F.floor(F.col(c) / side0).cast("bigint")
    packed = lambda x, y: (square(x) + 1073741824) * 4294967296 + (square(y) + 1073741824)
    tagged = df.withColumns({"_scope": scope_col, "_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    spots = cut_lineage(
        tagged.select(F.col("_scope").alias("scope"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col(id_col).alias("id"))
        .groupBy("scope", "x", "y").agg(F.min("id").alias("id"))
        .withColumns({"cx": square("x"), "cy": square("y"), "cell": packed("x", "y")})
    )
    outer = [F.min_by("y", "x").alias("yw"), F.max_by("y", "x").alias("ye"), F.min_by("x", "y").alias("xs"), F.max_by("x", "y").alias("xn")]
    squares = cut_lineage(_extent(spots, "scope", "cx", "cy", "cell", more=[*outer, F.min("id").alias("low")]))
    seen = F.struct("cell", "n", "x0", "x1", "y0", "y1", "yw", "ye", "xs", "xn")
    right = squares.select("scope", "cx", "cy", seen.alias("b"))
    pairs = (
        squares.select("scope", "cx", "cy", seen.alias("a"))
        .withColumn("o", F.explode(_spread(side0, 2)))
        .select("scope", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), "a")
        .join(right, ["scope", "cx", "cy"])
        .select("scope", F.col("a.cell").alias("u"), F.col("b.cell").alias("v"), "a", "b")
    )
    gap = lambda lo, hi: F.greatest(F.col(f"a.{lo}") - F.col(f"b.{hi}"), F.col(f"b.{lo}") - F.col(f"a.{hi}"), F.lit(0.0))
    far = lambda lo, hi: F.greatest(F.col(f"a.{hi}") - F.col(f"b.{lo}"), F.col(f"b.{hi}") - F.col(f"a.{lo}"))
    rim = [("x0", "yw"), ("x1", "ye"), ("xs", "y0"), ("xn", "y1")]
    apart = lambda p, q: F.sqrt((F.col(f"a.{p[0]}") - F.col(f"b.{q[0]}")) ** 2 + (F.col(f"a.{p[1]}") - F.col(f"b.{q[1]}")) ** 2)
    nearest = F.least(*[apart(p, q) for p in rim for q in rim])
    edges, joined = [], None
    side = side0
    members = spots.withColumn("sub", F.col("cell"))
    while True:
        near, wide = F.hypot(gap("x0", "x1"), gap("y0", "y1")), F.hypot(far("x0", "x1"), far("y0", "y1"))
        sure = (wide <= eps * (1 - 1e-9)) | ((nearest <= eps) if joined is None else F.lit(False))
        judged = cut_lineage(
            pairs.where(near <= eps * (1 + 1e-9))
            .select("scope", "u", "v", F.col("a.cell").alias("sa"), F.col("a.n").alias("na"), F.col("b.cell").alias("sb"), F.col("b.n").alias("nb"), sure.alias("sure")))
        open_pairs = judged.where("NOT sure").drop("sure")
        if joined is None:  # u and v are the groups of squares joined so far from here on
            joined = cut_lineage(connected_components(judged.where("sure").select("scope", "u", "v"), finish_edges))
            for end in ("u", "v"):
                group = joined.select("scope", F.col("id").alias(end), "root")
                open_pairs = open_pairs.join(group, ["scope", end], "left").withColumn(end, F.coalesce("root", end)).drop("root")
            open_pairs = open_pairs.where("u <> v")
        else:
            settled = judged.where("sure").select("scope", "u", "v")
            edges.append(settled)
            open_pairs = open_pairs.join(settled.distinct(), ["scope", "u", "v"], "left_anti")
        open_pairs = cut_lineage(open_pairs)
        if open_pairs.isEmpty():
            break
        size = F.col("na") * F.col("nb")
        small = open_pairs.where(size <= brute)
        pa = members.select("scope", F.col("sub").alias("sa"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        pb = members.select("scope", F.col("sub").alias("sb"), F.col("x").alias("bx"), F.col("y").alias("by"))
        edges.append(
            small.select("scope", "u", "v", "sa", "sb").join(pa, ["scope", "sa"]).join(pb, ["scope", "sb"])
            .where(F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2) <= eps)
            .select("scope", "u", "v").distinct()
        )
        large = open_pairs.where(size > brute)
        if large.isEmpty():
            break
        side = side / 4
        busy = large.select("scope", F.col("sa").alias("sub")).union(large.select("scope", F.col("sb").alias("sub"))).distinct()
        finer = members.join(busy, ["scope", "sub"], "left_semi").withColumn("parent", F.col("sub")).withColumn(
            "sub", F.xxhash64("parent", F.floor(F.col("x") / side), F.floor(F.col("y") / side))
        )
        members = cut_lineage(finer)
        # The key is (parent, fine square); a hash clash inside one parent only merges extents, which stays exact.
        kids = _extent(members, "scope", "parent", "sub").select("scope", "parent", F.struct(F.col("sub").alias("cell"), "n", "x0", "x1", "y0", "y1").alias("k"))
        pairs = (
            large.select("scope", "u", "v", F.col("sa").alias("pa"), F.col("sb").alias("pb"))
            .join(kids.select("scope", F.col("parent").alias("pa"), F.col("k").alias("a")), ["scope", "pa"])
            .join(kids.select("scope", F.col("parent").alias("pb"), F.col("k").alias("b")), ["scope", "pb"])
            .select("scope", "u", "v", "a", "b")
        )
    homes = squares.select("scope", "cell", "low").join(joined.select("scope", F.col("id").alias("cell"), "root"), ["scope", "cell"], "left").withColumn("root", F.coalesce("root", "cell"))
    if edges:
        graph = edges[0]
        for e in edges[1:]:
            graph = graph.unionByName(e)
        later = connected_components(graph, finish_edges).select("scope", F.col("id").alias("root"), F.col("root").alias("far"))
        homes = homes.join(later, ["scope", "root"], "left").withColumn("root", F.coalesce("far", "root")).drop("far")
    named = homes.groupBy("scope", "root").agg(F.min("low").alias("cluster_id"))
    homes = cut_lineage(homes.join(named, ["scope", "root"]).select(F.col("scope").alias("_scope"), F.col("cell").alias("_cell"), "cluster_id"))
    placed = tagged.withColumn("_cell", packed("_x", "_y"))
    return placed.join(F.broadcast(homes) if homes.count() <= HOMES else homes, ["_scope", "_cell"]).drop("_scope", "_x", "_y", "_cell")
