"""Hard negatives by maximum inner product, over cover trees of norm-augmented vectors.

Each vector x gets one more component, sqrt(M - |x|^2) with M the largest squared norm, and a query gets 0 there, so all
candidates lie on one sphere and inner products hang on distances alone: a ball of radius r around c holds products
between q.c - |q| r and q.c + |q| r.

Rows are dealt to pivots, a farthest-first net over a sample of SAMPLE_ROWS rows (the top of the tree; every row goes to
its nearest pivot). The rows of a pivot are shared out to blocks of up to BLOCK_ROWS rows, and each block gets a cover
tree: a node of covering radius 2^i has children that lie more than 2^(i-1) apart and cover its rows within 2^(i-1), its
own centre being one of them; each keeps the true radius over its rows. A search goes down best first, by the largest
product a node may hold, with a window of products for each (anchor, positive): a node outside all windows, or below the
k-th best found in each, is skipped; rows of leaves are verified with exact integer products. An anchor first searches
the blocks of its own pivot, and then those pivots whose ball still meets a window above what was found.

Results do not depend on the sample, pivots or blocks, only the work does. One shuffle deals rows to blocks, in equal
shares by hash, so neither a label nor a group of equal vectors fills a task, and equal vectors are one leaf of radius 0.
A search sends anchors to the blocks they need and streams them past one block's tree at a time. Where products tell
little (random directions in many dimensions) most nodes have to be visited: the work is then anchors x rows, in blocks.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Shorter vectors count as filled
with zeros. Equal rows count once; rows that share an id but differ all take part, and an anchor's own id is never its
positive or negative (of anchors of one id, that of the smallest label and vector is asked). Equal products come by smaller id. Empty tables give an empty result; other columns are not read.
Products need to fit 62 bits, which is checked.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fellscan.llm.common import landed

#: Work only: rows the pivots are chosen from, most pivots, rows of a block and of a leaf, anchors of one descent.
SAMPLE_ROWS, MAX_PIVOTS, BLOCK_ROWS, LEAF_ROWS, AT_ONCE = 20_000, 1024, 8192, 8, 256
SCALE, N_POSITIVES, N_NEGATIVES = 256, 5, 5
_EXACT, _SLACK = float(1 << 52), 1e-6
FOUND = "anchor_id bigint, w int, id bigint, score bigint"


def usable(rows: DataFrame, vec_id: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, label, x (integers) of the rows that take part."""
    label = F.col(label) if isinstance(label, str) else label
    kept = rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return kept.where(F.coalesce(finite, F.lit(False))).select("id", "label", F.transform("v", lambda v: F.floor(scale * v.cast("double"))).alias("x"))


def matrix(vectors, width: int) -> np.ndarray:
    """Integer rows of equal width."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray, exact_as_doubles: bool) -> np.ndarray:
    """Integer products of the rows of a and b; in doubles where no sum reaches 2^52."""
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if exact_as_doubles else a @ b.T


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with the component that brings all of them to one norm."""
    f = x.astype(float)
    return np.c_[f, np.sqrt(np.maximum(largest - (f * f).sum(1), 0.0))]


def net(x: np.ndarray, reach: float, first: int = 0, most: int | None = None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first net: rows more than ``reach`` apart that cover all rows within it; each row's centre and distance."""
    norms = (x * x).sum(1)
    centres, owner = [first], np.zeros(len(x), np.int64)
    squared = np.maximum(norms + norms[first] - 2 * (x @ x[first]), 0.0)
    squared[first] = 0.0
    while most is None or len(centres) < most:
        k = int(squared.argmax())
        if squared[k] <= reach * reach:
            break
        new = np.maximum(norms + norms[k] - 2 * (x @ x[k]), 0.0)
        new[k] = 0.0
        nearer = new < squared
        owner[nearer], squared[nearer] = len(centres), new[nearer]
        centres.append(k)
    return centres, owner, np.sqrt(squared)


class Tree:
    """A block's cover tree. Rows stand so that each node's are a range; children of a node are a range of nodes."""

    FIELDS = ("ids", "labels", "x", "centre", "radius", "first", "last", "child", "child_end")

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, largest: float, leaf_rows: int = LEAF_ROWS) -> Tree:
        full = augmented(x, largest)
        order = np.arange(len(ids))
        centre, radius, first, last, child, child_end = [0], [0.0], [0], [len(ids)], [0], [0]
        todo = [0]
        for node in todo:  # grows while it is read: level by level
            a, b, c = first[node], last[node], centre[node]
            rows = order[a:b].copy()
            gaps = np.sqrt(np.maximum(((full[rows] - full[c]) ** 2).sum(1), 0.0))
            radius[node] = float(gaps.max())
            if b - a <= leaf_rows or radius[node] <= 0.0:
                continue
            reach = 2.0 ** (np.ceil(np.log2(radius[node])) - 1)
            own = int(np.flatnonzero(rows == c)[0])
            centres, owner, _ = net(full[rows], reach, own)
            by = np.argsort(owner, kind="stable")
            order[a:b] = rows[by]
            at = a + np.r_[0, np.cumsum(np.bincount(owner, minlength=len(centres)))]
            child[node], child_end[node] = len(centre), len(centre) + len(centres)
            for k, m in enumerate(centres):
                todo.append(len(centre))
                centre.append(int(rows[m]))
                first.append(int(at[k]))
                last.append(int(at[k + 1]))
                radius.append(0.0)
                child.append(0)
                child_end.append(0)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tree = cls()
        tree.ids, tree.labels, tree.x = ids[order], labels[order], x[order]
        tree.centre, tree.radius = place[np.array(centre)], np.array(radius)
        tree.first, tree.last, tree.child, tree.child_end = (np.array(v) for v in (first, last, child, child_end))
        return tree

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        small = {f: getattr(self, f) for f in self.FIELDS}
        if len(self.x) and np.abs(small["x"]).max(initial=0) < 1 << 15:
            small["x"] = small["x"].astype(np.int16)
        np.savez(out, **small)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        tree, z = cls(), np.load(io.BytesIO(data))
        for f in cls.FIELDS:
            setattr(tree, f, z[f])
        tree.x = tree.x.astype(np.int64)
        return tree


class Windows:
    """Queries with their windows of products, and the k best rows found in each."""

    def __init__(self, ids, labels, x: np.ndarray, low, high, floor, same: bool, k: int):
        self.ids, self.labels, self.x, self.same, self.k = np.asarray(ids), np.asarray(labels), x, same, k
        self.norms = np.sqrt((x.astype(float) ** 2).sum(1))
        # a window that is not there is never met: its low end lies above its high end
        n, most = len(self.ids), max(map(len, low), default=0)
        self.low, self.high = np.full((n, most), np.inf), np.full((n, most), -np.inf)
        for i in range(n):
            self.low[i, : len(low[i])] = np.maximum(low[i], floor[i])
            self.high[i, : len(high[i])] = high[i]
        self.found = [[(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(most)] for _ in range(n)]

    def meets(self, which: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Whether products from lower to upper may hold a result: queries x nodes."""
        out = np.zeros(upper.shape, bool)
        for w in range(self.low.shape[1]):
            low, high = self.low[which, w, None], self.high[which, w, None]
            out |= (upper >= low) & (lower <= high) & (low <= high)
        return out

    def take(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Exact products of rows with the queries ``which``."""
        mine = (self.labels[which, None] == labels) == self.same
        mine &= self.ids[which, None] != ids
        for w in range(self.low.shape[1]):
            hit = mine & (scores >= self.low[which, w, None]) & (scores <= self.high[which, w, None])
            for j in np.flatnonzero(hit.any(1)):
                q, cols = which[j], np.flatnonzero(hit[j])
                s, i = self.found[q][w]
                s, i = np.r_[s, scores[j, cols]], np.r_[i, ids[cols]]
                best = np.lexsort((i, -s))[: self.k]
                self.found[q][w] = s[best], i[best]
                if len(best) == self.k:
                    self.low[q, w] = max(self.low[q, w], s[best[-1]])

    def rows(self) -> pd.DataFrame:
        out = [(self.ids[q], w, i, s) for q, ws in enumerate(self.found) for w, (ss, ii) in enumerate(ws) for s, i in zip(ss.tolist(), ii.tolist())]
        return pd.DataFrame(out, columns=["anchor_id", "w", "id", "score"])


def descend(tree: Tree, queries: Windows, exact: bool) -> int:
    """Best-first descent of all queries; gives the number of rows verified."""
    everyone, verified = np.arange(len(queries.ids)), 0
    # bounds from doubles get some slack, so that rounding never hides a row; products themselves are exact
    slack = lambda q: 1.0 + _SLACK * queries.norms[q]

    def verify(nodes: np.ndarray, which: np.ndarray) -> None:
        nonlocal verified
        rows = np.concatenate([np.arange(tree.first[n], tree.last[n]) for n in nodes])
        verified += len(rows)
        queries.take(which, products(queries.x[which], tree.x[rows], exact), tree.ids[rows], tree.labels[rows])

    if not tree.child_end[0]:
        verify(np.array([0]), everyone)
        return verified
    agenda, turn = [(-np.inf, 0, 0, everyone, np.full(len(everyone), np.inf))], 0
    while agenda:
        _, _, node, which, upper = heapq.heappop(agenda)
        which = which[upper >= queries.low[which].min(1)]  # windows have narrowed meanwhile
        if not len(which):
            continue
        children = np.arange(tree.child[node], tree.child_end[node])
        middle = products(queries.x[which], tree.x[tree.centre[children]], exact)
        span = queries.norms[which, None] * tree.radius[children] + slack(which)[:, None]
        meets = queries.meets(which, middle - span, middle + span)
        leaf = tree.child_end[children] == 0
        near = leaf & meets.any(0)
        if near.any():
            some = meets[:, near].any(1)
            verify(children[near], which[some])
        for c in np.flatnonzero(~leaf & meets.any(0)):
            q = meets[:, c]
            bound = (middle + span)[q, c]
            turn += 1
            heapq.heappush(agenda, (-float(bound.max()), turn, int(children[c]), which[q], bound))
    return verified


class Index:
    """Pivots with their balls, and the table of blocks."""

    def __init__(self, spark: SparkSession, rows: DataFrame, blocks: DataFrame | None, pivots: np.ndarray, radii: np.ndarray, width: int, largest: int):
        self.spark, self.rows, self.blocks, self.pivots, self.radii, self.width, self.largest = spark, rows, blocks, pivots, radii, width, largest


def build(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, max_pivots: int = MAX_PIVOTS, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS) -> Index:
    """Index every row of (id, label, x)."""
    spark = rows.sparkSession
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.distinct()
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    n, width, largest = rows.agg(F.count("*"), F.max(F.size("x")), F.max(square)).first()
    if not n:
        return Index(spark, rows, None, np.empty((0, 0)), np.empty(0), 0, 0)
    if largest >= 2.0**62:
        raise ValueError("inner products of these vectors do not fit 62 bits")
    order = F.xxhash64(F.lit(7), "id")
    sample = matrix([r.x for r in rows.select("x").orderBy(order, "id").limit(sample_rows).collect()], width)
    chosen, _, _ = net(augmented(sample, largest), 0.0, most=min(max_pivots, -(-n // block_rows)))
    pivots = augmented(sample[chosen], largest)

    def nearest(batches):
        squares = (pivots * pivots).sum(1)
        for pdf in batches:
            full = augmented(matrix(pdf["x"], width), largest)
            gaps = (full * full).sum(1)[:, None] + squares - 2 * full @ pivots.T
            at = gaps.argmin(1)
            yield pdf.assign(pivot=at, gap=np.sqrt(np.maximum(((full - pivots[at]) ** 2).sum(1), 0.0)))

    dealt = landed(rows.select("id", "label", "x").mapInPandas(nearest, "id bigint, label bigint, x array<bigint>, pivot int, gap double"), "tree-rows")
    sizes = dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect()  # at most max_pivots rows
    radii = np.zeros(len(pivots))
    shares = np.ones(len(pivots), np.int64)
    for r in sizes:
        radii[r.pivot], shares[r.pivot] = r.gap, -(-r.n // block_rows)
    share = F.pmod(F.xxhash64("id"), F.get(F.lit(shares.tolist()), F.col("pivot")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(shares.sum()))

    def plant(batches: Iterator[pd.DataFrame]):
        from pyspark import TaskContext

        part, seq, held, at = TaskContext.get().partitionId(), 0, [], None

        def close() -> pd.DataFrame:
            pdf = pd.concat(held)
            tree = Tree.build(pdf["id"].to_numpy(), pdf["label"].to_numpy(), matrix(pdf["x"].tolist(), width), largest, leaf_rows)
            return pd.DataFrame({"block": [part << 32 | seq], "pivot": [at[0]], "n": [len(pdf)], "tree": [tree.to_bytes()]})

        for pdf in batches:
            for key, group in pdf.groupby(["pivot", "share"], sort=False):
                for a in range(0, len(group), block_rows):
                    piece = group.iloc[a : a + block_rows]
                    if held and (key != at or sum(map(len, held)) + len(piece) > 2 * block_rows):
                        yield close()
                        held, seq = [], seq + 1
                    at = key
                    held.append(piece)
        if held:
            yield close()

    ordered = dealt.select("id", "label", "x", "pivot", share.alias("share")).repartition(parts, "pivot", "share").sortWithinPartitions("pivot", "share", "id")
    blocks = landed(ordered.mapInPandas(plant, "block bigint, pivot int, n bigint, tree binary"), "tree-blocks")
    return Index(spark, dealt, blocks, pivots, radii, width, int(largest))


def search(index: Index, queries: DataFrame, same: bool, k: int, home: bool) -> DataFrame:
    """anchor_id, w, id, score: the k best rows in each window, of each block that was searched.

    queries: id, label, x, pivot and arrays low, high, floor, one place a window. ``home`` searches the blocks of the
    query's own pivot, else those of all others that may hold a product in a window not below its floor.
    """
    width, pivots, radii = index.width, index.pivots, index.radii
    exact = index.largest < _EXACT

    def route(batches):
        for pdf in batches:
            x = matrix(pdf["x"], width)
            q = Windows(pdf["id"], pdf["label"], x, pdf["low"].tolist(), pdf["high"].tolist(), pdf["floor"].tolist(), same, k)
            middle = x.astype(float) @ pivots[:, :-1].T
            span = q.norms[:, None] * (radii + 1e-3) + 1.0 + _SLACK * q.norms[:, None]
            to = q.meets(np.arange(len(x)), middle - span, middle + span)
            to[np.arange(len(x)), pdf["pivot"]] = False
            who, where = np.nonzero(to)
            yield pdf.iloc[who].assign(pivot=where.astype(np.int32))

    kinds = "id bigint, label bigint, x array<bigint>, pivot int, low array<double>, high array<double>, floor array<double>"
    queries = queries.select("id", "label", "x", "pivot", "low", "high", "floor")
    sent = (queries if home else queries.mapInPandas(route, kinds)).join(F.broadcast(index.blocks.select("block", "pivot")) if index.blocks.count() < 1_000_000 else index.blocks.select("block", "pivot"), "pivot")
    trees = index.blocks.select("block", F.lit(0).alias("kind"), "tree")
    both = trees.unionByName(sent.select("block", F.lit(1).alias("kind"), *[c for c in queries.columns if c != "pivot"]), allowMissingColumns=True)

    def run(batches):
        tree, held = None, []

        def flush():
            pdf = pd.concat(held)
            for a in range(0, len(pdf), AT_ONCE):
                some = pdf.iloc[a : a + AT_ONCE]
                q = Windows(some["id"].astype("int64"), some["label"].astype("int64"), matrix(some["x"].tolist(), width), some["low"].tolist(), some["high"].tolist(), some["floor"].tolist(), same, k)
                descend(tree, q, exact)
                yield q.rows()

        for pdf in batches:
            starts = np.flatnonzero(pdf["kind"].to_numpy() == 0)
            for a, b in zip(np.r_[0, starts], np.r_[starts, len(pdf)]):
                piece = pdf.iloc[a:b]
                if len(piece) and piece["kind"].iloc[0] == 0:
                    if held:
                        yield from flush()
                        held = []
                    tree, piece = piece["tree"].iloc[0], piece.iloc[1:]
                if len(piece):
                    if isinstance(tree, bytes | bytearray):
                        tree = Tree.from_bytes(tree)
                    held.append(piece)
                    if sum(map(len, held)) >= 4 * AT_ONCE:
                        yield from flush()
                        held = []
        if held:
            yield from flush()

    parts = max(int(index.spark.conf.get("spark.sql.shuffle.partitions")), index.blocks.count())
    return both.repartition(parts, "block").sortWithinPartitions("block", "kind").select("kind", "tree", "id", "label", "x", "low", "high", "floor").mapInPandas(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(index: Index, queries: DataFrame, same: bool, k: int, name: str) -> DataFrame:
    """The k best of each window: home blocks first, then what may still hold better rows."""
    first = landed(search(index, queries, same, k, home=True), f"{name}-home")
    reached = _best(first, k).where(F.col("rank") == k).select(F.col("anchor_id").alias("id"), "w", F.col("score").cast("double").alias("s"))
    floors = reached.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("s"))  # one entry a window
    nothing = F.lit(float("-inf"))
    floor = F.transform("low", lambda x, i: F.coalesce(F.try_element_at("s", i), nothing))
    raised = queries.drop("floor").join(floors, "id", "left").withColumn("floor", floor)
    return _best(first.unionByName(search(index, raised, same, k, home=False)), k)


def hard_negatives(rows: DataFrame, anchors: Column, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, low_percent: int = 80, high_percent: int = 100, **how) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (id, label, x) rows.

    ``anchors`` tells which rows are queries. A negative's product lies between low and high percent of the positive's.
    """
    index = build(rows, **how)
    if index.blocks is None:
        return index.spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    ends = lambda x: F.array(F.lit(x).cast("double"))
    asked = index.rows.where(anchors).groupBy("id").agg(F.min(F.struct("label", "x", "pivot")).alias("a")).select("id", "a.*")
    asked = landed(asked.withColumns({"low": ends("-inf"), "high": ends("inf"), "floor": ends("-inf")}), "tree-anchors")
    positives = _searched(index, asked, True, n_positives, "tree-positives").select("anchor_id", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = landed(positives, "tree-positives")
    # whole-number ends: the smallest s with 100 s >= low p, the largest with 100 s <= high p
    low, high = F.expr(f"CAST(ceil(positive_score * {low_percent} / 100) AS DOUBLE)"), F.expr(f"CAST(floor(positive_score * {high_percent} / 100) AS DOUBLE)")
    windows = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("w", low.alias("low"), high.alias("high")))).alias("ws"))  # n_positives places
    narrow = asked.select("id", "label", "x", "pivot").join(windows, "id").withColumns({"low": F.col("ws")["low"], "high": F.col("ws")["high"]})
    narrow = landed(narrow.withColumn("floor", F.transform("low", lambda x: F.lit(float("-inf")))).drop("ws"), "tree-windows")
    negatives = _searched(index, narrow, False, n_negatives, "tree-negatives")
    out = negatives.join(positives, ["anchor_id", "w"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
