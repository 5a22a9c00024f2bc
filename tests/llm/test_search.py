"""Lexical search and hard negatives against plain versions, with nulls, ties, repeats, long and empty input."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellscan.llm import cover_tree, stratified_search

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_search(docs, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    counted = [(i, Counter(x), len(x)) for i, t in docs if (x := terms(t))]
    n, words = len(counted), sum(c for *_, c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, c, k in counted:
            m = 50 + 50 * k * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


DOCS = [(None, "alpha beta"), (None, None), (1, ""), (2, "Alpha ALPHA beta-gamma"), (2, "Alpha ALPHA beta-gamma"), (3, "İ ß é—x alpha"), (4, "rare " * 3000 + "alpha"), (5, "\t\n .,;"), (6, "a\x00b\x7fc alpha_beta")]
ITEMS = [(1, "alpha beta"), (2, None), (3, "..."), (4, "é—x rare RARE"), (None, "gamma"), (1, "rare"), (7, "b\x00c unknown")]


@pytest.mark.parametrize("piece_terms,at_once,seeds", [(2_000_000, 200_000, 400), (3000, 900, 3)])
def test_search(spark, piece_terms, at_once, seeds):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + DOCS + [(10_000 + k, "same words here alpha") for k in range(60)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + ITEMS
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, term string, m int, n int").repartition(3)
    index = stratified_search.build(docs, piece_terms)
    asked = spark.createDataFrame([(*r, "x", 0) for r in items], "item_id long, text string, term string, rank int")
    for top in (50, 4) if piece_terms > 3000 else (7,):
        got = sorted(map(tuple, stratified_search.search(index, asked, top, at_once, seeds).collect()), key=str)
        assert got == plain_search(rows, items, top)
    assert index.postings.where("term IS NOT NULL").groupBy("piece", "term").count().where("count > 1").isEmpty()


def test_search_visits_fewer_strata(spark):
    """Strata whose bound is below what was found are left out."""
    docs = spark.createDataFrame([(k, "needle " * (1 + k % 3) + "hay " * (5 + k)) for k in range(300)], "doc_id long, text string")
    index = stratified_search.build(docs, 500)
    spark.sparkContext.setJobGroup("search", "search")
    found = stratified_search.search(index, spark.createDataFrame([(1, "needle")], "item_id long, text string"), 5, seed_docs=10)
    plan = found._jdf.queryExecution().toString()
    assert "bound" in plan and [tuple(r)[1:] for r in found.orderBy("rank").collect()] == [x[1:] for x in sorted(plain_search([(k, "needle " * (1 + k % 3) + "hay " * (5 + k)) for k in range(300)], [(1, "needle")], 5), key=lambda x: x[1])]


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert stratified_search.search(stratified_search.build(docs.limit(0)), items).count() == 0
    assert stratified_search.search(stratified_search.build(docs), items.limit(0)).count() == 0
    assert stratified_search.search(stratified_search.build(docs), items.withColumn("text", F.lit("zzz"))).count() == 0


def plain_negatives(rows, every, n_positives=5, n_negatives=5):
    out = []
    for a in rows:
        if a[0] % every:
            continue
        best = sorted((-int(np.dot(a[2], b[2])), b[0]) for b in rows if b[0] != a[0] and b[1] == a[1])[:n_positives]
        other = sorted((-int(np.dot(a[2], b[2])), b[0]) for b in rows if b[0] != a[0] and b[1] != a[1])
        for s, p in best:
            fits = [(x, i) for x, i in other if 80 * -s <= 100 * -x <= 100 * -s][:n_negatives]
            out += [(a[0], p, k + 1, i, -s, -x) for k, (x, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"sample_rows": 40, "max_pivots": 5, "block_rows": 16, "leaf_rows": 2}])
def test_hard_negatives(spark, how):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 6))
    x = np.vstack([c + 0.05 * rng.normal(size=(30, 6)) for c in centres] + [rng.normal(size=(60, 6)), np.tile(centres[0], (70, 1)), np.zeros((2, 6))]).astype(np.float32)
    rows = [(k, int(rng.integers(0, 4)), x[k].tolist()) for k in range(len(x))]
    odd = [(None, 1, [0.1] * 6), (9001, None, [0.1] * 6), (9002, 1, None), (9003, 1, [0.1, None]), (9004, 1, [float("nan")] * 6), (9005, 1, [float("inf")] * 6), rows[10], (9010, 1, [0.5, 0.5]), (9020, 2, [])]
    table = spark.createDataFrame([(*r, 1, "t", 0) for r in rows + odd], "vec_id long, label int, embedding array<float>, id int, tree string, pivot int").repartition(4)
    used = cover_tree.usable(table)
    want = [(i, l, np.floor(256 * np.r_[np.array(v, float), np.zeros(6 - len(v))]).astype(int)) for i, l, v in rows + odd[-2:]]
    got = cover_tree.hard_negatives(used, F.col("id") % 10 == 0, **how)
    assert sorted(map(tuple, got.collect())) == plain_negatives(want, 10)


def test_descent_skips_rows():
    """Far clusters are never verified, and trees keep their covering and separating distances."""
    rng = np.random.default_rng(1)
    x = np.vstack([200 * rng.normal(size=8) + 3 * rng.normal(size=(100, 8)) for _ in range(30)]).astype(np.int64)
    largest = float((x * x).sum(1).max())
    tree = cover_tree.Tree.build(np.arange(3000), np.zeros(3000, np.int64), x, largest)
    assert sorted(tree.ids) == list(range(3000)) and (tree.x == x[tree.ids]).all()
    full = cover_tree.augmented(tree.x, largest)
    for n in range(len(tree.first)):
        assert np.linalg.norm(full[tree.first[n] : tree.last[n]] - full[tree.centre[n]], axis=1).max() <= tree.radius[n] + 1e-9
        if tree.child_end[n]:
            assert (tree.first[tree.child[n]], tree.last[tree.child_end[n] - 1]) == (tree.first[n], tree.last[n])
            c, reach = full[tree.centre[tree.child[n] : tree.child_end[n]]], 2.0 ** (np.ceil(np.log2(tree.radius[n])) - 1)
            gaps = np.linalg.norm(c[:, None] - c[None], axis=2) + 1e9 * np.eye(len(c))
            assert gaps.min() > reach - 1e-6 and tree.radius[tree.child[n] : tree.child_end[n]].max() <= reach + 1e-6
    q = cover_tree.Windows([-1], [0], x[:1], [[-np.inf]], [[np.inf]], [[-np.inf]], True, 5)
    verified = cover_tree.descend(cover_tree.Tree.from_bytes(tree.to_bytes()), q, True)
    s = x @ x[0]
    assert [(i, v) for i, v in zip(q.rows()["id"], q.rows()["score"])] == [(i, s[i]) for i in sorted(range(3000), key=lambda i: (-s[i], i))[:5]]
    assert verified < 600


def test_hard_negatives_of_nothing(spark):
    rows = spark.createDataFrame([(100, 1, [0.1]), (1, 1, [0.2])], "vec_id long, label int, embedding array<float>")
    anchors = F.col("id") % 100 == 0
    assert cover_tree.hard_negatives(cover_tree.usable(rows.limit(0)), anchors).count() == 0
    assert cover_tree.hard_negatives(cover_tree.usable(rows), anchors).count() == 0
    with pytest.raises(ValueError):
        cover_tree.build(cover_tree.usable(rows.withColumn("embedding", F.array(F.lit(1e12)))))
