"""Co-training: held-out order, plain scores of the same views, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellscan.llm import cotraining

SF = "/root/testdata/sf0.01"
EDGES = [(None, None, None, None), (None, "no id", "x", "en"), (900_001, "", "web", "en"), (900_002, None, "web", None), (900_003, "w " * 40_000, "web", "en"), (900_004, "same row", "web", "en"), (900_004, "same row", "web", "en")]


def order(pairs):
    good, bad = [s for s, q in pairs if q == 1], [s for s, q in pairs if q == 0]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame(EDGES, "doc_id long, text string, source string, lang string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumns({c: F.lit("clash") for c in ("meta", "label", "h")})
    return docs.persist(), labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}


def test_exchange_does_no_harm(tables):
    docs, known, rest = tables
    orders = {}
    for rounds in (0, 2):
        model = cotraining.train(docs, known, rounds=rounds)
        scored = [(r.score, rest[r.doc_id], r.kept) for r in model.score(docs).collect() if r.doc_id in rest]
        orders[rounds] = order([s[:2] for s in scored])
        assert sum(k for _, q, k in scored if q == 0) < 0.25 * sum(q == 0 for _, q, _ in scored)
        assert sum(k for _, q, k in scored if q == 1) > 0.97 * sum(q == 1 for _, q, _ in scored)
    assert orders[2] > 0.95 and orders[2] >= orders[0] - 1e-9


def test_scores_are_those_of_the_views(tables):
    docs, known, _ = tables
    model = cotraining.train(docs, known, rounds=1)
    want = []
    for r in docs.collect():
        t, s, lang = r.text or "", r.source or "", r.lang or ""
        odds = [model.views["text"].odds(model.views["text"].margin(cotraining.text_view(t))), model.views["meta"].odds(model.views["meta"].margin(cotraining.meta_view(s, lang, len(t))))]
        want.append((r.doc_id, round(1 / (1 + math.exp(-(odds[0] * model.weights[0] + odds[1] * model.weights[1] + model.weights[2]))), 9)))
    got = [(r.doc_id, round(r.score, 9)) for r in model.score(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    text = cotraining.text_view("One one 22 a-b one")
    assert len(set(text[0])) == len(text[0]) and np.isclose((text[1][text[0] < cotraining.SHAPES] ** 2).sum(), 1.0)


def test_fit_is_a_minimum(tables):
    """The fitted weights leave no slope in the ridge loss, as a plain computation sees it."""
    docs, known, _ = tables
    rows = cotraining._featured(docs.join(known, "doc_id", "left_semi")).join(known.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    view, data = cotraining._fit(rows, "meta"), rows.collect()
    a, y = np.array([r.meta.toArray() for r in data]), np.array([r.label for r in data])
    p = 1 / (1 + np.exp(-(a @ view.weights + view.offset)))
    assert abs((a.T @ (p - y)) / len(y) + 1e-4 * view.weights).max() < 1e-4 and abs((p - y).mean()) < 1e-4


def test_few_labels(spark, tables):
    docs, known, _ = tables
    for labels, prior in ((known.limit(0), 0.5), (known.where("quality = 1"), 0.999), (known.where("quality = 0"), 0.001)):
        scored = cotraining.train(docs, labels).score(docs)
        assert scored.count() == docs.count() and {r.score for r in scored.select("score").distinct().collect()} == {prior}
    tiny = cotraining.train(docs, known.where("quality = 1").limit(2).unionByName(known.where("quality = 0").limit(1)))
    assert tiny.score(docs).where("score IS NULL OR isnan(score)").isEmpty() and tiny.score(docs.limit(0)).count() == 0
    assert cotraining.train(docs.limit(0), known).score(docs).count() == docs.count()


def test_repeated_rows_are_scored_alike(tables):
    docs, known, _ = tables
    scored = cotraining.train(docs.unionByName(docs), known, rounds=1).score(docs.unionByName(docs))
    assert scored.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.countDistinct("score").alias("n")).where("n > 1").isEmpty()
