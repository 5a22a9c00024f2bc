"""Quality classifier by co-training of a text view and a metadata view.

Text view: the words, pairs of neighbouring words (lower case) and word shapes (letters folded to a and A, digits to 0,
other marks kept) in hashed places, each kind as damped counts of length 1, with the share of different words, mean word
length and log length. Metadata view: what is known beside the text: source, language and length class in hashed places.
Two logistic regressions, one per view, see only their own features.

Each round, both views score all documents without a label. Of those that a view is sure of (calibrated probability above
SURE, or below 1 - SURE), the surest become pseudo-labels for the other view, PSEUDO_ROWS in all, in the classes' labelled
ratio, so that a view that is sure of one class only teaches no imbalance. The other view is fitted anew with them, and
the new fit is taken only if the log loss on held-out labels does not rise. Rounds end early when no view profits. At last
each view is calibrated on the held-out labels, and a logistic curve over both calibrated log-odds, fitted there too,
weighs them: a view that knows nothing gets no say.

Bounds that are parameters: TRAIN_ROWS labelled rows (smallest seeded hashes) and PSEUDO_ROWS taught per round and view.
The search for pseudo-labels and the scores cover every document, in maps without a shuffle; the surest come by combinable
top-n over (id, two numbers). Labelled ids meet documents in broadcast joins of at most that many rows.

Null text, source or language counts as empty. With labels of one class only, or none, every score is the prior (0.5
without labels). Repeated rows are scored alike and taught once an id; very long texts cost in proportion. Documents of a
null id are scored and never taught. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscan.llm.common import landed

TRAIN_ROWS, PSEUDO_ROWS, HELD_OUT, ROUNDS, SURE, SEED = 10_000, 2_000, 4, 2, 0.95, 20_240_229
SHAPES, WORDS, PAIRS, META_PLACES, KEEP_FROM = 512, 4096, 4096, 64, 0.5
TEXT_PLACES = SHAPES + WORDS + PAIRS + 3
VIEWS = {"text": TEXT_PLACES, "meta": META_PLACES}
#: Words whose places a worker remembers; speed only.
REMEMBERED = 300_000
_FOLDS = ((re.compile(r"[^\W\d_]+"), lambda m: "".join(dict.fromkeys("A" if c.isupper() else "a" for c in m[0]))), (re.compile(r"\d+"), "0"))


class _Places(dict):
    """word -> its place among shapes and its place among words, in one number."""

    def __missing__(self, word: str) -> int:
        body, sign = (word[:-1], word[-1]) if word and not word[-1].isalnum() else (word, "")
        if body.isalpha() and body.islower():
            shape = "a" + sign
        elif body.isalpha() and body.istitle():
            shape = "Aa"[: min(len(body), 2)] + sign
        else:
            shape = word
            for pattern, by in _FOLDS:
                shape = pattern.sub(by, shape)
        if (at := _shapes.get(shape)) is None:
            at = _shapes[shape] = zlib.crc32(shape.encode()) % SHAPES << 16
        value = self[word] = at | zlib.crc32((word if word.islower() else word.lower()).encode()) % WORDS
        return value


_shapes: dict[str, int] = {}
_places = _Places()


def _damped(places: np.ndarray, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different places and their damped counts, brought to length 1."""
    n = np.bincount(places, minlength=size)
    at = np.flatnonzero(n)
    value = 1.0 + np.log(n[at])
    return at + first, value / math.sqrt(float(value @ value))


def text_view(text: str) -> tuple[np.ndarray, np.ndarray]:
    if len(_places) > REMEMBERED:
        _places.clear()
        _shapes.clear()
    words = text.split()
    both = np.fromiter(map(_places.__getitem__, words), np.int64, len(words))
    word, n = both & 0xFFFF, max(len(words), 1)
    rest = np.array([len(set(words)) / n, len(text) / n / 10, math.log1p(len(text)) / 10])
    parts = [_damped(both >> 16, 0, SHAPES), _damped(word, SHAPES, WORDS), _damped((word[:-1] * 31 + word[1:] * 17) % PAIRS, SHAPES + WORDS, PAIRS)] if words else []
    parts = [p for p in parts if len(p[0])] + [(np.arange(TEXT_PLACES - 3, TEXT_PLACES), rest)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def meta_view(source: str, lang: str, n_chars: int) -> tuple[np.ndarray, np.ndarray]:
    return _meta_places(source, lang, (n_chars + 1).bit_length())


@lru_cache(maxsize=10_000)
def _meta_places(source: str, lang: str, length_class: int) -> tuple[np.ndarray, np.ndarray]:
    at = [zlib.crc32(x.encode()) % META_PLACES for x in ("s" + source, "l" + lang, f"c{length_class}")]
    at, n = np.unique(at, return_counts=True)
    return at, n.astype(float)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "source", "lang")])


def _featured(docs: DataFrame) -> DataFrame:
    """doc_id and both views as sparse vectors; for bounded samples."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def views(batches):
        for pdf in batches:
            text = [text_view(t) for t in pdf["text"]]
            meta = [meta_view(s, lang, len(t)) for s, lang, t in zip(pdf["source"], pdf["lang"], pdf["text"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ti": [x[0] for x in text], "tv": [x[1] for x in text], "mi": [x[0] for x in meta], "mv": [x[1] for x in meta]})

    rows = _read(docs).mapInPandas(views, f"doc_id {kind}, ti array<int>, tv array<double>, mi array<int>, mv array<double>")
    sparse = lambda n: F.udf(lambda i, v: SparseVector(n, i, v), VectorUDT())
    return rows.select("doc_id", sparse(TEXT_PLACES)("ti", "tv").alias("text"), sparse(META_PLACES)("mi", "mv").alias("meta"))


class View:
    """A view's weights, and the slope and offset that turn its margin into calibrated log-odds."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset, self.slope, self.shift = weights, offset, 1.0, 0.0

    def margin(self, features: tuple[np.ndarray, np.ndarray]) -> float:
        return float(self.weights[features[0]] @ features[1]) + self.offset

    def margins(self, vectors: list[SparseVector]) -> np.ndarray:
        return np.array([self.margin((v.indices, v.values)) for v in vectors])

    def odds(self, margin):
        return margin * self.slope + self.shift


def _fit(rows: DataFrame, view: str) -> View:
    model = LogisticRegression(featuresCol=view, labelCol="label", maxIter=50, regParam=1e-4, standardization=False).fit(rows)
    return View(model.coefficients.toArray(), float(model.intercept))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights and offset (last) of a small dense logistic regression, by Newton steps."""
    a, w = np.c_[x, np.ones(len(y))], np.zeros(x.shape[1] + 1)
    keep = np.r_[np.full(x.shape[1], ridge), 1e-9]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(keep), a.T @ (p - y) + keep * w)
        w -= np.clip(step, -5, 5)
    return w


def log_loss(odds: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0.0, np.where(y > 0, -odds, odds))))


def _held_loss(view: View, margins: np.ndarray, y: np.ndarray) -> float:
    """Loss of the view on held-out labels, calibrated on the other half of them each time."""
    half = np.arange(len(y)) % 2 == 0
    out = []
    for side in (half, ~half):
        if len(set(y[~side])) < 2 or not side.any():
            out.append(log_loss(margins, y))
            continue
        w = logistic(margins[~side, None], y[~side])
        out.append(log_loss(margins[side] * w[0] + w[1], y[side]))
    return float(np.mean(out))


class Classifier:
    """The two calibrated views and the weights of their log-odds."""

    def __init__(self, views: dict[str, View], weights: np.ndarray, prior: float, accepted: int = 0):
        self.views, self.weights, self.prior, self.accepted = views, weights, prior, accepted

    def odds(self, docs: DataFrame) -> DataFrame:
        """doc_id and each view's calibrated log-odds, of all documents."""
        text, meta = self.views["text"], self.views["meta"]
        kind = docs.schema["doc_id"].dataType.simpleString()

        def score(batches):
            for pdf in batches:
                t = [text.odds(text.margin(text_view(x))) for x in pdf["text"]]
                m = [meta.odds(meta.margin(meta_view(s, lang, len(x)))) for s, lang, x in zip(pdf["source"], pdf["lang"], pdf["text"])]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": t, "meta": m})

        return _read(docs).mapInPandas(score, f"doc_id {kind}, text double, meta double")

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, text_score, meta_score, score, kept."""
        chance = lambda x: 1 / (1 + F.exp(-x))
        if not self.views:
            p = F.lit(self.prior)
            return docs.select("doc_id", p.alias("text_score"), p.alias("meta_score"), p.alias("score"), (p >= KEEP_FROM).alias("kept"))
        a, b, c = (float(x) for x in self.weights)
        both = chance(F.col("text") * a + F.col("meta") * b + c)
        return self.odds(docs).select("doc_id", chance(F.col("text")).alias("text_score"), chance(F.col("meta")).alias("meta_score"), both.alias("score"), (both >= KEEP_FROM).alias("kept"))


def _surest(odds: DataFrame, view: str, ratio: float, rows: int) -> DataFrame:
    """Ids and pseudo-labels of the documents a view is surest of, in the ratio of the classes."""
    least = math.log(SURE / (1 - SURE))
    want = {1.0: rows * ratio, 0.0: rows * (1 - ratio)}
    sides = {1.0: (F.col(view) >= least, F.desc(view)), 0.0: (F.col(view) <= -least, F.asc(view))}
    taken = {y: landed(odds.where(test).orderBy(order, "doc_id").limit(math.ceil(want[y])).select("doc_id", F.lit(y).alias("label")), "co-sure") for y, (test, order) in sides.items()}
    share = min(taken[y].count() / want[y] for y in want)  # both classes shrink alike where one has too few
    return taken[1.0].orderBy("doc_id").limit(int(want[1.0] * share)).unionByName(taken[0.0].orderBy("doc_id").limit(int(want[0.0] * share)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, pseudo_rows: int = PSEUDO_ROWS, rounds: int = ROUNDS, seed: int = SEED) -> Classifier:
    """Fit on a bounded sample of labelled rows; every fourth of them by hash is held out for choices and calibration."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", order).orderBy("h", "doc_id").limit(train_rows)
    known = landed(known, "co-labels")

    def with_views(ids: DataFrame) -> DataFrame:
        picked = _featured(docs.select("doc_id", "text", "source", "lang").join(F.broadcast(ids.select("doc_id")), "doc_id").dropDuplicates(["doc_id"]))
        return landed(picked.join(F.broadcast(ids), "doc_id"), "co-rows").coalesce(4)  # bounded by parameters at any corpus size

    rows = with_views(known).persist()
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        rows.unpersist()
        return Classifier({}, np.zeros(3), 0.5 if not counts else min(max(next(iter(counts)), 1e-3), 1 - 1e-3))
    prior = counts[1.0] / sum(counts.values())
    base = rows.where(f"pmod(h, {HELD_OUT}) <> 0").select("doc_id", "text", "meta", "label")
    held = rows.where(f"pmod(h, {HELD_OUT}) = 0").orderBy("h", "doc_id").collect()  # a share of train_rows
    if len({r.label for r in held}) < 2 or base.select("label").distinct().count() < 2:
        base, held = rows.select("doc_id", "text", "meta", "label"), rows.orderBy("h", "doc_id").collect()
    y = np.array([r.label for r in held])

    def judged(view: View, name: str) -> tuple[View, float]:
        margins = view.margins([r[name] for r in held])
        loss = _held_loss(view, margins, y)
        view.slope, view.shift = (float(v) for v in logistic(margins[:, None], y))
        return view, loss

    views, losses = {}, {}
    for name in VIEWS:
        views[name], losses[name] = judged(_fit(base, name), name)
    accepted = 0
    for _ in range(rounds):
        odds = Classifier(views, np.zeros(3), prior).odds(docs.where("doc_id IS NOT NULL")).join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti")
        odds = landed(odds.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("meta").alias("meta")), "co-odds")
        better = {}
        for name, other in zip(VIEWS, reversed(VIEWS)):
            more = with_views(_surest(odds, other, prior, pseudo_rows)).select("doc_id", "text", "meta", "label")
            view, loss = judged(_fit(base.unionByName(more), name), name)
            if loss <= losses[name]:
                better[name] = view, loss
        for name, (view, loss) in better.items():
            views[name], losses[name] = view, loss
            accepted += 1
        if not better:
            break
    both = np.c_[tuple(views[name].odds(views[name].margins([r[name] for r in held])) for name in VIEWS)]
    rows.unpersist()
    return Classifier(views, logistic(both, y), prior, accepted)
