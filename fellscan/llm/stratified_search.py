"""Ranked lexical search over an index of length strata.

Documents of an equal normaliser m form a stratum. In a stratum a term's weight-free impact hangs on tf alone, so postings
are kept by tf (largest first) and an impact is worked out once per (term, tf). The index is one Parquet table; a stratum
is held in pieces of about PIECE_TERMS words, and a piece has a row for each of its terms

    piece, m, n_docs, term, df, tfs (different ones, falling), ends (where each tf's documents end), docs (numbers in the piece)

and one row with a null term and the piece's doc_ids. Impacts grow with tf, so the largest tf of each of an item's terms
bounds what any document of the piece can score: sum of w * impact(max tf, m). A search visits strata by these bounds:
for each item first the pieces of the highest bounds until SEED_DOCS documents are seen, which gives the score of its 50th
document so far; then all other pieces whose bound reaches it. The rest cannot hold a result, so results are exact.

How it scales: one shuffle deals texts out by stratum, large strata split by hash, so neither a usual length nor a group
of copies meets in one task; a piece is closed when it is full whatever the dealing was. A search shuffles only postings of
the items' terms, by piece. Items are worked through in blocks whose number of (item, term) rows is counted and bounded by
ITEM_TERMS, and only these are sent to tasks. Each (item, piece) gives at most ``top`` rows.

Null text has no term: such documents count nowhere and such items have no results. Rows are documents of their own, also
with equal or null doc_id (nulls come last among equal scores); item rows of equal item_id are one item with the terms of
all. Equal scores come by ascending doc_id. Very long texts form strata of their own. Empty tables give an empty result;
other columns are not read. Scores are 64-bit integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fellscan.llm.common import ascii_lower, beside, landed

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a piece, (item, term) rows of a block of items, and documents looked at before bounds are compared. Speed only.
PIECE_TERMS, ITEM_TERMS, SEED_DOCS, DENSE_CELLS = 2_000_000, 200_000, 400, 500_000
TOP = 50
#: As bytes: what is no part of a term becomes a blank, A-Z lower case, the rest stays.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
INDEX_TYPE = "piece bigint, m bigint, n_docs int, term string, df int, tfs array<int>, ends array<int>, docs array<int>, doc_ids array<bigint>"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class _Piece:
    """Documents of one stratum on their way into the index."""

    def __init__(self, m: int):
        self.m, self.numbers, self.words = m, defaultdict(count().__next__), 0
        self.ids, self.terms, self.tfs = [], [], []

    def add(self, doc_id, words: list[bytes]) -> None:
        tally = Counter(words)
        self.terms.append(np.fromiter(map(self.numbers.__getitem__, tally), np.int32, len(tally)))
        self.tfs.append(np.fromiter(tally.values(), np.int32, len(tally)))
        self.ids.append(doc_id)
        self.words += len(words)

    def batch(self, piece: int) -> pa.RecordBatch:
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        docs = np.repeat(np.arange(n, dtype=np.int32), [len(self.terms[i]) for i in order])
        terms, tfs = np.concatenate([self.terms[i] for i in order]), np.concatenate([self.tfs[i] for i in order])
        by = np.lexsort((docs, -tfs, terms))
        docs, terms, tfs = docs[by], terms[by], tfs[by]
        new_term = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
        new_tf = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1])])
        at = np.r_[new_term, len(terms)].astype(np.int32)  # where each term's documents begin
        groups = np.r_[np.searchsorted(new_tf, new_term), len(new_tf)].astype(np.int32)
        ends = np.r_[new_tf[1:], len(terms)] - np.repeat(new_term, np.diff(groups))
        k = len(new_term)
        lists = [pa.ListArray.from_arrays(pa.array(o), pa.array(v.astype(np.int32))) for o, v in ((groups, tfs[new_tf]), (groups, ends), (at, docs))]
        nothing = pa.nulls(1, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(k + 1, piece), pa.int64()),
                pa.array(np.full(k + 1, self.m), pa.int64()),
                pa.array(np.full(k + 1, n), pa.int32()),
                pa.array([*self.numbers, None], pa.binary()).cast(pa.string()),
                pa.concat_arrays([pa.array(np.diff(at), pa.int32()), pa.nulls(1, pa.int32())]),
                *(pa.concat_arrays([x, nothing]) for x in lists),
                pa.concat_arrays([pa.nulls(k, pa.list_(pa.int64())), pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64()))]),
            ],
            names=["piece", "m", "n_docs", "term", "df", "tfs", "ends", "docs", "doc_ids"],
        )


def _counted(docs: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, text and the number n of terms of documents that have one, or n alone."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            n = np.array([len(terms_of(t)) if t else 0 for t in texts.to_pylist()], np.int64)
            some = pa.array(n > 0)
            columns = {"doc_id": batch.column("doc_id"), "text": texts} if with_text else {}
            yield pa.RecordBatch.from_pydict(columns | {"n": pa.array(n)}).filter(some)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text string, n bigint" if with_text else "n bigint")


class Index:
    """The table of postings with the number of documents and of words."""

    def __init__(self, postings: DataFrame, n_docs: int, n_terms: int):
        self.postings, self.n_docs, self.n_terms = postings, n_docs, n_terms


def build(docs: DataFrame, piece_terms: int = PIECE_TERMS) -> Index:
    """Index every document of (doc_id, text); written to the shared folder."""
    spark = docs.sparkSession
    rows = _counted(docs, with_text=True)
    lengths = landed(_counted(docs, with_text=False).groupBy("n").agg(F.count("*").alias("docs")), "search-lengths")
    n_docs, n_terms = lengths.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0))).first()
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(n_terms, 1)}L").alias("m")
    strata = lengths.select(m, (F.col("n") * F.col("docs")).alias("terms")).groupBy("m").agg(F.ceil(F.sum("terms") / piece_terms).alias("shares"))
    dealt = beside(rows.withColumn("m", m), strata, strata.count(), ["m"]).withColumn("share", F.pmod(F.xxhash64("doc_id", "text"), F.col("shares")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_terms // (4 * piece_terms)))

    def index(batches):
        from pyspark import TaskContext

        part, seq, piece, at = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            for doc_id, text, stratum, share in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "m", "share"))):
                if piece and (at != (stratum, share) or piece.words >= piece_terms):
                    yield piece.batch(part << 32 | seq)
                    piece, seq = None, seq + 1
                if piece is None:
                    piece, at = _Piece(stratum), (stratum, share)
                piece.add(doc_id, terms_of(text))
        if piece:
            yield piece.batch(part << 32 | seq)

    ordered = dealt.select("doc_id", "text", "m", "share").repartition(parts, "m", "share").sortWithinPartitions("m", "share")
    return Index(landed(ordered.mapInArrow(index, INDEX_TYPE), "search-index"), n_docs, n_terms)


def _impact(tf: np.ndarray, m: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _scores(table: pa.Table, weights: list[dict]):
    """Scores of the piece's documents for each item, given as term -> weight."""
    n, m = table["n_docs"][0].as_py(), table["m"][0].as_py()
    table = table.combine_chunks()
    flat = lambda c: table[c].chunk(0).flatten().to_numpy(zero_copy_only=False)
    offsets = lambda c: (x := table[c].chunk(0).offsets.to_numpy()) - x[0]
    groups, at, ends = offsets("tfs"), offsets("docs"), flat("ends").astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    sizes[groups[:-1]] = ends[groups[:-1]]
    impacts, docs = np.repeat(_impact(flat("tfs").astype(np.int64), m), sizes), flat("docs")
    place = {t: i for i, t in enumerate(table["term"].to_pylist())}
    if len(place) * n <= DENSE_CELLS and max((sum(w.values()) for w in weights), default=0) < 1 << 32:
        # a small piece as a matrix; products of integers below 2^53 are exact
        cells, of_items = np.zeros((len(place), n)), np.zeros((len(weights), len(place)))
        cells[np.repeat(np.arange(len(place)), np.diff(at)), docs] = impacts
        for i, w in enumerate(weights):
            for t, x in w.items():
                if t in place:
                    of_items[i, place[t]] = x
        yield from (of_items @ cells).astype(np.int64)
        return
    for w in weights:
        total = np.zeros(n, np.int64)
        for t, x in w.items():
            if (k := place.get(t)) is not None:
                total[docs[at[k] : at[k + 1]]] += x * impacts[at[k] : at[k + 1]]
        yield total


def _visit(postings: DataFrame, visits: DataFrame, weights, top: int) -> DataFrame:
    """The best documents of (item, piece) pairs, none below the item's ``floor``."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"item": [], "doc_id": [], "score": []}
        terms = left.filter(pc.is_valid(left["term"]))
        if right.num_rows and terms.num_rows:
            ids = pc.drop_null(left["doc_ids"]).combine_chunks().flatten()
            items, floors = right["item"].to_pylist(), right["floor"].to_pylist()
            for item, floor, total in zip(items, floors, _scores(terms, [weights.value[i] for i in items])):
                found = np.flatnonzero(total >= max(floor, 1))
                if len(found) > top:
                    least = np.partition(total[found], len(found) - top)[len(found) - top]
                    found = found[total[found] >= least]
                found = found[np.argsort(-total[found], kind="stable")][:top]
                out["item"].append(np.full(len(found), item, np.int32))
                out["doc_id"].append(found)
                out["score"].append(total[found])
            places = pa.array(np.concatenate(out["doc_id"]), pa.int64())
            return pa.table({"item": np.concatenate(out["item"]), "doc_id": ids.take(places), "score": np.concatenate(out["score"])})
        return pa.table({"item": pa.array([], pa.int32()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    return postings.groupBy("piece").cogroup(visits.groupBy("piece")).applyInArrow(score, "item int, doc_id bigint, score bigint")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and each of its different terms."""
    return items.select("item_id", F.explode(F.regexp_extract_all(ascii_lower("text"), F.lit(TERM), F.lit(0))).alias("term")).distinct()


def search(index: Index, items: DataFrame, top: int = TOP, item_terms_at_once: int = ITEM_TERMS, seed_docs: int = SEED_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``top`` documents."""
    spark = items.sparkSession
    wanted = landed(item_terms(items), "search-terms")
    blocks = max(1, -(-wanted.count() // item_terms_at_once))
    out = None
    for k in range(blocks):
        some = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        found = _search_block(spark, index, some, top, seed_docs)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(spark: SparkSession, index: Index, wanted: DataFrame, top: int, seed_docs: int) -> DataFrame:
    id_type = wanted.schema["item_id"].dataType.simpleString()
    terms = wanted.select("term").distinct()
    of_terms = beside(index.postings.where("term IS NOT NULL"), terms, terms.count(), ["term"], limit=4 * ITEM_TERMS)
    postings = landed(of_terms.select(*index.postings.columns), "search-postings")
    of_docs = index.postings.where("term IS NULL")
    # weights: w is 0 for terms of no document, which no posting asks for
    frequency = postings.groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    rows = wanted.join(frequency, "term").select("item_id", "term", w.alias("w")).where("w > 0").collect()  # a block: ITEM_TERMS rows or one item
    ids = sorted({r.item_id for r in rows}, key=lambda i: (i is None, i or 0))
    number = {i: k for k, i in enumerate(ids)}
    by_item = [{} for _ in ids]
    for r in rows:
        by_item[number[r.item_id]][r.term] = r.w
    weights = spark.sparkContext.broadcast(by_item)
    weighed = spark.createDataFrame([(number[r.item_id], r.term, r.w) for r in rows], "item int, term string, w bigint")
    top_tf = F.element_at("tfs", 1).cast("long")
    most = F.floor(F.lit(1_000_000_000) * top_tf / (1000 * top_tf + 20 * F.col("m"))) + 1  # a double may round down
    narrow = postings.select("piece", "term", "n_docs", most.alias("most"))
    bounds = narrow.join(F.broadcast(weighed), "term").groupBy("item", "piece").agg(F.sum(F.col("w") * F.col("most")).alias("bound"), F.first("n_docs").alias("n_docs"))
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "piece")
    seen = F.coalesce(F.sum("n_docs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = landed(bounds.withColumn("early", seen < seed_docs), "search-bounds")
    both = postings.unionByName(of_docs)

    def visit(visits: DataFrame) -> DataFrame:
        return _visit(both.join(visits.select("piece").distinct(), "piece", "left_semi"), visits, weights, top)

    first = landed(visit(bounds.where("early").select("item", "piece", F.lit(0).cast("long").alias("floor"))), "search-first")
    floors = _best(first, top).where(F.col("rank") == top).select("item", F.col("score").alias("floor"))
    later = bounds.where("NOT early").join(F.broadcast(floors), "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("long"))).where("bound >= floor")
    found = _best(first.unionByName(visit(later.select("item", "piece", "floor"))), top)
    named = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], f"item int, item_id {id_type}")
    return found.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
