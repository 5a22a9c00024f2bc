"""Mixing sources to token targets by entropy balancing.

Rates r_i of documents are the nearest to 1 in relative entropy, between 0 and 2, for which each source's sum of
r_i * size_i meets its target. The dual has one multiplier per source; its solution tilts rates exponentially,
``r_i = min(2, exp(lambda_s * size_i / mean size of s))``. Newton steps on the dual run for all sources at once, each a
join and a combinable sum over the table of (source, size, count), which is all the dual sees of the corpus; a bracket
around each multiplier turns a step that leaves it into a bisection.

Rounding: documents of one source and size share a rate, so a cell of N of them gets floor(r) copies each and k extra
ones. Going from the largest size to the smallest, k is what brings the running sum nearest to the running sum of rates,
so what large documents leave over small ones make good. The k documents are those with the smallest seeded hashes of
their ids; the k-th hash is found by ranks within buckets of the cell, so a cell with a third of all rows is still shared
out. A document's copies then depend on its source, size and id alone: reruns agree, and equal ids are treated alike.

Targets: sources in code point order, null last, weigh WEIGHTS in turn and share 150 % of all words; a target stops at
twice its source's words and the rest is shared again among the others. Null text has size 0; documents of size 0 add
nothing and keep one copy. Null sources are a source of their own. Null doc_ids share one hash. Empty tables give empty
results. Only doc_id, text and source are read; other columns are carried untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fellscan.llm.common import BROADCAST_ROWS, landed
from fellscan.llm.quality_rules import words_of
from fellscan.session import cut_lineage

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 20_240_229
TOLERANCE, MAX_STEPS, BUCKET_ROWS = 1e-7, 60, 4096


def size_of(text: Column) -> Column:
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def source_targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, smallest, mean, target, from the (source, size, n) table."""
    spark = cells.sparkSession
    sources = cells.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("n_filled")
    )
    # places in code point order, by a distributed sort
    ordered = sources.select("source").orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    places = spark.createDataFrame(ordered, f"place_source {cells.schema['source'].dataType.simpleString()}, place bigint")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = landed(sources.join(places, F.col("source").eqNullSafe(F.col("place_source"))).withColumn("weight", weight).drop("place_source", "place"), "mix-sources")
    top = F.col("source_size") * most
    level, full = 0.0, F.lit(False)
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:  # raise the level until no further source stops at its top; each round stops at least one
        capped, open_weight = sources.agg(F.coalesce(F.sum(F.when(full, top)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        level = (total - capped) / open_weight if open_weight else 0.0
        more = full | (F.col("weight") * level > top)
        if sources.where(more & ~full).isEmpty():
            break
        full = F.col("weight") * level > top
    target = F.when(full, top).otherwise(F.col("weight") * level)
    return sources.select("source", "source_size", "smallest", (F.col("source_size") / F.col("n_filled")).alias("mean"), target.cast("double").alias("target"))


def balance(cells: DataFrame, targets: DataFrame, most: float = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """targets with the multiplier ``lam`` of each source."""
    least = F.col("smallest") / F.col("mean")
    start = targets.where("source_size > 0 AND target > 0").withColumn("hi", F.lit(math.log(most)) / least).withColumn("lo", F.log(F.col("target") / F.col("source_size")) / least - 1e-9)
    at_top = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = cut_lineage(start.withColumn("lam", F.when(at_top, F.col("hi")).otherwise(F.lit(0.0))).withColumn("done", at_top))
    for _ in range(MAX_STEPS):
        u = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * u, F.lit(math.log(most))))
        words = F.col("n") * F.col("size")
        sums = (
            cells.where("size > 0").join(state.where("NOT done").select(F.col("source").alias("of"), "lam", "mean"), F.col("source").eqNullSafe(F.col("of")))
            .groupBy("of").agg(F.sum(words * rate).alias("taken"), F.sum(F.when(F.col("lam") * u < math.log(most), words * u * rate).otherwise(0.0)).alias("slope"))
        )
        step = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        off = F.col("taken") - F.col("target")
        step = step.withColumn("hi", F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(off < 0, F.col("lam")).otherwise(F.col("lo")))
        newton = F.col("lam") - off / F.col("slope")
        step = step.withColumn("next", F.when((F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2))
        met = F.col("done") | (F.abs(off) <= tolerance * F.col("target"))
        state = cut_lineage(step.withColumn("done", met).withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(F.col("next"))).select(state.columns))
        if state.where("NOT done").isEmpty():
            break
    return targets.join(state.select(F.col("source").alias("of"), "lam"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def round_cells(cells: DataFrame, balanced: DataFrame, most: float = MOST) -> DataFrame:
    """cells with ``base`` copies and ``extra`` documents that get one more. A group is a source's different sizes."""

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        size, n, lam = pdf["size"].to_numpy(float), pdf["n"].to_numpy(), pdf["lam"].to_numpy(float)
        with np.errstate(invalid="ignore"):
            rate = np.where(size > 0, np.where(np.isnan(lam), 0.0, np.exp(np.minimum(lam * size / pdf["mean"].to_numpy(float), math.log(most)))), 1.0)
        rate = np.where(rate >= most * (1 - 1e-9), most, rate)
        base = np.floor(rate)
        extra, owed = np.zeros(len(pdf), np.int64), 0.0
        for i in range(len(pdf)):
            if size[i] > 0:
                owed += (rate[i] - base[i]) * n[i] * size[i]
                extra[i] = min(max(math.floor(owed / size[i] + 0.5), 0), n[i]) if base[i] < most else 0
                owed -= extra[i] * size[i]
        return pdf.assign(base=base.astype(np.int64), extra=extra)[["source", "size", "n", "base", "extra", "source_size", "target"]]

    kind = cells.schema["source"].dataType.simpleString()
    wide = cells.join(balanced.select(F.col("source").alias("of"), "source_size", "target", "mean", "lam"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return wide.groupBy("source").applyInPandas(spread, f"source {kind}, size bigint, n bigint, base bigint, extra bigint, source_size bigint, target double")


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"))


def copy_plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per (source, size): n, source_size, target, base copies, and the hash up to which a document gets one more."""
    rows = landed(docs.select("source", size_of(F.col("text")).alias("size"), _hash(seed).alias("h")), "mix-sizes")
    cells = landed(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    targets = landed(source_targets(cells), "mix-targets")
    plan = landed(round_cells(cells, balance(cells, targets)), "mix-plan")
    some = plan.where("extra > 0 AND extra < n").select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n", "extra")
    on = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    cell = ["source", "size"]
    # buckets are ranges of the hash, so their order is the order of hashes
    span = F.ceil(F.col("n") / BUCKET_ROWS)
    bucket = F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * span), span - 1)
    ranked = rows.join(some, on).withColumn("bucket", bucket).select(*cell, "h", "extra", "bucket")
    counts = ranked.groupBy(*cell, "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b"), "before", "c")
    here = ranked.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b")))
    here = here.where("extra > before AND extra <= before + c")
    rank = F.row_number().over(Window.partitionBy(*cell, "bucket").orderBy("h"))
    cut = here.withColumn("rank", rank).where("rank = extra - before").select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("h").alias("last_hash"))
    out = plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")), "left")
    last = F.when(F.col("extra") == 0, F.lit(None).cast("long")).when(F.col("extra") == F.col("n"), F.lit(2**63 - 1)).otherwise(F.col("last_hash"))
    return landed(out.select("source", "size", "n", "base", last.alias("last_hash"), "source_size", "target"), "mix-copies")


def with_copies(docs: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """docs as a struct ``row``, with size, source_size, target and copies."""
    p = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "base", "last_hash", "source_size", "target")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(row.alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"), _hash(seed).alias("h"))
    joined = rows.join(F.broadcast(p) if plan.count() <= BROADCAST_ROWS else p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    copies = F.col("base") + F.when(F.col("h") <= F.col("last_hash"), 1).otherwise(0)
    return joined.select("row", "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    out = with_copies(docs.select("doc_id", "source", "text"), copy_plan(docs, seed), seed)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it has copies."""
    out = with_copies(docs, copy_plan(docs, seed), seed).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*").toDF(*docs.columns)
