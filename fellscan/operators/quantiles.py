"""Exact interpolated quantiles of very large groups without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellscan.session import hold

BINS = 1024


DIRECT = 100_000  # groups with at most this many distinct values (under 2 MB of buffer) go straight to ``percentile``


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str, rounds: int = 2, direct: int = DIRECT) -> DataFrame:
    """``keys + [out]``: linear interpolation between order statistics, as ``percentile`` gives.

    Values are counted first, so ties weigh nothing. Groups with many distinct values are cut into bins of their own
    range and only the bins holding the wanted ranks go on, ``rounds`` times, before the last few are ranked.
    """
    have = hold(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")))
    large = have.groupBy(*keys).agg(F.count("*").alias("_k")).where(F.col("_k") > direct).select(*keys)
    plain = lambda d: d.groupBy(*keys).agg(F.percentile("_v", q, F.col("_n")).alias(out))
    if large.isEmpty():
        return plain(have)
    large = hold(large)
    return plain(have.join(large, keys, "left_anti")).unionByName(_narrowed(have.join(large, keys, "left_semi"), keys, q, out, rounds))


def _narrowed(have: DataFrame, keys: list[str], q: float, out: str, rounds: int) -> DataFrame:
    total = have.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    rank = (F.col("_total") - 1) * F.lit(q)
    need = total.select(*keys, F.floor(rank).alias("_lo"), F.ceil(rank).alias("_hi"), (rank - F.floor(rank)).alias("_part"), F.lit(0).cast("bigint").alias("_skip"))
    for _ in range(rounds):
        span = have.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        width = F.when(F.col("_b") > F.col("_a"), (F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * BINS).otherwise(F.lit(0.0))
        binned = have.join(span, keys).withColumn("_bin", F.least(F.floor(width), F.lit(BINS - 1)).cast("int")).drop("_a", "_b")
        counts = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m"))
        w = Window.partitionBy(*keys).orderBy("_bin")  # at most BINS rows per group
        upto = counts.withColumn("_end", F.sum("_m").over(w)).withColumn("_start", F.col("_end") - F.col("_m")).join(need, keys)
        hit = upto.where((F.col("_end") > F.col("_lo") - F.col("_skip")) & (F.col("_start") <= F.col("_hi") - F.col("_skip")))
        hit = hold(hit)
        have = hold(binned.join(hit.select(*keys, "_bin"), [*keys, "_bin"], "left_semi").drop("_bin"))
        first = hit.groupBy(*keys).agg(F.min("_start").alias("_s"))
        need = need.join(first, keys).select(*keys, "_lo", "_hi", "_part", (F.col("_skip") + F.col("_s")).alias("_skip"))
    w = Window.partitionBy(*keys).orderBy("_v")
    placed = have.join(need, keys).withColumn("_end", F.sum("_n").over(w) + F.col("_skip")).withColumn("_start", F.col("_end") - F.col("_n"))
    pick = lambda k: F.max(F.when((F.col("_start") <= F.col(k)) & (F.col("_end") > F.col(k)), F.col("_v")))
    return placed.groupBy(*keys).agg(pick("_lo").alias("_l"), pick("_hi").alias("_h"), F.max("_part").alias("_p")).select(
        *keys, (F.col("_l") + (F.col("_h") - F.col("_l")) * F.col("_p")).alias(out))
