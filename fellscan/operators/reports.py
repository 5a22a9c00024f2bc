"""Summaries over operational tables: timings, latency, storage, jobs, retention, densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellscan.operators.quantiles import exact_quantile

# Storage categories by path below the data folder, first match wins; what matches none is "other".
CATEGORIES = [("raw", r"^raw/"), ("dem", r"(_|/)dem\.tif$"), ("hillshade", "hillshade"), ("derivatives", "derivatives")]


def stage_profile(timings: DataFrame, seconds: str = "elapsed_s") -> DataFrame:
    """Total, count and share of the whole per (parent, stage), plus the rank of each stage inside its parent."""
    per = timings.groupBy("parent", "stage").agg(F.sum(seconds).alias("total_s"), F.count("*").alias("calls"))
    whole = Window.partitionBy()  # over one row per stage, not over the timings
    inside = Window.partitionBy("parent").orderBy(F.desc("total_s"), "stage")
    return per.withColumn("pct", 100 * F.col("total_s") / F.sum("total_s").over(whole)).withColumn("rank", F.row_number().over(inside))


def latency_summary(runs: DataFrame, by: str = "layer", ms: str = "ms") -> DataFrame:
    """p50 and p95 (interpolated) and counts per layer; ``transparent`` counts empty tiles when the runs say so."""
    extra = [F.count_if("transparent").alias("transparent")] if "transparent" in runs.columns else []
    base = runs.groupBy(by).agg(F.count("*").alias("n"), F.max(ms).alias("max_ms"), *extra)
    return base.join(exact_quantile(runs, [by], ms, 0.5, "p50"), by).join(exact_quantile(runs, [by], ms, 0.95, "p95"), by)


def same_identity(runs: DataFrame, key: list[str], digest: str = "digest") -> DataFrame:
    """Cold and warm renders of one tile must agree: keys whose digests differ."""
    return runs.groupBy(*key).agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").select(*key)


def storage_breakdown(files: DataFrame, cap_bytes: float, root: str = "", categories: list[tuple[str, str]] = CATEGORIES) -> DataFrame:
    """Bytes and files per category (a pattern of the path below ``root``) and their share of the cap; empty ones included.

    One global aggregate of conditional sums. A null path is "other", a null size counts no bytes.
    """
    path = F.coalesce("path", F.lit(""))
    if root:
        base = root.rstrip("/") + "/"
        path = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1_000_000)).otherwise(path)
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(categories):
        kind = F.when(F.col("_p").rlike(pattern), name).otherwise(kind)
    named = files.select("size_bytes", path.alias("_p")).select("size_bytes", F.coalesce(kind, F.lit("other")).alias("category"))
    names = [name for name, _ in categories] + ["other"]
    is_ = [F.col("category") == name for name in names]
    aggs = [F.coalesce(F.sum(F.when(c, F.col("size_bytes"))), F.lit(0)).alias(f"b{i}") for i, c in enumerate(is_)] + [F.count_if(c).alias(f"n{i}") for i, c in enumerate(is_)]
    rows = [F.struct(F.lit(name).alias("category"), F.col(f"b{i}").alias("bytes"), F.col(f"n{i}").alias("files")) for i, name in enumerate(names)]
    return named.agg(*aggs).select(F.inline(F.array(*rows))).withColumn("pct_of_cap", 100 * F.col("bytes") / cap_bytes)


def job_outcome(results: DataFrame) -> DataFrame:
    """Per job: ok and failed tiles, and the status (failed only when every tile failed)."""
    ok = F.count_if(F.col("error_type").isNull())
    return results.groupBy("job_id").agg(ok.alias("ok"), (F.count("*") - ok).alias("failed"), F.when(ok == 0, "failed").otherwise("completed").alias("status"))


def job_errors(results: DataFrame) -> DataFrame:
    """Failures per job and error type."""
    return results.where(F.col("error_type").isNotNull()).groupBy("job_id", "error_type").agg(F.count("*").alias("n"))


def first_errors(results: DataFrame, n: int = 5, order: str = "seq") -> DataFrame:
    """The first ``n`` failures of each job; the rank limit is applied before the exchange too."""
    w = Window.partitionBy("job_id").orderBy(order)
    return results.where(F.col("error_type").isNotNull()).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def top_types(det: DataFrame, n: int = 3) -> DataFrame:
    return det.groupBy("feature_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature_type").limit(n)


def heat_grid(det: DataFrame, cell_deg: float = 0.01) -> DataFrame:
    """Confidence-weighted density on a lon/lat grid."""
    at = lambda c: F.floor(F.col(c) / cell_deg)
    return det.groupBy(at("lon").alias("gx"), at("lat").alias("gy")).agg(F.sum("confidence").alias("weight"), F.count("*").alias("n"))


def retention_plan(files: DataFrame, max_age_days: float = 30, max_bytes: float = 700e9, buckets: int = 4096) -> DataFrame:
    """Files with ``evict``: ``age`` when older than the limit, ``cap`` for the oldest ones still needed to get under the cap, else null.

    Eviction goes by age, oldest first (``age_days`` may have fractions); files of one age go by a hash of their path. The
    last file to go is found by narrowing: sums per day, per part of the day it falls in, per age in that part, per hash
    bucket of that age, per path in that bucket. Each round keeps a running sum over its few groups and hands on one of
    them, so nothing is sorted as a whole; one comparison with that file then marks every row. A null age is the newest.
    """
    age = F.coalesce(F.col("age_days").cast("double"), F.lit(0.0))
    old, path = F.coalesce(F.col("age_days") > max_age_days, F.lit(False)), F.coalesce("path", F.lit(""))
    part = -F.floor((age - F.floor(age)) * buckets)
    keys = {"_day": -F.floor(age), "_part": part, "_age": F.lit(0.0) - age, "_hash": F.pmod(F.xxhash64(path), F.lit(buckets)).cast("long"), "_path": path}
    left = files.where(~old).select(F.coalesce("size_bytes", F.lit(0)).alias("_size"), *[c.alias(k) for k, c in keys.items()])
    over = (left.agg(F.sum("_size")).first()[0] or 0) - max_bytes
    last = {}
    for k in keys if over > 0 else []:
        sums = left.groupBy(k).agg(F.sum("_size").alias("_bytes"))
        sums = sums.withColumn("_before", F.sum("_bytes").over(Window.orderBy(k)) - F.col("_bytes"))
        last[k], before = sums.where((F.col("_before") < over) & (F.col("_before") + F.col("_bytes") >= over)).orderBy(k).select(k, "_before").first()
        over, left = over - before, left.where(F.col(k) == last[k])
    order = ["_age", "_hash", "_path"]
    types = {f.name: f.dataType for f in left.schema}
    gone = F.struct(*[keys[k].alias(k) for k in order]) <= F.struct(*[F.lit(last[k]).cast(types[k]).alias(k) for k in order]) if last else F.lit(False)
    return files.withColumn("evict", F.when(old, "age").when(gone, "cap"))


def retention_summary(plan: DataFrame) -> DataFrame:
    size = F.col("size_bytes")
    gone = F.col("evict").isNotNull()
    return plan.agg(
        F.count("*").alias("files_scanned"), F.sum(size).alias("bytes_before"), F.coalesce(F.sum(F.when(gone, size)), F.lit(0)).alias("freed_bytes"),
        F.count_if(gone).alias("deleted_files"), F.count_if(F.col("evict") == "age").alias("age_evicted"), F.count_if(F.col("evict") == "cap").alias("cap_evicted"))


def duplicate_keys(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")
