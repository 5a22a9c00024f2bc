"""Headline timings: ``BENCH_SF_DIR`` tables on ``local[BENCH_CPUS]``; prints one JSON line.

The surfaces of a million cells are the driver's embedding matrix enlarged by whole-number interpolation until it holds
at least a million cells, so the figures can be put beside single-node ones for that many cells.
"""

from __future__ import annotations

import json
import math
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscan.operators import fill, focal, horizon
from fellscan.operators.components import label
from fellscan.plans import discovery  # noqa: F401  (declares its passes)
from fellscan.plans.registry import get_pass
from fellscan.registered import catalogue
from fellscan.registered.fixtures import fixture
from fellscan.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["relief_candidates", "r02_slope_horn", "r05_lrm", "r12_local_relief", "r10_fill_depressions", "c1_components", "g3_batch_morphometrics", "c8_eps_clusters",
            "g8_merge_clusters", "f1_fuse_lonlat", "f6_post_fuse_chain", "j1_within_distance", "j6_exclude_buildings", "j11_site_recall", "j19_unmatched", "g6_point_density",
            "g18_grid_mean", "p2_query_detections", "a13_vector_tile_rows", "i1_fold_jobs", "e2_exclusion_zones"]


def million(spark: SparkSession) -> DataFrame:
    """Each cell becomes k x k cells, rising linearly towards the next cell of its row and column."""
    d = fixture(spark, SF_DIR, "dem").select((F.substring("survey_id", 2, 9).cast("bigint") * 250 + F.col("row")).alias("r"), F.col("col").alias("c"), "z")
    n = d.count()
    k = max(1, math.ceil(math.sqrt(1_000_000 / n)))
    east = d.select("r", (F.col("c") - 1).alias("c"), F.col("z").alias("ze"))
    south = d.select((F.col("r") - 1).alias("r"), "c", F.col("z").alias("zs"))
    fine = d.join(east, ["r", "c"], "left").join(south, ["r", "c"], "left").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    z = F.col("z") * k + (F.coalesce("zs", "z") - F.col("z")) * F.col("i") + (F.coalesce("ze", "z") - F.col("z")) * F.col("j")
    return fine.select(F.lit("all").alias("survey_id"), (F.col("r") * k + F.col("i")).alias("row"), (F.col("c") * k + F.col("j")).alias("col"), (z / (100.0 * k)).alias("z"))


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("bench", CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    drain(catalogue.QUERIES["r03_tpi"](spark, SF_DIR))  # start the JVM and the Python workers
    for name in HEADLINE:
        times[name] = timed(lambda: drain(catalogue.QUERIES[name](spark, SF_DIR)))
        spark.catalog.clearCache()
    cells = million(spark).persist()
    n = cells.count()
    times["cells_1m_slope_hillshade_tpi"] = timed(lambda: drain(focal.derive(cells, ["slope", "hillshade", "tpi"])))
    times["cells_1m_local_relief"] = timed(lambda: drain(focal.local_relief(cells, 10)))
    times["cells_1m_horizon_10m"] = timed(lambda: drain(horizon.horizon(cells, 10)))
    times["cells_1m_vat_10m"] = timed(lambda: drain(horizon.vat(cells, 10)))
    times["cells_1m_components"] = timed(lambda: drain(label(cells.where("z > 0.5"))))
    times["cells_1m_fill"] = timed(lambda: drain(fill.fill_depressions(cells)))
    forms = focal.discovery_surface(cells).persist()
    times["cells_1m_discovery_surface"] = timed(lambda: forms.count())
    for name in ("raised_features", "linear_features", "enclosures", "repeated_patterns", "geological_forms"):
        times[f"cells_1m_{name}"] = timed(lambda: drain(get_pass(name)(forms, min_area_m2=20).candidates))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""), "cells": n,
                      "cells_per_sec": {k: round(n / v) for k, v in times.items() if k.startswith("cells_1m") and v > 0}}))
    spark.stop()


if __name__ == "__main__":
    main()
