"""Logical tables over the driver's parquet files, each stated once for Spark and once for DuckDB.

Where both engines read the same text it is written once. Every fixture covers its whole source table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]

BOTH: dict[str, str] = {
    # deliberately mixed eligibility, keyed by nation
    "survey": """SELECT concat('src', CAST(n_nationkey AS STRING)) AS source_id, concat('k', CAST(n_nationkey % 3 AS STRING)) AS survey_key,
        CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE 'NAVD88' END AS datum,
        CASE WHEN n_nationkey % 11 = 5 THEN 3857 WHEN n_nationkey % 11 = 7 THEN 4326 ELSE 26917 END AS epsg,
        CAST(CASE WHEN n_nationkey % 5 = 0 THEN 2.0 WHEN n_nationkey = 13 THEN 6.0 ELSE 1.0 END AS DOUBLE) AS dx,
        CAST(CASE WHEN n_nationkey % 5 = 0 THEN 2.0 WHEN n_nationkey = 13 THEN 6.0 ELSE 1.0 END AS DOUBLE) AS dy,
        CASE WHEN n_nationkey % 8 = 3 THEN 'ft' WHEN n_nationkey % 8 = 4 THEN '' ELSE 'm' END AS units,
        CAST(500000 + 64 * n_nationkey + (CASE WHEN n_nationkey % 9 = 2 THEN 0.5 ELSE 0 END) AS DOUBLE) AS x0, CAST(4480000 AS DOUBLE) AS y0,
        CAST(1 AS DOUBLE) AS scale, CAST(0 AS DOUBLE) AS "offset", CAST(1 + n_nationkey % 5 AS DOUBLE) AS resolution_m,
        concat('dem/', n_name) AS path FROM {nation}""",
    "points": """SELECT CAST(l_partkey % 500 AS DOUBLE) AS x, CAST((l_suppkey * 7 + l_orderkey) % 500 AS DOUBLE) AS y,
        CAST(round(l_extendedprice / 1e2) AS DOUBLE) AS z, CAST(l_linenumber AS INT) AS return_number,
        CASE WHEN (l_partkey * 7 + l_orderkey) % 3 = 0 THEN 2 ELSE 1 END AS number_of_returns, CAST(l_quantity AS INT) % 8 AS classification,
        concat('p', CAST(l_suppkey % 2 AS STRING)) AS survey_id FROM {lineitem}""",
    "cand": """SELECT l_orderkey * 8 + l_linenumber AS cand_id, concat('t', CAST(l_suppkey % 10 AS STRING)) AS tile_id,
        CASE l_linenumber WHEN 1 THEN 'fill_difference' WHEN 2 THEN 'local_relief_model' WHEN 3 THEN 'tpi' WHEN 4 THEN 'curvature'
          WHEN 5 THEN 'sky_view_factor' WHEN 6 THEN 'point_density' ELSE 'morphometric_filter' END AS pass_name,
        -80 + (l_partkey % 400) / 1e3 AS lon, 40 + (l_orderkey % 400) / 1e3 AS lat,
        CAST((l_partkey * 13) % 20000 AS BIGINT) AS mx, CAST((l_orderkey * 7) % 20000 AS BIGINT) AS my,
        CAST(round(l_discount * 100) AS INT) / 1e1 AS score,
        CASE WHEN l_suppkey % 3 = 0 THEN 'sinkhole' WHEN l_suppkey % 3 = 1 THEN 'depression' ELSE 'cave_entrance' END AS feature_type,
        CAST(round(l_tax * 100) AS INT) / 2e0 AS depth_m, CAST(l_quantity * 10 AS DOUBLE) AS area_m2,
        ((l_partkey * 31 + l_orderkey) % 100) / 1e2 AS circularity, ((l_partkey * 17 + l_suppkey) % 100) / 1e2 AS elongation
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, max(l_discount) AS l_discount,
                     max(l_tax) AS l_tax, max(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber) q""",
    "detections": """SELECT event_id AS id, -80 + (user_id * 37 % 1000) / 1e3 AS lon, 40 + (event_id * 13 % 1000) / 1e3 AS lat,
        CASE event_type WHEN 'view' THEN 'sinkhole' WHEN 'click' THEN 'depression' WHEN 'error' THEN 'mine_portal'
          WHEN 'purchase' THEN 'cave_entrance' ELSE 'mound' END AS feature_type,
        least(round(value, 2) / 1e2, 1.0) AS confidence, ts AS created_at, props,
        concat('["', CASE WHEN event_id % 3 = 0 THEN 'tpi' ELSE 'fill_difference' END, '"]') AS source_passes,
        CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 1 THEN false END AS validated,
        CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE round(value, 2) / 1e1 END AS depth_m, round(value, 2) * 3e0 AS area_m2
        FROM {events}""",
    "sites": """SELECT c_custkey AS site_id, c_name AS name, -80 + (c_custkey * 29 % 1000) / 1e3 AS lon, 40 + (c_custkey * 53 % 1000) / 1e3 AS lat,
        CASE c_mktsegment WHEN 'MACHINERY' THEN 'mine_portal' WHEN 'BUILDING' THEN 'sinkhole' ELSE 'depression' END AS feature_type,
        concat('src', CAST(c_nationkey % 10 AS STRING)) AS source FROM {customer}""",
    "footprints": """SELECT p_partkey AS id, CASE WHEN p_type = 'ECONOMY' THEN 'cemetery' ELSE 'building' END AS kind,
        -80 + (p_partkey * 7 % 400) / 1e3 - p_size / 2e4 AS west, 40 + (p_partkey * 11 % 400) / 1e3 - p_size / 2e4 AS south,
        -80 + (p_partkey * 7 % 400) / 1e3 + p_size / 2e4 AS east, 40 + (p_partkey * 11 % 400) / 1e3 + p_size / 2e4 AS north FROM {part}""",
    "tile_index": """SELECT o_orderkey AS tile_id, -80 + (o_orderkey * 17 % 2000) / 1e3 AS west, 39 + (o_custkey * 31 % 2000) / 1e3 AS south,
        -80 + (o_orderkey * 17 % 2000) / 1e3 + 0.0107 AS east, 39 + (o_custkey * 31 % 2000) / 1e3 + 0.0107 AS north,
        CAST(year(o_orderdate) AS INT) AS year, CASE o_orderstatus WHEN 'F' THEN 'copc' ELSE 'laz' END AS format,
        concat('https://tiles/', CAST(o_orderkey % 5000 AS STRING), '.laz') AS url, o_orderpriority AS priority FROM {orders}""",
    "job_events": """SELECT concat('job', CAST(user_id AS STRING)) AS job_id, event_id AS seq, ts,
        CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 50 = 3 THEN 'completed' ELSE 'running' END
          WHEN 'error' THEN CASE WHEN event_id % 60 = 7 THEN 'failed' ELSE 'running' END WHEN 'signup' THEN 'pending' ELSE 'running' END AS status,
        CAST(round(value) AS INT) AS progress, concat('stage', CAST(event_id % 6 AS STRING)) AS stage FROM {events}""",
    "verdicts": """SELECT event_id % 1000 AS detection_id, event_id AS seq, ts,
        CASE event_type WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'CONFIRMED' ELSE 'uncertain' END AS verdict, props AS notes FROM {events}""",
    "pass_results": """SELECT l_orderkey AS detection_id, l_linenumber AS ord, concat('pass', CAST(l_linenumber AS STRING)) AS pass_name, l_discount AS raw_score FROM {lineitem}""",
    "files": """SELECT doc_id AS file_id, concat('/data/', source, '/', lang, '/', CAST(doc_id AS STRING), '.tif') AS path, n_chars * 1000 AS size_bytes,
        CAST((doc_id * 7919) % 100 AS INT) AS age_days FROM {documents}""",
    "timings": """SELECT event_type AS parent, concat('stage', CAST(user_id % 10 AS STRING)) AS stage, CAST(round(value * 100) AS BIGINT) AS ms FROM {events}""",
    "segments": """SELECT s_suppkey AS seg_id, CASE s_nationkey % 4 WHEN 0 THEN 'road' WHEN 1 THEN 'water' WHEN 2 THEN 'rail' ELSE 'landuse' END AS layer,
        CAST((s_suppkey * 37) % 250 AS DOUBLE) AS x1, CAST((s_suppkey * 53) % 250 AS DOUBLE) AS y1,
        CAST((s_suppkey * 37) % 250 + 20 AS DOUBLE) AS x2, CAST((s_suppkey * 53) % 250 + 5 AS DOUBLE) AS y2 FROM {supplier}""",
}

PAIRED: dict[str, tuple[str, str]] = {
    # the embedding matrix as integer elevations: one survey per 250 vectors, one grid line per vector
    "dem": (
        """SELECT concat('s', CAST(vec_id DIV 250 AS STRING)) AS survey_id, vec_id % 250 AS row, CAST(pos AS BIGINT) AS col,
           CAST(round(1000 * CAST(v AS DOUBLE)) AS BIGINT) AS z FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, v""",
        """SELECT concat('s', CAST(vec_id // 250 AS VARCHAR)) AS survey_id, vec_id % 250 AS "row", CAST(pos - 1 AS BIGINT) AS col,
           CAST(round(1000 * CAST(v AS DOUBLE)) AS BIGINT) AS z
           FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM {embeddings})""",
    ),
}
# a smoother surface: 5x5 block sums of the matrix, so thresholded regions have some extent
SMOOTH = """SELECT a.survey_id, a."row", a.col, CAST(sum(b.z) AS BIGINT) AS z FROM dem a JOIN dem b ON a.survey_id = b.survey_id
    AND b."row" BETWEEN a."row" - 2 AND a."row" + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2, 3"""


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "holes":
        return fixture(spark, sf_dir, "dem").where("(row * 31 + col * 17) % 97 <> 0")
    if name == "smooth":
        return smooth(fixture(spark, sf_dir, "dem"))
    text = PAIRED[name][0] if name in PAIRED else BOTH[name]
    text = text.replace('"offset"', "`offset`")
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def smooth(dem: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    from fellscan.operators.blocks import owned, tiled
    from fellscan.operators.focal import box_stats

    boxed = owned(box_stats(tiled(dem, 2), "z", 2, 2, "b"))
    return boxed.select("survey_id", "row", "col", F.col("b_sum").cast("bigint").alias("z"))


def ctes(*names: str) -> str:
    """DuckDB ``WITH`` members for the fixtures, in dependency order."""
    parts = []
    for name in names:
        if name == "holes":
            body = 'SELECT * FROM dem WHERE ("row" * 31 + col * 17) % 97 <> 0'
        elif name == "smooth":
            body = SMOOTH
        else:
            body = PAIRED[name][1] if name in PAIRED else BOTH[name]
            body = re.sub(r"\{(\w+)\}", r"\1", body).replace("AS STRING", "AS VARCHAR")
        parts.append(f"{name} AS MATERIALIZED ({body})")
    return ",\n".join(parts)


def nine(source: str, name: str = "nb", col: str = "z") -> str:
    """A CTE joining each cell to its eight neighbours: na..ni as doubles, null when absent."""
    letters = "abcdefghi"
    joins, cols = [], []
    for i, k in enumerate(letters):
        dr, dc = i // 3 - 1, i % 3 - 1
        if k == "e":
            cols.append(f"CAST(e.{col} AS DOUBLE) AS ne")
            continue
        joins.append(f'LEFT JOIN {source} {k} ON {k}.survey_id = e.survey_id AND {k}."row" = e."row" + ({dr}) AND {k}.col = e.col + ({dc})')
        cols.append(f"CAST({k}.{col} AS DOUBLE) AS n{k}")
    return f'{name} AS MATERIALIZED (SELECT e.*, {", ".join(cols)} FROM {source} e {" ".join(joins)})'


def components(mask: str, name: str = "lab") -> str:
    """A recursive CTE labelling a (survey_id, row, col) mask: region_id = smallest packed cell, 4-connected."""
    pk = '"row" * 4294967296 + col'
    return f"""{name}_e AS MATERIALIZED (SELECT a.survey_id, a."row" * 4294967296 + a.col AS u, b."row" * 4294967296 + b.col AS v FROM {mask} a JOIN {mask} b
      ON a.survey_id = b.survey_id AND ((b."row" = a."row" AND abs(b.col - a.col) = 1) OR (b.col = a.col AND abs(b."row" - a."row") = 1))),
    {name}_r(survey_id, u, root) USING KEY (survey_id, u) AS (SELECT survey_id, {pk}, {pk} FROM {mask}
      UNION SELECT e.survey_id, e.v, min(r.root) FROM {name}_r r JOIN {name}_e e ON e.survey_id = r.survey_id AND e.u = r.u
        JOIN recurring.{name}_r old ON old.survey_id = e.survey_id AND old.u = e.v WHERE r.root < old.root GROUP BY e.survey_id, e.v),
    {name} AS MATERIALIZED (SELECT m.*, r.root AS region_id FROM {mask} m JOIN {name}_r r ON r.survey_id = m.survey_id AND r.u = m."row" * 4294967296 + m.col)"""
