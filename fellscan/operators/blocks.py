"""Halo blocks: the one exchange every neighbourhood operator shares.

A surface is a cell table ``(survey_id, row, col, z, ...)``; an absent row is missing ground. ``tiled`` copies the few
cells near a block edge into the neighbouring blocks and hash-partitions by block, so any number of row-wise and
column-wise windows inside a block run without a further shuffle, and no window partition is longer than
``block + 2 * halo`` cells however wide the survey is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 256
KEYS = ["survey_id", "row", "col"]
BLOCK_KEYS = ["survey_id", "_br", "_bc"]


def block_of(index: str | Column, block: int = BLOCK) -> Column:
    col = F.col(index) if isinstance(index, str) else index
    return F.floor(col / F.lit(block)).cast("int")


def tiled(cells: DataFrame, halo: int, block: int = BLOCK, exchange: bool = True) -> DataFrame:
    """Add block ids ``_br, _bc`` and ``_own``; cells within ``halo`` of a block edge appear in each block they serve."""
    def span(axis: str) -> Column:
        return F.sequence(block_of(F.col(axis) - halo, block), block_of(F.col(axis) + halo, block))

    out = cells.withColumn("_br", F.explode(span("row"))).withColumn("_bc", F.explode(span("col")))
    out = out.withColumn("_own", (F.col("_br") == block_of("row", block)) & (F.col("_bc") == block_of("col", block)))
    return out.repartition(*BLOCK_KEYS) if exchange else out


def owned(df: DataFrame) -> DataFrame:
    """Drop the halo copies and the block columns."""
    return df.where("_own").drop("_br", "_bc", "_own")


def along_row() -> WindowSpec:
    return Window.partitionBy(*BLOCK_KEYS, "row").orderBy("col")


def along_col() -> WindowSpec:
    return Window.partitionBy(*BLOCK_KEYS, "col").orderBy("row")


def pack(row: str | Column = "row", col: str | Column = "col") -> Column:
    """One bigint per lattice cell; orders by row, then column (both below 2**31)."""
    r = F.col(row) if isinstance(row, str) else row
    c = F.col(col) if isinstance(col, str) else col
    return r.cast("bigint") * F.lit(4294967296) + c.cast("bigint")
