"""Shared folders, hand-over tables and joins against small tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscan.session import ensure_checkpoint_dir

#: Word separators of every contract: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of three numbers that a task can hold as a broadcast table (about 32 MB).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read to the shared folder and read it again: lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: str | Column) -> Column:
    """A-Z in lower case, every other letter as it is; lower() does the same where all characters are ASCII, and faster."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def beside(df: DataFrame, small: DataFrame, n_small: int, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table of a counted size: broadcast up to ``limit`` rows, a shuffled join beyond."""
    return df.join(F.broadcast(small) if n_small <= limit else small, on, how)
