"""Packing by powers of two: a document's ids are cut into pieces of binary lengths, equal lengths share a bucket.

A document of n ids (its end id included) gives as many pieces of ``max_tokens`` (a power of two) as fit, then one piece
for each set bit of the rest, the longest first. Each piece is a sequence of its own, so no sequence crosses documents,
none needs padding, and a batch of any bucket is a plain matrix.

A store is a folder with two Parquet tables, written and read by Spark alone:

``sequences``  partitioned by ``length``; part, seq (place in its bucket within the part), doc_id, start (ids of the
               document before the piece), doc_tokens, ids (binary, little-endian, ``width`` bytes an id), width.
``firsts``     length, part, first: the sequence_id of the first sequence that ``part`` has in this bucket. Numbers run
               without gaps, bucket after bucket, so a bucket is a range of sequence_ids.

Cutting is a map over the rows without a shuffle: a piece depends on its document alone, so neither a hot source nor a
group of copies meets in one task, and memory is one batch. A task that is run again writes the same pieces; numbers come
from the files, so lineage ends there. Only counts of (bucket, part) are summed over all data, at most 32 rows a part.

Null text counts as empty and gives one piece, the end id. Null or repeated doc_ids and equal rows keep their own pieces.
Very long texts give more pieces of ``max_tokens``. An empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fellscan.llm import pretokens
from fellscan.llm.common import BROADCAST_ROWS, beside

MAX_TOKENS, END_ID = 2048, 1


def binary_lengths(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Lengths of the pieces of n ids, in order."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


_tables: dict = {}


def _encoder(path: str, end_id: int):
    """text -> ids with the end id as bytes, and the bytes of an id: 2 where the vocabulary fits."""
    if path not in _tables:
        width = 2 if pretokens.tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        _tables[path] = (pretokens.WordTable(path, lambda ids: np.array(ids, f"<u{width}").tobytes(), b"".join), width)
    table, width = _tables[path]
    if end_id >= 1 << 8 * width:
        raise ValueError(f"end id {end_id} does not fit {width} bytes")
    last = end_id.to_bytes(width, "little")
    return lambda text: table.text(text) + last, width


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """length, part, seq, doc_id, start, doc_tokens, width, ids of every piece."""
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens has to be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * max_tokens.bit_length()
        encode, width = _encoder(path, end_id)
        for pdf in batches:
            place, length, seq, start, total, ids = [], [], [], [], [], []
            for row, text in enumerate(pdf["text"]):
                data, at = encode(text), 0
                n = len(data) // width
                for size in binary_lengths(n, max_tokens):
                    bucket = size.bit_length() - 1
                    place.append(row)
                    length.append(size)
                    seq.append(seen[bucket])
                    start.append(at)
                    total.append(n)
                    ids.append(data[at * width : (at + size) * width])
                    seen[bucket] += 1
                    at += size
            yield pd.DataFrame({"length": length, "part": part, "seq": seq, "doc_id": pdf["doc_id"].take(place).reset_index(drop=True), "start": start, "doc_tokens": total, "width": width, "ids": ids})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, f"length int, part int, seq bigint, doc_id {kind}, start bigint, doc_tokens bigint, width int, ids binary")


def write_sequences(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, max_tokens: int = MAX_TOKENS) -> None:
    """Cut every document and write the store; only counts are shuffled."""
    spark = docs.sparkSession
    cut = pieces(docs, path, end_id, max_tokens)
    cut.write.partitionBy("length").parquet(f"{folder}/sequences")
    counts = _sequences(spark, folder, cut).groupBy("length", "part").count()
    # two running sums: over the few buckets, and over the parts of each
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = counts.groupBy("length").agg(F.sum("count").alias("n")).select("length", before(Window.orderBy("length")).alias("bucket_first"))
    within = counts.withColumnRenamed("count", "n").withColumn("in_bucket", before(Window.partitionBy("length").orderBy("part")))
    within.join(F.broadcast(buckets), "length").select("length", "part", (F.col("bucket_first") + F.col("in_bucket")).alias("first")).write.parquet(f"{folder}/firsts")


def _sequences(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(f"{folder}/sequences")


def read_sequences(spark: SparkSession, folder: str, doc_id: str = "bigint") -> DataFrame:
    """sequence_id, length, doc_id, start, doc_tokens, width, ids of every sequence; a filter on length reads its bucket only."""
    kinds = f"length int, part int, seq bigint, doc_id {doc_id}, start bigint, doc_tokens bigint, width int, ids binary"
    firsts = spark.read.schema("length int, part int, first bigint").parquet(f"{folder}/firsts")
    rows = spark.read.schema(kinds).parquet(f"{folder}/sequences")
    joined = beside(rows, firsts, firsts.count(), ["length", "part"], limit=BROADCAST_ROWS)
    return joined.select((F.col("first") + F.col("seq")).alias("sequence_id"), "length", "doc_id", "start", "doc_tokens", "width", "ids")


def described(sequences: DataFrame) -> DataFrame:
    """One row a piece as the store has it: where it stands in its document and its sequence, and a checksum of its ids."""

    def sums(batches):
        for pdf in batches:
            ids = [np.frombuffer(d, f"<u{w}").astype("<u4") for d, w in zip(pdf["ids"], pdf["width"])]
            yield pd.DataFrame({**{c: pdf[c] for c in ("doc_id", "start")}, "length": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids], "doc_tokens": pdf["doc_tokens"], "sequence_id": pdf["sequence_id"], "offset": 0})

    kind = sequences.schema["doc_id"].dataType.simpleString()
    return sequences.mapInPandas(sums, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
