"""Token ids in a binary store: concatenated ids, document boundaries and document ids in Elias-Fano form.

A store is a folder with two Parquet tables, written and read by Spark alone, so it may lie in any file system Spark knows,
and task commits keep it whole when executors are lost.

``segments``  part, seq, n_docs, n_ids, payload (binary): documents in ascending doc_id order (null first), each whole in
              one segment; a segment closes at SEGMENT_IDS ids.
``index``     part, seq, first_id: where the segment's ids begin in the whole array.

payload, little-endian: magic ``EFT1``; width of an id in bytes (u4; 2 where the vocabulary fits); n_docs, n_null (u8);
lowest doc_id (i8); boundaries; doc_ids; ids. Boundaries are the running sums of document lengths, doc_ids the
differences from the lowest, both monotone, each as an Elias-Fano block: n, universe (u8), low bits per value (u4),
select step (u4), packed low bits, unary high bits, and a select table with the bit position of every 256th set bit.
``select(i)`` starts at the table's entry and counts at most 256 set bits on, then joins high and low part: an offset
costs a few bytes' work and the block about 2 + log2(universe / n) bits a value, with no table of 64-bit offsets.

Null text counts as empty and still gets its end id. Null doc_ids come first; rows with equal doc_id all stay, in an order
set by their text. An empty table gives an empty store. Very long documents make a segment of their own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fellscan.llm import pretokens
from fellscan.llm.common import BROADCAST_ROWS

SEGMENT_IDS, SELECT_STEP, MAGIC = 1 << 20, 256, b"EFT1"
SEGMENT_TYPE = "part int, seq int, n_docs bigint, n_ids bigint, payload binary"


def ef_encode(values: np.ndarray) -> bytes:
    """Elias-Fano block of a non-decreasing array of numbers from 0."""
    v = values.astype(np.uint64)
    n, universe = len(v), int(v[-1]) + 1 if len(v) else 1
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()
    places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    low, high = np.packbits(bits, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()
    table = places[::SELECT_STEP].astype("<u4").tobytes()
    return struct.pack("<QQIIQQQ", n, universe, low_bits, SELECT_STEP, len(low), len(high), len(table)) + low + high + table


class EliasFano:
    """Reads a block in place; ``end`` is where it stops in the buffer."""

    def __init__(self, buffer: bytes, at: int = 0):
        self.n, self.universe, self.low_bits, self.step, a, b, c = struct.unpack_from("<QQIIQQQ", buffer, at)
        at += struct.calcsize("<QQIIQQQ")
        self.low = np.frombuffer(buffer, np.uint8, a, at)
        self.high = np.frombuffer(buffer, np.uint8, b, at + a)
        self.table = np.frombuffer(buffer, "<u4", c // 4, at + a + b)
        self.end = at + a + b + c

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= (self.low[bit >> 3] >> (bit & 7) & 1).astype(np.int64) << k
        return out

    def select(self, i: int) -> int:
        """The i-th value, by way of the select table."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.table[i // self.step]), i % self.step
        byte = place >> 3
        bits = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (here := bits.bit_count()) <= left:
            left, byte = left - here, byte + 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | int(self._lows(np.array([i]))[0])

    def values(self) -> np.ndarray:
        i = np.arange(self.n, dtype=np.int64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (places - i) << self.low_bits | self._lows(i)


def pack_segment(doc_ids: list, lengths: list[int], ids: bytes, width: int) -> bytes:
    """Payload of documents in order; null doc_ids stand first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    low = int(known[0]) if len(known) else 0
    gaps = known.view(np.uint64) - np.uint64(low & (1 << 64) - 1)
    head = MAGIC + struct.pack("<IQQq", width, len(doc_ids), len(doc_ids) - len(known), low)
    return head + ef_encode(np.cumsum(lengths, dtype=np.int64)) + ef_encode(gaps) + ids


class Segment:
    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        self.width, self.n_docs, self.n_null, self.low = struct.unpack_from("<IQQq", payload, 4)
        self.ends = EliasFano(payload, 4 + struct.calcsize("<IQQq"))
        self.names = EliasFano(payload, self.ends.end)
        self.ids = np.frombuffer(payload, f"<u{self.width}", offset=self.names.end)

    def doc_ids(self) -> list:
        return [None] * self.n_null + (self.names.values() + self.low).tolist()

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


_tables: dict = {}


def _encoder(path: str, end_id: int):
    """text -> its ids and the end id as bytes; and the width of an id."""
    if path not in _tables:
        width = 2 if pretokens.tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        _tables[path] = (pretokens.WordTable(path, lambda ids: struct.pack(f"<{len(ids)}{'H' if width == 2 else 'I'}", *ids), b"".join), width)
    table, width = _tables[path]
    last = end_id.to_bytes(width, "little")
    return lambda text: table.text(text) + last, width


def write_store(docs: DataFrame, folder: str, path: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every document and write the store.

    One shuffle by doc_id range puts documents in order; ranges are cut from a sample of the ids alone, so equal shares of
    rows. A source has no part in the partitioning, and rows of one doc_id are the only ones that must meet.
    """
    spark = docs.sparkSession

    def encode(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held_ids, held_lengths, held, n = [], [], [], 0
        encode_text, width = _encoder(path, end_id)

        def close():
            nonlocal seq, n, held_ids, held_lengths, held
            row = pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(held_ids)], "n_ids": [n], "payload": [pack_segment(held_ids, held_lengths, b"".join(held), width)]})
            seq, n, held_ids, held_lengths, held = seq + 1, 0, [], [], []
            return row

        for pdf in batches:
            ids = [None if pd.isna(d) else int(d) for d in pdf["doc_id"]]
            for doc_id, data in zip(ids, map(encode_text, pdf["text"])):
                held_ids.append(doc_id)
                held_lengths.append(len(data) // width)
                held.append(data)
                n += held_lengths[-1]
                if n >= segment_ids:
                    yield close()
        if held_ids:
            yield close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInPandas(encode, SEGMENT_TYPE).write.option("compression", "uncompressed").parquet(f"{folder}/segments")
    sizes = spark.read.parquet(f"{folder}/segments").select("part", "seq", "n_ids")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts_first = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("part_first", before(Window.orderBy("part"))).drop("n")
    within = sizes.withColumnRenamed("n_ids", "n").withColumn("in_part", before(Window.partitionBy("part").orderBy("seq")))
    within.join(parts_first, "part").select("part", "seq", (F.col("part_first") + F.col("in_part")).alias("first_id")).write.parquet(f"{folder}/index")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What the files say of each document: doc_id, start, n_tokens, ids_crc32 (over ids as unsigned 32-bit numbers)."""
    segments = spark.read.parquet(f"{folder}/segments")
    index = spark.read.parquet(f"{folder}/index")
    small = index.count() <= BROADCAST_ROWS

    def read(batches):
        for pdf in batches:
            for payload, first in zip(pdf["payload"], pdf["first_id"]):
                s = Segment(payload)
                ends = s.ends.values()
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                wide = s.ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pd.DataFrame({"doc_id": pd.Series(s.doc_ids(), dtype="Int64"), "start": starts + int(first), "n_tokens": ends - starts, "ids_crc32": np.array(crcs, np.int64)})

    joined = segments.select("part", "seq", "payload").join(F.broadcast(index) if small else index, ["part", "seq"])
    return joined.select("first_id", "payload").mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
