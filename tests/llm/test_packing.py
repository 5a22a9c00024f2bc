"""Packing by powers of two against the tokenizer library."""

import zlib

import numpy as np
import pytest

from fellscan.llm import binary_packing
from fellscan.llm.common import shared_folder
from fellscan.llm.pretokens import library_ids

P = pytest.importorskip("public_tokenizers")
EDGES = [(None, None), (1, ""), (1, "a b"), (1, "a b"), (2, "x " * 5000), (3, " \n "), (4, "Zürich 漢字 <|endoftext|>"), (None, "no id")]


def packed(spark, docs, path, most):
    folder = shared_folder(spark, "test-packed")
    binary_packing.write_sequences(docs, folder, path, 1, most)
    return folder, binary_packing.read_sequences(spark, folder)


def test_lengths_are_binary():
    for n in [0, 1, 2, 3, 2047, 2048, 2049, 10_000]:
        lengths = binary_packing.binary_lengths(n)
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 2048 for x in lengths) and lengths == sorted(lengths, reverse=True)
        assert len(lengths) <= n // 2048 + 11


@pytest.mark.parametrize("most", [2048, 64])
def test_packing(spark, most):
    path = P.path("word_bpe_49k.json")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + EDGES
    docs = spark.createDataFrame([(*r, "c", "s", 0) for r in rows], "doc_id long, text string, ids string, sequence_id string, length int").repartition(5)
    folder, sequences = packed(spark, docs, path, most)
    got = [r.asDict() for r in binary_packing.described(sequences).collect()]
    want = []
    for i, text in rows:
        ids = np.array([*library_ids(path, text or ""), 1], "<u4")
        at = 0
        for n in binary_packing.binary_lengths(len(ids), most):
            want.append((i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), 0))
            at += n
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["offset"]) for r in got), key=str) == sorted(want, key=str)
    # one sequence a piece, numbered without gaps, each bucket a range of its own
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    by_number = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert by_number == sorted(by_number)
    bucket = spark.read.parquet(f"{folder}/sequences").where(f"length = {min(most, 64)}")
    assert bucket.count() == by_number.count(min(most, 64)) and "PartitionFilters: [isnotnull(length" in bucket._jdf.queryExecution().toString()


def test_packing_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    _, sequences = packed(spark, docs, P.path("word_bpe_49k.json"), 2048)
    assert binary_packing.described(sequences).count() == 0
    with pytest.raises(ValueError):
        binary_packing.pieces(docs, P.path("word_bpe_49k.json"), 1, 1000)
