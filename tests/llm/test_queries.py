"""The registered queries of the subpackage against their SQL, and the pipeline against the stages' own rules."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fellscan.llm import ngram_join
from fellscan.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_every_query_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} and set(QUERIES) | {"pipeline"} <= set(names)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF).persist()
        assert seen.columns == docs.columns and 0 < seen.count(), name
        if name.startswith("n-gram"):
            assert ngram_join.similar_components(seen, 5, 80).where("doc_id <> component_id").count() == 0
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == seen.count() and out.where("NOT lossless").count() == 0
