"""The registered queries over the smallest tables; those with SQL against DuckDB, the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from quarrystone.llm import queries

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(ROOT):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{ROOT}/{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, ROOT)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mixture", "records"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, ROOT)
        if name == "records":
            assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == docs.count()
            break
        assert out.columns == columns and out.schema == docs.schema
        kept = {(r["doc_id"], r["text"]) for r in out.collect()}
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        assert kept and kept <= before
        if name == "language":
            assert len(kept) > 0.95 * n
        if name == "near_dedup":
            parts = queries.simhash.near_duplicates(docs).collect()
            assert {k[0] for k in kept} == {r["component_id"] for r in parts} and len(kept) == out.count()
        if name == "decontaminate":
            marked = queries.fmindex.digest(queries.fmindex.mark(docs, spark.read.parquet(f"{ROOT}/benchmark.parquet")))
            assert {k[0] for k in kept} == {r["doc_id"] for r in marked.where("not contaminated").collect()}
        if name == "mixture":
            mix = queries.mixture.mix(docs, preference=queries.mixture.by_length(docs["text"])).where("copies > 0").collect()
            assert {r["doc_id"]: r["copies"] for r in mix} == {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
        docs = out


def test_core_stands_without_this_subpackage():
    import pathlib

    top = pathlib.Path(corpus_pipeline.__file__).parent / "quarrystone"
    for f in top.rglob("*.py"):
        if "llm" not in f.relative_to(top).parts:
            assert ".llm" not in f.read_text()
