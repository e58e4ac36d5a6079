"""Faults of a written semantic index, each told by its code and in order."""

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import text as X
from quarrystone.operators import semantic
from quarrystone.sources import semantic_index as S

BASE = {"complete": True, "drift": False, "fingerprint": "sha256:" + "a" * 64, "last_event": "EV-000007"}


@pytest.fixture
def docs(spark):
    rows = [("a", "gradient descent converges slowly"), ("b", "the gradient vanishes"), ("c", "梯度下降 gradient"), ("d", ""), ("e", None)]
    return X.normalised(spark.createDataFrame(rows, "id string, text string")).select("id", "norm")


def _replace(spark, target, name, change):
    import json
    import shutil

    version = json.loads(spark.read.text(f"{target}/current").first()[0])["version"]
    table = change(spark.read.parquet(f"{version}/{name}")).collect(), spark.read.parquet(f"{version}/{name}").schema
    shutil.rmtree(f"{version}/{name}")
    spark.createDataFrame(table[0], table[1]).write.parquet(f"{version}/{name}")


def test_written_index_ranks_as_one_that_is_made_anew(spark, docs, tmp_path):
    meta = S.write(docs, str(tmp_path / "i"), BASE, "2024-01-01T00:00:00Z")
    assert meta["document_count"] == "5" and list(meta) == list(S.METADATA)
    asks = spark.createDataFrame([(1, "gradient descent"), (2, "the"), (3, "gradeint"), (4, "梯度")], "query_id long, text string")
    got = S.open_index(spark, str(tmp_path / "i"), BASE).rank(asks).collect()
    assert sorted(got) == sorted(semantic.rank(docs, asks).collect()) and {r["query_id"] for r in got} == {1, 3, 4}  # a query misspelt is found by its n-grams
    assert next(r["id"] for r in got if r["query_id"] == 4 and r["rank"] == 1) == "c"


def test_each_code_in_order(spark, docs, tmp_path):
    def code(target, base=BASE):
        with pytest.raises(S.SemanticError) as e:
            S.open_index(spark, str(tmp_path / target), base)
        return e.value.code

    assert code("none") == S.NOT_BUILT
    for stale in ({}, BASE | {"drift": True}, BASE | {"complete": False}):
        with pytest.raises(S.SemanticError, match=S.STALE):
            S.write(docs, str(tmp_path / "none"), stale, "2024-01-01T00:00:00Z")
    assert code("none") == S.NOT_BUILT
    for name, table, change in (
        ("tf", "terms", lambda t: t.withColumn("tf", -F.col("tf"))), ("twice", "terms", lambda t: t.union(t)), ("empty", "terms", lambda t: t.withColumn("term", F.lit(""))),
        ("gram", "ngrams", lambda t: t.withColumn("grams", F.array(F.lit("abcd")))), ("meta", "semantic_metadata", lambda t: t.where("key <> 'document_count'")), ("form", "semantic_metadata", lambda t: t.withColumn("value", F.lit("x"))),
    ):
        S.write(docs, str(tmp_path / name), BASE, "2024-01-01T00:00:00Z")
        _replace(spark, str(tmp_path / name), table, change)
        assert code(name) == S.CORRUPT
        assert code(name, BASE | {"fingerprint": "sha256:" + "b" * 64}) == S.CORRUPT  # a broken index isn't called stale
    S.write(docs, str(tmp_path / "few"), BASE, "2024-01-01T00:00:00Z")
    _replace(spark, str(tmp_path / "few"), "documents", lambda t: t.where("id <> 'a'"))
    assert code("few", BASE | {"last_event": "EV-000008"}) == S.STALE and code("few") == S.CORRUPT  # what doesn't fit the documents comes after


def test_pruned_ranking_equals_the_full_one_and_reads_less(spark, tmp_path, monkeypatch):
    from quarrystone.operators import pruned

    monkeypatch.setattr(pruned, "BLOCK", 8)
    monkeypatch.setattr(pruned, "SLICE", 100)
    monkeypatch.setattr(pruned, "FIRST", 3)
    rows = [(f"d{k:04d}", " ".join(f"{w}{(k * 7 + j * j) % m}" for j, (w, m) in enumerate([("common", 2), ("topic", 9), ("rare", 150), ("word", 40)] * (1 + k % 5)))) for k in range(600)]
    rows += [(f"e{k}", "rare7 topic3 rare7 word9 rare14") for k in range(5)] + [("x1", ""), ("x2", None), ("x3", "梯度下降 rare7")]
    table = X.normalised(spark.createDataFrame(rows, "id string, text string")).select("id", "norm").repartition(3)
    S.write(table, str(tmp_path / "p"), BASE, "2024-01-01T00:00:00Z")
    index = S.open_index(spark, str(tmp_path / "p"), BASE)
    asked = [(1, "rare7 topic3"), (2, "common1 common0 topic2 rare14 word9"), (3, "comon1 nothing here"), (4, "the of"), (5, "rare7 rare14 rare21 rare28"), (6, "梯度下降"), (7, "zzzz")]
    asks = spark.createDataFrame(asked, "query_id long, text string")
    for k in (1, 20):
        assert sorted(index.rank(asks, k).collect()) == sorted(semantic.rank(table, asks, k).collect())
    read = {r["query_id"]: r for r in pruned.Search(index.tables, asks, 5).reading().collect()}
    assert any(r["read"] and r["read"] < r["postings"] for r in read.values())
    assert all(r["scored"] < 608 / 2 for r in read.values() if r["read"])


def test_repeated_terms_are_found_wherever_their_rows_lie(spark, monkeypatch):
    rows = [(f"d{k // 40}", f"t{k % 40}", 1.0) for k in range(4000)] + [("d7", "t3", 1.0), ("x", "t", 1.0), ("x", "t", 1.0), (None, "t", 1.0), (None, "t", 1.0)]
    table = spark.createDataFrame(rows, "id string, term string, tf double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for t in (table.coalesce(1), table.repartition(5)):
            assert semantic._repeated(t, "id").first()["n"] == 3  # one far from its like, one next to it, one without a document
        monkeypatch.setattr(semantic, "HELD", 10)
        assert semantic._repeated(table.coalesce(1), "id").first()["n"] == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frequencies_reach_all_terms_whatever_is_sent(spark, monkeypatch):
    rows = [(f"d{k}", f"t{j}", 1) for k in range(30) for j in range(0, 60, 1 + k)]
    table = spark.createDataFrame(rows, "id string, term string, n int")
    df = semantic.frequencies(table)
    want = {(r["id"], r["term"], r["df"]) for r in table.join(df, "term").collect()}
    for sent in (1, 8, 1000):
        monkeypatch.setattr(semantic, "SENT", sent)
        got = semantic.with_df(table, df).collect()
        assert len(got) == len(rows) and {(r["id"], r["term"], r["df"]) for r in got} == want


def test_a_written_index_moves_little(spark, tmp_path):
    """Terms are checked where they lie, and a search moves the terms, postings and n-grams of its queries only."""
    from quarrystone.operators import pruned

    def shuffled():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    rows = [(f"d{k:05d}", " ".join(f"w{(k * 31 + j * 17) % 5003}" for j in range(100))) for k in range(2000)]
    table = X.normalised(spark.createDataFrame(rows, "id string, text string")).select("id", "norm")
    S.write(table, str(tmp_path / "m"), BASE, "2024-01-01T00:00:00Z")
    before = shuffled()
    index = S.open_index(spark, str(tmp_path / "m"), BASE)
    pruned.Search(index.tables, spark.createDataFrame([(1, "w7 w8"), (2, "w5000 x")], "query_id long, text string"), 5).rank().collect()
    assert shuffled() - before < 100_000  # there are 200,000 rows of terms
