"""Every registered query of the domain tables over the smallest ones, against its SQL in DuckDB."""

import os

import duckdb
import pytest

from quarrystone.plans import many, operations, queries, rules  # noqa: F401

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(ROOT):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{ROOT}/{f}'")
    return c


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    got = queries.queries()[name](spark, ROOT)
    if name not in queries.oracle_sql():
        assert got.count()
        return
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    rows = lambda rs: sorted((tuple(map(_plain, r)) for r in rs), key=key)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_bootstrap_query_runs_all_replicates(spark, monkeypatch):
    from quarrystone.operators import scoring

    given, real = [], scoring.interval
    monkeypatch.setattr(scoring, "interval", lambda e: given.append(e) or real(e))
    queries.queries()["bootstrap_ci"](spark, ROOT)
    assert given[0].select("replicate").distinct().count() == 10_000


def test_gold_tokens_are_matched_whole(spark, tmp_path):
    import os
    import shutil

    root = tmp_path / "t"
    root.mkdir()
    for name in os.listdir(ROOT):  # the tables may be read-only: files are made anew, without their modes
        shutil.copyfile(f"{ROOT}/{name}", root / name)
    item = "aa bb cc dd ee ff gg hh"
    c = duckdb.connect()
    for name, change in (("benchmark", f"'{item}' as text"), ("documents", f"case when doc_id % 2 = 0 then '{item} ii' else 'aa bb cc dd ee ff' end as text")):
        c.execute(f"copy (select * replace ({change}) from '{ROOT}/{name}.parquet') to '{root}/{name}.parquet' (format parquet)")
    docs = f"'{root}/documents.parquet'"
    for keep, some in (("= 0", True), ("= 1", False)):
        c.execute(f"copy (select * from {docs} where doc_id % 2 {keep}) to '{root}/part.parquet' (format parquet)")
        shutil.copyfile(f"{root}/part.parquet", f"{tmp_path}/{some}.parquet")
    found = {}
    for some in (True, False):
        shutil.copyfile(f"{tmp_path}/{some}.parquet", f"{root}/documents.parquet")
        found[some] = queries.queries()["gold_token_match"](spark, str(root)).count()
    assert found[True] and not found[False]


def test_relations_are_made_distinct_by_their_keys(spark):
    from quarrystone.plans.substrate import Substrate

    plan = Substrate(spark, ROOT).relations._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Aggregate" in line]
    assert len(lines) == 2 and all("Aggregate [l_orderkey" in line for line in lines)  # before, by references, texts made of them
