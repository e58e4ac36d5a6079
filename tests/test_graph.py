from pyspark.sql import functions as F

from quarrystone.operators import graph, impact


def _edges(spark, *rows):
    return spark.createDataFrame([(a, r, b) for a, r, b in rows], "source_ref string, relation string, target_ref string")


def test_closure_ends_on_cycles(spark):
    e = _edges(spark, ("a", "uses", "b"), ("b", "uses", "c"), ("c", "uses", "a"), ("c", "uses", "d"))
    got = graph.closure(e, spark.createDataFrame([("a",), ("d",)], "ref string"))
    assert {(r["root"], r["ref"], r["depth"]) for r in got.collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("d", "d", 0)}
    assert {r["ref"] for r in graph.cyclic(e).collect()} == {"a", "b", "c"}


def test_lineage_orders_by_number_and_refuses_forks(spark):
    rows = [("x", n, f"x@v{n}", f"x@v{n - 1}" if n > 1 else None) for n in range(1, 12)] + [("y", 1, "y@v1", None), ("y", 2, "y@v2", "y@v1"), ("y", 3, "y@v3", "y@v1"), ("z", 1, "z@v1", None), ("z", 2, "z@v2", None)]
    got = graph.lineage(spark.createDataFrame(rows, "entity_id string, version int, version_ref string, previous string")).collect()
    assert [r["version_ref"] for r in sorted((r for r in got if r["entity_id"] == "x"), key=lambda r: r["place"])] == [f"x@v{n}" for n in range(1, 12)]
    assert all(r["condition"] == "AMBIGUOUS_VERSION" and r["place"] is None for r in got if r["entity_id"] != "x")


def test_same_graph_counts_rows(spark):
    one, two = _edges(spark, ("a", "r", "b")), _edges(spark, ("a", "r", "b"), ("a", "r", "b"))
    assert graph.same_graph(one, one) and not graph.same_graph(one, two)


def test_impact_classes_and_reasons(spark):
    rows = [("Run", "committed", False), ("Run", "executed", False), ("TaskSlice", "executed", None), ("TaskSlice", "planned", None), ("ResultBundle", "executed", False), ("ResultBundle", "executed", True), ("Claim", None, None)]
    df = spark.createDataFrame([(k, *r, ["uses"]) for k, r in enumerate(rows)], "k int, entity_type string, lifecycle string, committed boolean, relations array<string>")
    got = {r["k"]: r for r in impact.reasons(impact.classify(df), ["other_semantic", "method_change", "scope_change", "nonsense"]).collect()}
    assert {k: r["impact"] for k, r in got.items()} == {0: "superseded", 3: "stale", 4: "needs_review", 6: "stale"}
    assert [x["reason_code"] for x in got[6]["reasons"]] == ["upstream_scope_changed", "upstream_method_changed", "other_upstream_change"]
    assert [x["reason_code"] for x in got[4]["reasons"]] == ["active_result_bundle"]


def test_declared_references(spark):
    doc = '{"based_on": "H1@v1", "dependencies": {"uses": ["A@v2", {"ref": "B@v1"}, "no"]}, "other": "C@v1", "relations": [1]}'
    df = spark.createDataFrame([(doc,), ("{",), (None,)], "body string").select(impact.declared("body").alias("d"))
    got = [[(x["relation"], x["ref"]) for x in r["d"]] for r in df.collect()]
    assert got == [[("based_on", "H1@v1"), ("uses", "A@v2"), ("uses", "B@v1")], [], []]


def test_documents_are_parsed_once(spark):
    df = spark.range(3).selectExpr("concat('{\"uses\":\"a@', id, '\"}') as body").select(F.explode(impact.declared("body")).alias("d"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1  # before, 32 times
    assert [r["d"]["ref"] for r in df.collect()] == ["a@0", "a@1", "a@2"]


def test_structural_diff(spark):
    df = spark.createDataFrame([('{"a":{"b":1,"c":[1]},"d":2}', '{"a":{"b":1,"c":[2]},"e":{}}')], "x string, y string")
    assert impact.structural_diff(df, "x", "y").first()["changed"] == ["a.c", "d", "e"]


def test_fields_of_what_json_allows(spark):
    deep = '{"a":' * 12 + "1" + "}" * 12
    rows = [(deep, '{"a":{}}'), (None, '{"a":1}'), ("[1]", "{}"), ('{"a":1,"a":2}', '{"a":2}'), ('{"x.y":1}', '{"x":{"y":1}}'), ('{"n":null,"l":[{"p":1,"q":"\\u00e9"}]}', '{"l":[{"q":"é","p":1.0}]}'), ('{"n":1.50,"t":"1"}', '{"n":1.5,"t":1}'), ("{", "{")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows * 2)], "side int, x string, y string")
    out = impact.structural_diff(df, "x", "y")
    got = {r["side"]: r["changed"] for r in out.collect()}
    want = [["a", ".".join("a" * 12)], ["a"], [], ["a"], [], ["n"], ["t"], []]
    assert [got[k] for k in sorted(got)] == want * 2
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert impact.structural_diff(df.limit(0), "x", "y").count() == 0


def test_estimates_of_rounds_stay_small(spark):
    from quarrystone.functions.storage import written

    t = written(spark.range(20).selectExpr("id as a", "id + 1 as b"))
    for _ in range(8):
        t = written(t.join(t.selectExpr("a as k", "b as c"), t["b"] == F.col("k"), "left").selectExpr("a", "coalesce(c, b) as b"))
    assert t.count() == 20 and int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 40


def test_closures_join_small_frontiers_without_a_shuffle_of_all_edges(spark):
    edges = spark.range(200_000).selectExpr("concat('n', id) as source_ref", "case when id % 5 > 0 then concat('n', id - 1) end as target_ref")
    from quarrystone.operators import graph

    got = graph.closure(edges, spark.createDataFrame([("n4",), ("n9",)], "ref string"))
    assert {(r["root"], r["ref"], r["depth"]) for r in got.collect()} == {(f"n{k}", f"n{k - d}", d) for k in (4, 9) for d in range(5)}
    assert "Scan ExistingRDD" not in got._jdf.queryExecution().sparkPlan().toString()  # before, rounds were checkpoints, whose estimated size no join could rely on
