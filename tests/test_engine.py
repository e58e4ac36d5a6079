import pytest

from quarrystone.operators import history, integrity, lookup, transactions
from quarrystone.plans.engine import Engine, State
from quarrystone.plans.envelope import Envelope, fresh
from quarrystone.streaming import replay


@pytest.fixture
def engine(spark):
    o = "ref string, kind string, entity_id string, version_ref string, path string, status string, content_hash string, git_commit string, lifecycle_start string"
    objects = spark.createDataFrame(
        [("H1@v1", "definition", "H1", "H1@v1", "d/1", "valid", "h1", "c1", "2024-01-01"), ("H1@v2", "definition", "H1", "H1@v2", "d/2", "valid", "h2", "c2", "2024-02-01"),
         ("run:1", "run", "R1", None, "runs/1", "valid", "h3", "c3", "2024-03-01"), ("rep:1", "report", "P1", None, "reports/1", "valid", "h4", "c4", "2024-04-01")], o)
    facts = spark.createDataFrame([("f1", "H1@v2", "metric", "loss went down fast"), ("f2", "run:1", "authority_source", "ext:1"), ("f3", "H1@v2", "bound_version", "H1@v2")], "fact_id string, subject string, predicate string, value string")
    facts = facts.selectExpr("*", "timestamp_ntz'2024-02-15 00:00:00' as occurred_at")
    relations = spark.createDataFrame([("H1@v2", "supersedes", "H1@v1"), ("run:1", "based_on", "H1@v2"), ("rep:1", "cites", "run:1")], "source_ref string, relation string, target_ref string")
    atoms = spark.createDataFrame([("a1", "H1@v2", "command"), ("a2", "rep:1", "command")], "atom_id string, artifact_ref string, kind string")
    externals = spark.createDataFrame([("ext:1", "p", "1.0")], "ref string, pinned_hash string, pinned_value string")
    return Engine(State(objects, facts, relations, atoms, externals))


def _refs(answer, column="ref"):
    return sorted(r[column] for r in answer.results.collect())


def test_operations(engine):
    assert len(engine.operations) == 21
    assert _refs(engine.query_entity("run:1")) == ["run:1"] and _refs(engine.query_entity("reports/1")) == ["rep:1"]
    missing = engine.query_entity("H9@v1")
    assert missing.status == "fail_closed" and missing.error_semantic == "NOT_FOUND" and missing.results.isEmpty()
    assert engine.query_entity("H1").status == "fail_closed"  # two versions, neither is taken
    assert _refs(engine.impact("H1@v2", "scope_change")) == ["rep:1", "run:1"]
    assert sorted((r["source_ref"], r["target_ref"]) for r in engine.trace_graph("rep:1").results.collect()) == [("H1@v2", "H1@v1"), ("rep:1", "run:1"), ("run:1", "H1@v2")]
    assert _refs(engine.trace_evidence("run:1"), "atom_id") == ["a1"]
    assert _refs(engine.query_sources("run:1")) == ["H1@v2"]
    assert [r["pinned_value"] for r in engine.query_external_basis("run:1").results.collect()] == ["1.0"]
    assert _refs(engine.query_text_lexical("fast loss"), "subject") == ["H1@v2"] and engine.query_text_semantic("").results.isEmpty()
    assert _refs(engine.query_as_of_state("2024-02-28")) == ["H1@v1", "H1@v2"]
    assert [(r["version_ref"], r["place"], r["bound"]) for r in engine.query_lineage("H1@v2").results.orderBy("place").collect()] == [("H1@v1", 0, None), ("H1@v2", 1, True)]
    assert engine.query_facts("H1@v2", ["metric"]).results.count() == 1
    assert len(engine.stale_status("H1@v2", "scope_change").results.collect()) == 2


def test_conditions_close_answers(engine):
    engine.state.missing = frozenset(["H1@v1"])
    assert engine.query_sources("run:1").error_semantic == "SOURCE_MISSING" and engine.query_sources("run:1").results.isEmpty()
    engine.state.ambiguous = frozenset(["R1"])
    assert engine.query_entity("run:1").error_semantic == "AMBIGUOUS_VERSION"
    assert {r["code"] for r in engine.reconcile_integrity().results.collect()} == {"SOURCE_MISSING"}


def test_envelope(spark):
    rows = spark.range(3)
    assert Envelope("q", rows).status == "success" and Envelope("q", rows, warnings=["w"]).status == "warning"
    assert Envelope("q", rows, errors=["SOURCE_CHANGED_SINCE_PIN"]).results.count() == 3
    assert Envelope("q", rows, errors=["INDEX_STALE"]).results.count() == 0
    with pytest.raises(ValueError):
        Envelope("q", rows, errors=["NEW"])
    mark = {"complete": True, "drift": False, "fingerprint": "f", "last_event": "E2"}
    assert fresh(mark, "f", "E2") is None and fresh(mark, "g", "E2") == "INDEX_STALE" and fresh(mark, "f", "E3") == "INDEX_STALE" and fresh({}, "f", None) == "NOT_FOUND"


def test_ids_are_never_patterns(spark):
    objects = spark.createDataFrame([("a%", "p1"), ("ab", "p2"), ("a' OR '1'='1", "p3")], "ref string, path string")
    assert [r["ref"] for r in lookup.entity(objects, "a%").collect()] == ["a%"]
    assert lookup.entity(objects, "a_").isEmpty() and len(lookup.entity(objects, "a' OR '1'='1").collect()) == 1


def test_verify_outcomes(spark):
    refs = spark.createDataFrame(
        [("o1", "p", "historical", "h", None), ("o2", "q", "current", "h", None), ("o3", "p", "current", "x", None), ("o4", "p", "historical", "old", "c"), ("o5", "p", "current", "", None), ("o6", "r", "historical", "r", "c")],
        "owner string, ref_path string, reference_scope string, content_hash string, git_commit string")
    live = spark.createDataFrame([("p", "now")], "path string, content_hash string")
    snaps = spark.createDataFrame([("c", "p", "old"), ("c", "r", "r")], "git_commit string, path string, content_hash string")
    got = {r["owner"]: r["outcome"] for r in integrity.verify(refs, live, snaps).collect()}
    assert got == {"o1": "SOURCE_UNAVAILABLE", "o2": "SOURCE_MISSING", "o3": "HASH_MISMATCH", "o4": "SOURCE_CHANGED_SINCE_PIN", "o5": "ok", "o6": "SOURCE_CHANGED_SINCE_PIN"}


def test_history(spark):
    r = spark.createDataFrame([("CURRENT", "report_current", None), ("R1", "report_historical", "2024-05-01T23:00:00Z"), ("R2", "report_historical", "2024-05-01")], "id string, doc_type string, frozen_at string")
    assert [x["id"] for x in history.history_by_date_text(r, "2024-05-01T12:00:00Z").collect()] == ["R2"]
    assert {x["id"] for x in history.history(r, "2024-05-02T00:00:00Z").collect()} == {"R1", "R2"}
    t = history.instants(spark.createDataFrame([("2024-01-01T02:00:00+02:00",), ("2024-01-01T00:00:00",), ("2024-13-01T00:00:00Z",)], "t string"), "t").collect()
    assert str(t[0]["t_utc"]) == "2024-01-01 00:00:00" and t[1]["t_utc"] is None and t[2]["t_utc"] is None


def test_transactions(spark):
    legal = [("draft", "frozen")]
    s = spark.createDataFrame([("x", 1, "draft"), ("x", 2, "frozen"), ("y", 1, "frozen"), ("y", 2, "draft")], "entity_id string, step int, state string")
    assert [r["entity_id"] for r in transactions.transitions(s, legal).collect()] == ["y"]
    ids = spark.createDataFrame([("EV-000009",), ("EV-000010",), ("TX-7",), ("none",)], "id string")
    assert {r["next_id"] for r in transactions.next_ids(ids, "id").collect()} == {"EV-000011", "TX-000008"}


def test_stream_equals_batch(spark, tmp_path):
    log = spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) as ts, id % 7 as user_id, if(id % 2 = 0, 'a', 'b') as event_type, cast(id as double) as value from range(300)")
    log.selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value").repartition(3).write.parquet(str(tmp_path / "log"))
    schema = spark.read.parquet(str(tmp_path / "log")).schema
    replay.materialise(replay.events(spark, str(tmp_path / "log"), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("event_id").distinct().count() == 300
    q = replay.counts(replay.events(spark, str(tmp_path / "log"), schema), "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from hours").first()[0] == 300


def test_an_index_that_does_not_stand_for_its_tree_answers_nothing(engine):
    built = []
    engine.state.freshness = lambda: None if built else "INDEX_STALE"
    engine.state.rebuild = lambda: built.append(1) or {"fingerprint": "sha256:x", "last_event": None}
    for name, given in (("query_entity", ("run:1",)), ("query_sources", ("run:1",)), ("query_history", ()), ("query_text_lexical", ("loss",)), ("impact", ("H1@v2", "scope_change")), ("trace_graph", ("rep:1",))):
        answer = engine.operations[name](*given)
        assert (answer.status, answer.error_semantic) == ("fail_closed", "INDEX_STALE") and answer.results.isEmpty(), name
    assert engine.index().results.first()["fingerprint"] == "sha256:x"
    assert _refs(engine.query_entity("run:1")) == ["run:1"]


def test_transactions_are_looked_at(engine, spark):
    assert engine.tx_reconcile().status == "success"
    engine.state.log = spark.createDataFrame([("E1",), ("E1",), ("E2",)], "event_id string")
    assert [(r["subject"], r["code"]) for r in engine.tx_reconcile().results.collect()] == [("E1", "DUPLICATE_ID")]
    engine.state.transactions = lambda: spark.createDataFrame([("marker", "TX-1", "PROVENANCE_BROKEN")], "check string, subject string, code string")
    assert engine.tx_reconcile().status == "warning" and engine.tx_reconcile().results.count() == 1
