import pytest

from quarrystone.functions.hashing import dump_digest, table_lines
from quarrystone.plans import control, render, scenario
from quarrystone.sources import yaml
from tests.test_engine import engine  # noqa: F401


@pytest.fixture
def root(tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("organized/n.md", "note")
    put("reports/CURRENT.md", "# Report\nwords")
    put("reports/CURRENT.sources.yaml", yaml.dumps({"sources": [{"path": "organized/n.md", "content_hash": control.digest(b"note")}]}))
    put(".auth/registry.yaml", yaml.dumps({"authorizations": [{"ref": f"AUTH-{k}", "grantee": "ann", "scope": s, "valid": v} for k, s, v in ((1, "freeze-report", True), (2, "revise-definition", True), (3, "freeze-report", False))]}))
    put("definitions/H1/APPROVED.yaml", yaml.dumps({"definition": "H1", "ref": "H1@v1"}))
    put("experiments/EXP-1/spec.yaml", "version: 2\n")
    put("out/m.csv", "a,b\n")
    return tmp_path


def _freeze(root, key="k1", **other):
    return control.freeze_report(str(root), **({"key": key, "actor": "ann", "authorization": "AUTH-1", "at": "2024-01-01T00:00:00Z", "commit": "0123456789"} | other))


def test_freeze_is_idempotent_and_keeps_a_person_s_words(root):
    first = _freeze(root)
    assert (first["subject"], first["event_id"], first["outcome"]) == ("REPORT-001", "EV-000001", "committed")
    assert (root / "reports/history/REPORT-001.md").read_text() == "# Report\nwords"
    assert yaml.loads((root / "reports/history/REPORT-001.sources.yaml").read_text())["sources"][0]["git_commit"] == "0123456789"
    assert _freeze(root)["outcome"] == "replay"
    (root / "reports/CURRENT.md").write_text((root / "reports/CURRENT.md").read_text() + "\nmore\n")
    with pytest.raises(control.Refused, match="IDEMPOTENCY_CONFLICT"):
        _freeze(root)
    assert _freeze(root, "k2")["subject"] == "REPORT-002"
    assert (root / "reports/history/REPORT-002.md").read_text() == "# Report\nwords\nmore"
    assert control.unfinished(str(root)) == []
    (root / "events/EV-000002.commit").unlink()
    assert control.unfinished(str(root)) == ["EV-000002"]
    with pytest.raises(control.Refused, match="TX_INCOMPLETE"):
        _freeze(root, "k2")


@pytest.mark.parametrize(("change", "code"), [({"authorization": ""}, "AUTH_REQUIRED"), ({"authorization": "x"}, "AUTH_INVALID"), ({"authorization": "AUTH-9"}, "AUTH_NOT_FOUND"), ({"authorization": "AUTH-2"}, "AUTH_SCOPE_DENIED"), ({"authorization": "AUTH-3"}, "AUTH_SCOPE_DENIED"), ({"actor": "bob"}, "AUTH_SCOPE_DENIED")])
def test_freeze_needs_its_grant(root, change, code):
    with pytest.raises(control.Refused, match=code):
        _freeze(root, **change)
    assert not (root / "reports/history").exists()


def test_freeze_verifies_sources(root):
    (root / "organized/n.md").write_text("other")
    with pytest.raises(control.Refused, match="HASH_MISMATCH"):
        _freeze(root)
    (root / "organized/n.md").unlink()
    with pytest.raises(control.Refused, match="SOURCE_MISSING"):
        _freeze(root)
    with control.locked(root), pytest.raises(control.Refused, match="TX_LOCKED"):
        _freeze(root)


def test_revise(root):
    body = {"scope": "all"}
    doc = {"schema_version": 1, "entity_id": "H1", "version_ref": "H1@v2", "previous": "H1@v1", "body": body}
    approval = {"valid": True, "definition": "H1", "previous": "H1@v1", "proposed_definition_hash": control.document_digest(doc), "change_type": ["scope_change"]}
    call = {"key": "r1", "actor": "ann", "authorization": "AUTH-2", "approval": approval, "definition": "H1", "expected": "H1@v1", "body": body, "change_types": ["scope_change"], "at": "t", "commit": "c"}
    for change, code in (({"change_types": ["nothing"]}, "CHANGE_TYPE_INVALID"), ({"body": {}}, "APPROVAL_BINDING_MISMATCH"), ({"expected": "H2@v1"}, "PREVIOUS_INVALID")):
        with pytest.raises(control.Refused, match=code):
            control.revise_definition(str(root), **(call | change))
    assert control.revise_definition(str(root), **call)["subject"] == "H1@v2"
    assert control.revise_definition(str(root), **call)["outcome"] == "replay"
    with pytest.raises(control.Refused, match="CAS_MISMATCH"):
        control.revise_definition(str(root), **(call | {"key": "r2"}))


def test_ingest(root):
    doc = control.ingest_raw(str(root), "EXP-1", str(root / "out"), model="m")
    assert (doc["run_id"], doc["experiment_ref"]) == ("R001", "EXP-1@v2") and (root / "raw/EXP-1/R001/m.csv").is_file()
    assert control.ingest_raw(str(root), "EXP-1", str(root / "out/m.csv"), status="failed")["run_id"] == "R002" and (root / "raw/EXP-1/R002/STATUS.yaml").is_file()
    for args, code in ((("EXP-../x", "out"), "INVALID_EXPERIMENT_ID"), (("EXP-1", "none"), "SOURCE_MISSING"), (("EXP-9", "out"), "SPEC_NOT_FOUND")):
        with pytest.raises(control.Refused, match=code):
            control.ingest_raw(str(root), args[0], str(root / args[1]))
    with pytest.raises(control.Refused, match="TARGET_OCCUPIED"):
        control.ingest_raw(str(root), "EXP-1", str(root / "out"), run_id="R001")
    assert not [p for p in (root / "raw").rglob(".new-*")]


def test_commands():
    assert control.command("query_text_semantic", text="t") == ["query", "--text", "t", "--semantic"]
    assert control.command("impact", locator="x", change_type="c") == ["impact", "x", "--change-type", "c"]
    for bad in ({"operation": "query_entity"}, {"operation": "nothing"}):
        with pytest.raises(ValueError):
            control.command(**bad)


def test_scenarios(engine):  # noqa: F811
    actions = [
        {"action": "invoke", "operation": "query_entity", "params": {"locator": "run:1"}, "capture": "a"},
        {"action": "mutate", "kind": "tamper_hash", "target": "run:1"},
        {"action": "invoke", "operation": "query_entity", "params": {"locator": "run:1"}, "capture": "b"},
    ]
    gold = scenario.compile_gold(engine.state, actions)
    assert [(g["status"], g["error_semantic"], len(g["results"])) for g in gold] == [("success", None, 1), ("fail_closed", "HASH_MISMATCH", 0)]
    assert scenario.judge(gold, gold)["passed"] and not scenario.judge(gold, gold[:1])["passed"] and not scenario.judge([], [])["passed"]
    leaking = [gold[0], gold[1] | {"results": gold[0]["results"]}]
    assert not scenario.judge(gold, leaking)["passed"] and not scenario.judge(gold, [*gold, {"capture": "c"}])["passed"]


def test_render(engine):  # noqa: F811
    answer = engine.query_entity("run:1")
    assert "run:1" in render.as_text(answer) and '"status": "success"' in render.as_json(answer) and "<td>run:1</td>" in render.as_html(answer)


def test_dump_digest(spark):
    df = spark.createDataFrame([("b", 1.5, None), ("a", -0.0, "é")], "id string, x double, t string")
    d = dump_digest(table_lines(df, "docs", ["id", "x", "t"], ["id"])).first()
    want = '{"id":"a","t":"é","x":"0.000000"}\n{"id":"b","t":null,"x":"1.500000"}\n'
    assert d["digest"] == control.digest(want.encode())
    twice = dump_digest(table_lines(df.union(df), "docs", ["id", "x", "t"], ["id"])).first()
    assert twice["digest"] is None
    with pytest.raises(ValueError):
        table_lines(df, "docs", ["nope"], ["id"])


def test_answers_are_rendered_whole(spark):
    from quarrystone.plans.envelope import Envelope

    answer = Envelope("query_history", spark.range(120).repartition(3))
    assert len(render.as_dict(answer)["results"]) == 120 and render.as_text(answer).count("  - ") == 120 and render.as_html(answer).count("<td>") == 120
    some = render.as_dict(answer, 50)
    assert len(some["results"]) == 50 and some["total"] == 120 and "50 of 120 rows" in render.as_text(answer, 50)


def _definition(root):
    old = {"schema_version": 1, "entity_id": "H1", "version_ref": "H1@v1", "previous": None, "body": {"scope": "some"}}
    (root / "definitions/H1/H1@v1.yaml").write_text(yaml.dumps(old))
    return {"definitions/H1/H1@v1.yaml": control.document_digest(old)}


def _revise(root, n=2, key="r"):
    body = {"scope": f"all {n}"}
    doc = {"schema_version": 1, "entity_id": "H1", "version_ref": f"H1@v{n}", "previous": f"H1@v{n - 1}", "body": body}
    approval = {"valid": True, "definition": "H1", "previous": f"H1@v{n - 1}", "proposed_definition_hash": control.document_digest(doc), "change_type": ["scope_change"]}
    return control.revise_definition(str(root), f"{key}{n}", "ann", "AUTH-2", approval, "H1", f"H1@v{n - 1}", body, ["scope_change"], "2024-01-01T00:00:00Z", "c")


@pytest.mark.parametrize("kind", ["freeze", "revise"])
def test_a_crash_at_any_write_is_undone_or_finished(spark, root, monkeypatch, tmp_path_factory, kind):
    import shutil

    from quarrystone.plans import wal

    pins, seen, real = _definition(root), set(), wal.write_whole
    for stop in range(40):
        place = tmp_path_factory.mktemp("crash") / "w"
        shutil.copytree(root, place)
        left = [stop]

        def broken(path, data, replace=True, left=left):
            if left[0] == 0:
                raise OSError("the power is gone")
            left[0] -= 1
            real(path, data, replace)

        monkeypatch.setattr(wal, "write_whole", broken)
        try:
            _freeze(place) if kind == "freeze" else _revise(place)
            crashed = False
        except OSError:
            crashed = True
        monkeypatch.setattr(wal, "write_whole", real)
        done = [wal.recover(place, tx) for tx in wal.documents(place / ".index/tx", ".plan.yaml")]
        assert all(d["outcome"] in ("aborted", "committed") for d in done)
        if stop % 5 == 0 or not crashed:
            assert control.tx_reconcile(spark, str(place), pins)[1].collect() == []
        assert control.may_reset(str(place)) and not list((place / ".index/tx").glob("*.plan.yaml"))
        again = _freeze(place) if kind == "freeze" else _revise(place)  # the same request is answered by what was finished, or runs
        assert again["outcome"] == ("replay" if not crashed or any(d["outcome"] == "committed" for d in done) or (place / "events/EV-000001.commit").exists() and again["outcome"] == "replay" else "committed")
        seen |= {d["outcome"] for d in done}
        if not crashed:
            break
    assert not crashed and seen == {"aborted", "committed"}


def test_what_others_wrote_is_never_overwritten(spark, root, monkeypatch):
    from quarrystone.plans import wal

    real = wal.write_whole
    monkeypatch.setattr(wal, "write_whole", lambda path, data, replace=True: (_ for _ in ()).throw(OSError()) if path.name == "CURRENT.md" else real(path, data, replace))
    with pytest.raises(OSError):
        _freeze(root)
    monkeypatch.setattr(wal, "write_whole", real)
    (root / "reports/CURRENT.md").write_text("someone's words")
    assert [r["action"] for r in wal.actions(spark, root).collect()] == ["hold"]
    done, issues = control.tx_reconcile(spark, str(root))
    assert done[0]["outcome"] == "needs_reconcile" and done[0]["why"].startswith("CURRENT_CONFLICT") and (root / "reports/CURRENT.md").read_text() == "someone's words"
    assert {(r["check"], r["code"]) for r in issues.collect()} >= {("recovery", "NEEDS_RECONCILE"), ("receipt", "NEEDS_RECONCILE")}
    assert not control.may_reset(str(root))
    with pytest.raises(control.Refused, match="TX_INCOMPLETE"):
        _freeze(root, "k9")


def test_tampering_is_told_by_its_check(spark, root):
    pins = _definition(root)
    _freeze(root)
    for n in (2, 3):
        _revise(root, n)
    (root / ".index/tx/TX-000001.marker").unlink()
    assert control.tx_reconcile(spark, str(root), pins)[1].collect() == [] and (root / ".index/tx/TX-000001.marker").exists()  # rebuilt from its receipt
    found = lambda: {(r["check"], r["subject"], r["code"]) for r in control.tx_reconcile(spark, str(root), pins)[1].collect()}
    pointer = (root / "definitions/H1/APPROVED.yaml").read_text()
    (root / "definitions/H1/APPROVED.yaml").write_text(pointer.replace("H1@v3", "H1@v2"))
    assert found() == {("pointer", "H1", "DEF_POINTER_DIVERGED")}
    (root / "definitions/H1/APPROVED.yaml").unlink()
    assert found() == {("pointer", "H1", "PROVENANCE_BROKEN")}
    (root / "definitions/H1/APPROVED.yaml").write_text(pointer)
    text = (root / "definitions/H1/H1@v2.yaml").read_text()
    (root / "definitions/H1/H1@v2.yaml").write_text(text.replace("all 2", "all 9"))
    assert {("receipt", "EV-000002", "NEEDS_RECONCILE"), ("receipt", "EV-000003", "NEEDS_RECONCILE")} <= found()  # and what rests on it
    (root / "definitions/H1/H1@v2.yaml").write_text(text)
    (root / "definitions/H1/H1@v1.yaml").write_text((root / "definitions/H1/H1@v1.yaml").read_text().replace("some", "none"))
    assert ("bootstrap", "definitions/H1/H1@v1.yaml", "DEF_POINTER_DIVERGED") in found()
