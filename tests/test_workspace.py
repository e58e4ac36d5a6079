import hashlib
import json
import re

import pytest

from quarrystone.operators import integrity
from quarrystone.sources import framed, manifest, workspace, yaml


def test_yaml_round_trip():
    text = "a: 1\nb:\n  c: 'x # y'\n  d:\n    - p: 1\n      q: null\n    - plain\n    - -2.5\ne: []\nf: # nothing\ng: true\n"
    doc = {"a": 1, "b": {"c": "x # y", "d": [{"p": 1, "q": None}, "plain", -2.5]}, "e": [], "f": None, "g": True}
    assert yaml.loads(text) == doc
    assert yaml.loads(yaml.dumps(doc)) == doc
    assert yaml.loads("") == {} and yaml.loads("a: 1\na: 2") == {"a": 2}
    with pytest.raises(yaml.YamlError):
        yaml.loads("a: 1\na: 2", strict=True)
    tricky = {"k": ["", "null", "12", "- x", " s", {"m": {"n": "true"}, "o": [1, {"p": "a: b"}]}]}
    assert yaml.loads(yaml.dumps(tricky)) == tricky


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()

    metrics = put("raw/EXP-1/R1/metrics.csv", "step,loss\n1,0.5\n")
    put("raw/EXP-1/R2/metrics.csv", "step,loss\n1,0.7\n")
    put("raw/EXP-1/R2/STATUS.yaml", "status: invalid\n")
    put("runs/R1/manifest.yaml", "run_id: R1\nexperiment_ref: EXP-1@v1\nstatus: failed\nraw_ref:\n  path: raw/EXP-1/R1\n  git_commit: abcdef0123456\n")
    put("experiments/EXP-1/spec.yaml", "id: EXP-1\n")
    note = put("organized/EXP-1/note.md", f"---\nid: N1\nversion: 3\nsources:\n  - path: raw/EXP-1/R1/metrics.csv\n    content_hash: {metrics}\n    reference_scope: current\n---\nbody\n")
    put("organized/EXP-1/bad.md", "---\n  :\n- x\n---\nbody\n")
    put("organized/EXP-1/twin.md", "---\nid: N1\n---\nbody\n")
    put("reports/CURRENT.md", "# r\n")
    put("reports/CURRENT.sources.yaml", f"sources:\n  - path: organized/EXP-1/note.md\n    content_hash: {note}\n  - path: gone.md\n")
    put("reports/history/REPORT-001.md", "x")
    put("reports/history/REPORT-002.md", "y")
    put(".gitignore", "z")
    put(".index/a", "z")
    return tmp_path


def test_index(spark, tree):
    ix = workspace.Index(workspace.scan(spark, str(tree)), "c1")
    docs = {(r["id"], r["doc_type"]): r for r in ix.documents.collect()}
    assert {k[0] for k in docs} == {"CURRENT", "REPORT-001", "REPORT-002", "N1", "bad", "raw/EXP-1/R1", "raw/EXP-1/R2", "R1", "EXP-1"}
    assert docs["raw/EXP-1/R2", "raw"]["status"] == "invalid" and docs["R1", "run_manifest"]["status"] == "failed"
    assert docs["bad", "organized"]["version"] == "v1"
    line = "metrics.csv:" + hashlib.sha256(b"step,loss\n1,0.5\n").hexdigest()
    assert docs["raw/EXP-1/R1", "raw"]["content_hash"] == "sha256:" + hashlib.sha256(line.encode()).hexdigest()
    assert not ix.files.where("path like '.%'").count()
    assert {(r["source"], r["relation"], r["target"]) for r in ix.relations.collect()} == {
        ("N1", "organized_from", "raw/EXP-1/R1/metrics.csv"), ("R1", "uses", "raw/EXP-1/R1"), ("CURRENT", "based_on", "organized/EXP-1/note.md"), ("CURRENT", "based_on", "gone.md"), ("REPORT-002", "supersedes", "REPORT-001"),
    }
    snapshots = spark.createDataFrame([], "git_commit string, path string, content_hash string")
    got = {(r["owner"], r["ref_path"]): r["outcome"] for r in integrity.verify(ix.source_refs, ix.live, snapshots).collect()}
    assert got == {("N1", "raw/EXP-1/R1/metrics.csv"): "ok", ("CURRENT", "organized/EXP-1/note.md"): "ok", ("CURRENT", "gone.md"): "SOURCE_MISSING", ("R1", "raw/EXP-1/R1"): "SOURCE_MISSING"}
    assert [r["id"] for r in integrity.duplicates(ix.documents, "id").collect()] == ["N1"]
    assert {r["id"] for r in workspace.corpus(ix.documents, ix.files).select("id").collect()} >= {"CURRENT", "R1"}


def test_written_index_carries_its_watermark(spark, tree, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("index"))
    assert workspace.watermark(spark, target) == {}
    mark = workspace.Index(workspace.scan(spark, str(tree))).write(target)
    assert workspace.watermark(spark, target) == mark and mark["complete"]
    assert spark.read.parquet(f"{mark['version']}/documents").count() == 10
    (tree / "reports/CURRENT.md").write_text("changed")
    assert workspace.tree_fingerprint(workspace.scan(spark, str(tree))).first()["digest"] != mark["fingerprint"]


def test_framed_nodes(spark):
    begin, end = b"<<<\n", b"\n>>>\n"

    def file(path, body=b"body", **change):
        head = {"content_hash": "sha256:" + hashlib.sha256(b"body").hexdigest(), "current": True, "entity_id": "H1", "git_commit": None, "path": path, "relations": {k: [] for k in framed.RELATIONS}, "schema_version": "f/1", "status": "valid", "version": "H1@v1"} | change
        return path, begin + json.dumps(head).encode() + end + body

    files = [file("a"), file("b", version="H1@v2"), file("c", b"other"), file("d", path_="x"), file("e", status="new"), ("f", b"plain"), file("g", version="H1@v2")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    n = framed.nodes(df, begin, end, "f/1")
    assert {r["path"]: r["fault"] for r in n.collect()} == {"a": None, "b": "AMBIGUOUS", "g": "AMBIGUOUS", "c": "HASH_MISMATCH", "d": "INVALID_FRONTMATTER", "e": "INVALID_FRONTMATTER"}
    edges = spark.createDataFrame([("H1@v1", "r", "definition:H1@v2"), ("H1@v1", "r", "kind:any"), ("H1@v9", "r", "f"), ("a", "r", "definition:none")], "source_ref string, relation string, target_ref string")
    assert {r["source_ref"] for r in framed.unverified(edges, n, df).collect()} == {"H1@v9", "a"}


def test_manifest_breaches(spark):
    t = "2024-01-01T00:00:00Z"
    objects = spark.createDataFrame([("o1", "run", "e1", "e1@v1", "p", "valid", t), ("o2", "", "e2", None, None, "valid", "2024-01-01"), ("o1", "run", "e1", None, None, "valid", t)], "ref string, kind string, entity_id string, version_ref string, path string, status string, lifecycle_start string")
    facts = spark.createDataFrame([("f1", "o1", "bound_version", "e1@v1", t), ("f2", "zz", "bound_version", "e9@v1", t), ("f3", "o1", "introduced_event", "E1", "now"), ("f4", "o1", "lifecycle_start", "2025-01-01T00:00:00Z", t)], "fact_id string, subject string, predicate string, value string, occurred_at string")
    relations = spark.createDataFrame([("o1", "r", "o9")], "source_ref string, relation string, target_ref string")
    atoms = spark.createDataFrame([("a1", "o9", "command"), ("a2", "o1", "other")], "atom_id string, artifact_ref string, kind string")
    queries = spark.createDataFrame([("q1", "query_text_semantic", "o1", None, "nobody")], "query_id string, operation string, target_ref string, as_of string, participant_locator string")
    externals = spark.createDataFrame([("x", "sha256:1")], "ref string, pinned_content_hash string")
    events = spark.createDataFrame([("E1",)], "event_id string")
    got = {(r["rule"], r["key"]) for r in manifest.breaches(objects, facts, relations, atoms, queries, externals, events).collect()}
    assert got == {
        ("object_unique", "o1"), ("object_kind", "o2"), ("object_time", "o2"), ("fact_subject", "f2"), ("fact_version", "f2"), ("fact_time", "f3"), ("fact_lifecycle", "f4"),
        ("relation_target", "o9"), ("atom_artifact", "a1"), ("atom_kind", "a2"), ("query_semantic_target", "q1"), ("query_locator", "q1"), ("external_digest", "x"),
    }


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a:\n- 1\n- x: 2\n  y: []\nb: c", {"a": [1, {"x": 2, "y": []}], "b": "c"}),
        ("- - 1\n  - 2\n-\n  k: v\n- ~", [[1, 2], {"k": "v"}, None]),
        ("at: 2024-01-01T00:00:00Z # when\nurl: http://h/#part\nq: 'a # b: c'\nn: -3\nf: 1.50\nt: TRUE\ne:", {"at": "2024-01-01T00:00:00Z", "url": "http://h/#part", "q": "a # b: c", "n": -3, "f": 1.5, "t": True, "e": None}),
        ("a:\n  b:\n    c: 1\n  d: 2\ne:\n  - f:\n      g: 3\n    h: 4\n", {"a": {"b": {"c": 1}, "d": 2}, "e": [{"f": {"g": 3}, "h": 4}]}),
        ("- http://x\n- a-b\n- -1\n# all\n\n-   two  words ", ["http://x", "a-b", -1, "two  words"]),
        ('"quoted key": 1\n', {"quoted key": 1}),
    ],
)
def test_yaml_forms(text, want):
    assert yaml.loads(text) == want and yaml.loads(yaml.dumps(want)) == want


def test_yaml_faults():
    for text in ("a: 1\n  b: 2", "a: 1\nplain", "- 1\n    - 2"):
        with pytest.raises(yaml.YamlError):
            yaml.loads(text)


def test_manifest_rules_are_dealt_by_rows(spark, monkeypatch):
    objects = spark.createDataFrame([(f"o{k}", "run", f"E{k}", f"V{k}", f"p{k}", "valid", "2024-01-01T00:00:00Z") for k in range(1000)], "ref string, kind string, entity_id string, version_ref string, path string, status string, lifecycle_start string")
    facts = spark.createDataFrame([("f1", "o1", "content", "v", "2024-01-01T00:00:00Z"), ("f2", "nobody", "content", "v", "2024-01-01T00:00:00Z")], "fact_id string, subject string, predicate string, value string, occurred_at string")
    none = lambda kind: spark.createDataFrame([], kind)
    rest = [none("source_ref string, target_ref string"), none("atom_id string, artifact_ref string, kind string"), none("query_id string, operation string, target_ref string, participant_locator string, as_of string"), none("ref string, pinned_content_hash string"), none("event_id string")]
    monkeypatch.setattr(manifest, "ROWS", 64)
    found = manifest.breaches(objects, facts, *rest)
    assert "hashpartitioning(known" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 16), REPARTITION_BY_NUM" in plan  # 1000 rows, 64 a task, however few their bytes
    assert [tuple(r) for r in found.collect()] == [("fact_subject", "f2")]


def test_each_text_is_parsed_once_in_dealt_tasks(spark, tree):
    ix = workspace.Index(workspace.scan(spark, str(tree)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    relations = plan(ix.relations)
    assert relations.count("ArrowEvalPython [") == 3  # notes, runs, sidecars; filters on their fields parsed each text again
    assert plan(ix.source_refs).count("ArrowEvalPython [") == 3 and plan(ix.runs.where("raw_ref_path <> ''")).count("ArrowEvalPython [") == 1
    assert relations.count("REPARTITION_BY_NUM") == 2  # runs and sidecars, which tables of few bytes may stand for


@pytest.mark.parametrize("line", ["a: b", "  - path: raw/E/R1", "_k9:", "a: b c  d", "a:  b", "a: b: c", "a: b:", "a: b #c", "a: b#c", "a: http://x:1/y", "a: -", "a: - b", "- - a: b", "a: 'b'", "a: it's", "é: b", "aé: ü", "a: b ", "a:b", "a :b", "a: [", "a\t: b", "a:  b", "- a:"])
def test_usual_lines_have_the_marks_of_the_grammar(monkeypatch, line):
    marks = lambda: [(at if kind != "value" else None, kind, token) for at, kind, token in yaml._tokens(line)]
    usual = marks()
    monkeypatch.setattr(yaml, "_LINE", re.compile(r"(?!)"))
    assert usual == marks()
