"""A repository made by git, loose and packed, against git's own words."""

import hashlib
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import integrity
from quarrystone.sources import git


def run(root, *args):
    env = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "HOME": str(root), "PATH": "/usr/bin:/bin:/usr/local/bin", "GIT_AUTHOR_DATE": "1700000000 +0000", "GIT_COMMITTER_DATE": "1700000000 +0000"}
    return subprocess.run(["git", "-C", str(root), *args], capture_output=True, check=True, env=env).stdout


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repository")
    run(root, "init", "-q")
    commits = []
    for k in range(6):
        for d in ("a", "a/b/c", "é"):
            (root / d).mkdir(parents=True, exist_ok=True)
            (root / d / "long.txt").write_text("\n".join(f"line {j} {(j * 7 + (k if j % 50 == 0 else 0)) % 991}" for j in range(3000)) + d)
        (root / "a" / f"new{k}.bin").write_bytes(bytes(range(256)) * (k + 1))
        (root / "empty").write_bytes(b"")
        if k == 3:
            (root / "a" / "new0.bin").unlink()
        run(root, "add", "-A")
        run(root, "commit", "-qm", f"number {k}\n\ntree {'0' * 40}")
        commits.append(run(root, "rev-parse", "HEAD").decode().strip())
        if k == 4:
            run(root, "gc", "-q", "--aggressive")  # a pack with deltas; the last commit stays loose
    return root, commits


def test_objects_and_files(spark, repository, monkeypatch):
    root, commits = repository
    monkeypatch.setattr(git, "PACKED", 7)
    monkeypatch.setattr(git, "KEPT", 20_000)
    found = git.objects(spark, str(root)).cache()
    want = {tuple(x.split()) for x in run(root, "cat-file", "--batch-check=%(objectname) %(objecttype) %(objectsize)", "--batch-all-objects").decode().splitlines()}
    got = found.collect()
    assert {(r["oid"], r["kind"], str(r["size"])) for r in got} == want and len(got) == len(want)
    assert all(hashlib.sha1(f"{r['kind']} {r['size']}\0".encode() + r["content"]).hexdigest() == r["oid"] for r in got)
    deltas = run(root, "verify-pack", "-v", *[str(p) for p in (root / ".git/objects/pack").glob("*.idx")]).decode()
    assert "chain length" in deltas
    asked = spark.createDataFrame([(c,) for c in commits], "git_commit string")
    listed = {(c, *x.split("\0")) for c in commits for x in [f"{line.split()[0]}\0{line.split()[2]}\0{path}" for line, path in (e.split("\t") for e in run(root, "ls-tree", "-rz", c).decode().split("\0") if e)]}
    assert {(r["git_commit"], r["mode"], r["oid"], r["path"]) for r in git.files(found, asked).collect()} == listed
    log = {r["git_commit"]: r for r in git.commits(found).collect()}
    assert [log[c]["parents"] for c in commits] == [[], *[[c] for c in commits[:-1]]] and log[commits[0]]["committed_at"] == 1_700_000_000
    assert log[commits[2]]["tree"] == run(root, "rev-parse", f"{commits[2]}^{{tree}}").decode().strip()


def test_historical_references_are_verified(spark, repository):
    root, commits = repository
    found = git.objects(spark, str(root))
    sha = lambda c, p: "sha256:" + hashlib.sha256(run(root, "show", f"{c}:{p}")).hexdigest()
    refs = [("a/long.txt", commits[0], sha(commits[0], "a/long.txt")), ("a/long.txt", commits[5], sha(commits[5], "a/long.txt")), ("a/new0.bin", commits[4], "sha256:0"), ("a/new0.bin", commits[1], sha(commits[1], "a/new0.bin")), ("é/long.txt", commits[2], "sha256:0"), ("a/long.txt", "f" * 40, "x"), ("a/long.txt", None, "x")]
    r = spark.createDataFrame([(p, "historical", h, c) for p, c, h in refs], "ref_path string, reference_scope string, content_hash string, git_commit string")
    live = spark.createDataFrame([("a/long.txt", sha(commits[5], "a/long.txt"))], "path string, content_hash string")
    got = {(x["ref_path"], x["git_commit"]): x["outcome"] for x in integrity.verify(r, live, git.snapshots(found, r)).collect()}
    outcomes = ["SOURCE_CHANGED_SINCE_PIN", "ok", "SOURCE_MISSING", "SOURCE_CHANGED_SINCE_PIN", "HASH_MISMATCH", "SOURCE_MISSING", "SOURCE_UNAVAILABLE"]
    assert got == {(p, c): o for (p, c, _), o in zip(refs, outcomes, strict=True)}


def test_written_objects_are_gits(spark, tmp_path):
    run(tmp_path, "init", "-q", "--bare")
    made = spark.createDataFrame([("blob", bytearray(b"hello")), ("blob", bytearray(b"")), ("blob", bytearray(b"hello"))], "kind string, content binary")
    git.write_loose(made, str(tmp_path))
    assert sorted(r["oid"] for r in git.objects(spark, str(tmp_path)).collect()) == sorted(run(tmp_path, "hash-object", "--stdin-paths", "-t", "blob").decode().split() or ["b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0", "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"])
    assert git.objects(spark, str(tmp_path)).where(F.col("kind") == "blob").count() == 2


@pytest.mark.parametrize("packed, room", [(4096, 64 << 20), (7, 64 << 20), (4096, 300)])
def test_written_packs_are_gits(spark, tmp_path, monkeypatch, packed, room):
    monkeypatch.setattr(git, "PACKED", packed)
    monkeypatch.setattr(git, "ROOM", room)
    run(tmp_path, "init", "-q", "--bare")
    contents = [b"", b"hello", bytes(range(256)) * 400, *[f"text {k}".encode() * k for k in range(40)], b"x" * 15, b"x" * 16, b"x" * 2047, b"x" * 2048]
    made = spark.createDataFrame([("blob", bytearray(c)) for c in contents * 2], "kind string, content binary").repartition(3)
    git.write_packs(made, str(tmp_path))
    want = {hashlib.sha1(f"blob {len(c)}\0".encode() + c).hexdigest(): c for c in contents}
    assert not [p for p in (tmp_path / "objects").iterdir() if len(p.name) == 2]  # no file for each object
    for pack in (tmp_path / "objects" / "pack").glob("*.pack"):
        run(tmp_path, "index-pack", "--strict", "-o", str(tmp_path / f"again-{pack.stem}.idx"), str(pack))
        assert (tmp_path / f"again-{pack.stem}.idx").read_bytes() == pack.with_suffix(".idx").read_bytes()  # git makes the same index
    assert {r["oid"]: bytes(r["content"]) for r in git.objects(spark, str(tmp_path)).collect()} == want
    got = git.digested(spark, str(tmp_path)).collect()
    assert {(r["oid"], r["content_hash"]) for r in got} == {(o, "sha256:" + hashlib.sha256(c).hexdigest()) for o, c in want.items()} and len(got) == len(want)


def test_digested_objects_give_the_same_files(spark, repository):
    root, commits = repository
    asked = spark.createDataFrame([(c,) for c in commits], "git_commit string")
    whole, short = git.objects(spark, str(root)), git.digested(spark, str(root))
    refs = git.files(whole, asked).select(F.col("path").alias("ref_path"), "git_commit")
    assert sorted(git.snapshots(short, refs).collect()) == sorted(git.snapshots(whole, refs).collect())
