"""Verification of recorded references against files, and the checks that reconcile an index with its tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import manifest_digest, ordered_digest

#: Which condition an answer carries when several hold (fixed values).
PRECEDENCE = ("AMBIGUOUS_VERSION", "HASH_MISMATCH", "SOURCE_MISSING", "CANONICAL_SEMANTIC_DRIFT", "DEF_NOT_FOUND", "NOT_FOUND")


def verify(refs: DataFrame, live: DataFrame, snapshots: DataFrame) -> DataFrame:
    """refs (ref_path, reference_scope, content_hash as recorded, git_commit) with computed_hash, outcome and drifted.

    Historical without a commit: SOURCE_UNAVAILABLE. Not found where it should be: SOURCE_MISSING. A recorded hash that
    differs: HASH_MISMATCH (none recorded: not compared). Historical, sound, but the live file differs or is gone:
    SOURCE_CHANGED_SINCE_PIN. Else ok. All references are verified in two joins.
    """
    now = live.select(F.col("path").alias("l_path"), F.col("content_hash").alias("live_hash"))
    then = snapshots.select(F.col("path").alias("s_path"), F.col("git_commit").alias("s_commit"), F.col("content_hash").alias("pinned_hash"))
    r = refs.join(now, refs["ref_path"] == now["l_path"], "left").join(then, (refs["ref_path"] == then["s_path"]) & (refs["git_commit"] == then["s_commit"]), "left")
    old = F.col("reference_scope") == "historical"
    computed = F.when(old, F.col("pinned_hash")).otherwise(F.col("live_hash"))
    recorded = F.coalesce(refs["content_hash"], F.lit("")) != ""
    outcome = (
        F.when(old & refs["git_commit"].isNull(), "SOURCE_UNAVAILABLE")
        .when(computed.isNull(), "SOURCE_MISSING")
        .when(recorded & (refs["content_hash"] != computed), "HASH_MISMATCH")
        .when(old & ~F.col("live_hash").eqNullSafe(computed), "SOURCE_CHANGED_SINCE_PIN")
        .otherwise("ok")
    )
    out = r.withColumns({"computed_hash": computed, "outcome": outcome})
    return out.withColumn("drifted", F.col("outcome") == "SOURCE_CHANGED_SINCE_PIN").select(*refs.columns, "computed_hash", "outcome", "drifted")


def ambiguous(refs: DataFrame) -> DataFrame:
    """(owner, ref_path, anchors): paths that an owner cites by more than one hash and commit."""
    anchor = F.struct(F.coalesce("content_hash", F.lit("")), F.coalesce("git_commit", F.lit("")))
    return refs.groupBy("owner", "ref_path").agg(F.count_distinct(anchor).alias("anchors")).where("anchors > 1")


def sources(refs: DataFrame, live: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Verified references; those of an owner with an ambiguous path are blanked and marked AMBIGUOUS_VERSION."""
    bad = ambiguous(refs).select(F.col("owner").alias("bad")).distinct()
    v = verify(refs, live, snapshots)
    v = v.join(bad, v["owner"] == bad["bad"], "left")
    hide = F.col("bad").isNotNull()
    return v.select("owner", "ref_path", F.when(~hide, F.col("computed_hash")).alias("computed_hash"), F.when(hide, "AMBIGUOUS_VERSION").otherwise(F.col("outcome")).alias("outcome"))


def overall(verified: DataFrame) -> DataFrame:
    """owner, status: fail_closed if a reference fails hard, warning if one only drifted, else success."""
    hard = F.bool_or(~F.col("outcome").isin("ok", "SOURCE_CHANGED_SINCE_PIN"))
    return verified.groupBy("owner").agg(F.when(hard, "fail_closed").when(F.bool_or(F.col("outcome") != "ok"), "warning").otherwise("success").alias("status"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing(registered: DataFrame, live: DataFrame) -> DataFrame:
    """Registered paths without a file."""
    return registered.join(live.select("path"), "path", "left_anti")


def orphans(live: DataFrame, registered: DataFrame) -> DataFrame:
    """Files that no row registers."""
    return live.join(registered.select("path"), "path", "left_anti")


def without_sidecar(paths: DataFrame, live: DataFrame, suffix: str = ".sources.yaml") -> DataFrame:
    """Paths whose sidecar file is missing."""
    want = paths.withColumn("sidecar", F.concat(F.regexp_replace("path", r"\.md$", ""), F.lit(suffix)))
    return want.join(live.select(F.col("path").alias("sidecar")), "sidecar", "left_anti").select("path", "sidecar")


def reconcile(documents: DataFrame, refs: DataFrame, live: DataFrame, snapshots: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """(code, subject, hard): every issue of an index against its tree; with reports (path), those without a sidecar too."""
    row = lambda df, code, subject, hard: df.select(F.lit(code).alias("code"), F.col(subject).alias("subject"), F.lit(hard).alias("hard"))
    verified = verify(refs, live, snapshots).where("outcome <> 'ok'")
    changed = documents.alias("d").join(live.alias("l"), "path").where("d.content_hash <> l.content_hash")
    bare = [] if reports is None else [row(without_sidecar(reports, live), "SIDECAR_MISSING", "path", False)]
    issues = (
        row(changed, "DRIFT_DETECTED", "path", True)
        .unionByName(verified.select(F.col("outcome").alias("code"), F.col("owner").alias("subject"), (~F.col("drifted")).alias("hard")))
        .unionByName(row(duplicates(documents, "id"), "DUPLICATE_ID", "id", True))
        .unionByName(row(missing(documents, live), "SOURCE_MISSING", "path", True))
        .unionByName(row(orphans(live, documents), "ORPHAN", "path", False))
    )
    return reduce(DataFrame.unionByName, bare, issues)


def condition(targets: DataFrame) -> DataFrame:
    """targets (ref and flags ambiguous, mismatch, missing, tampered, found) with the one condition that answers it.

    In order: a lock that is held (column locked, if there is one), AMBIGUOUS_VERSION, for targets that cite sources the worst of their outcomes (column source_error, if there is one), HASH_MISMATCH,
    SOURCE_MISSING, CANONICAL_SEMANTIC_DRIFT (to be reviewed), an index that has drifted from its tree (column drifted, if there is one), then not found.
    """
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in targets.columns else F.lit(False)
    source = F.col("source_error") if "source_error" in targets.columns else F.lit(None).cast("string")
    named = F.when(F.col("ref").startswith("definition:") | F.contains("ref", F.lit("@v")), "DEF_NOT_FOUND").otherwise("NOT_FOUND")
    error = F.when(flag("locked"), "TX_LOCKED").when(flag("ambiguous"), PRECEDENCE[0]).when(source.isNotNull(), source)
    error = error.when(flag("mismatch"), PRECEDENCE[1]).when(flag("missing"), PRECEDENCE[2]).when(flag("tampered"), PRECEDENCE[3]).when(flag("drifted"), "DRIFT_DETECTED").when(~flag("found"), named)
    status = F.when(error.isNull(), "success").when(error == PRECEDENCE[3], "review_required").otherwise("fail_closed")
    return targets.select("ref", status.alias("status"), error.alias("error_semantic"))


def violations(claims: DataFrame, objects: DataFrame, edges: DataFrame, gold: DataFrame) -> DataFrame:
    """(code, claim_id): what an answer's rows assert that isn't so.

    claims: claim_id, entity_id, version_ref, content_hash, git_commit; a null asserts nothing.
    """
    v = objects.select(F.col("version_ref").alias("v")).where("v is not null").distinct()
    e = objects.select(F.col("entity_id").alias("e")).distinct()
    o = objects.select(F.col("version_ref").alias("o_ref"), F.col("content_hash").alias("o_hash"), F.col("git_commit").alias("o_commit"))
    row = lambda df, code: df.select(F.lit(code).alias("code"), "claim_id")
    matched = claims.join(o, claims["version_ref"] == o["o_ref"])
    no_entity = claims.where("entity_id is not null").join(e, claims["entity_id"] == e["e"], "left_anti")
    no_version = claims.where("version_ref is not null").join(v, claims["version_ref"] == v["v"], "left_anti")
    other = edges.join(gold, ["source_ref", "relation", "target_ref"], "left_anti")
    return (
        row(no_entity, "PHANTOM_ENTITY_ASSERTED")
        .unionByName(row(no_version, "PHANTOM_VERSION_ASSERTED"))
        .unionByName(row(matched.where((F.col("content_hash") != F.col("o_hash")) | (F.col("content_hash").isNotNull() & F.col("o_hash").isNull())), "FABRICATED_CONTENT_HASH"))
        .unionByName(row(matched.where((F.col("git_commit") != F.col("o_commit")) | (F.col("git_commit").isNotNull() & F.col("o_commit").isNull())), "FABRICATED_GIT_COMMIT"))
        .unionByName(row(other, "FABRICATED_PROVENANCE_EDGE"))
    )


def unverified_facts(asserted: DataFrame, facts: DataFrame, authority: str) -> DataFrame:
    """Asserted facts that are none, where the answer calls itself authoritative."""
    found = asserted.join(facts.select("subject", "predicate", "value").distinct(), ["subject", "predicate", "value"], "left_anti")
    return found.where(F.lit(authority == "authoritative")).withColumn("code", F.lit("UNVERIFIED_FACT_ASSERTED_AS_AUTHORITATIVE"))


def silent_ambiguity(answers: DataFrame) -> DataFrame:
    """Answers (answer_id, expected_error, status, rows) that assert something where the version is ambiguous."""
    bad = (F.col("expected_error") == "AMBIGUOUS_VERSION") & (F.col("status") != "fail_closed") & (F.col("rows") > 0)
    return answers.where(bad).select(F.lit("AMBIGUITY_SILENTLY_RESOLVED").alias("code"), F.col("answer_id").alias("claim_id"))


def substituted(answers: DataFrame, pinned: DataFrame) -> DataFrame:
    """Answers whose rows (answer_id, ref, content_hash, git_commit) aren't just those pinned for them."""
    key = ["answer_id", "ref", "content_hash", "git_commit"]
    a, p = answers.select(*key).distinct(), pinned.select(*key).distinct()
    both = a.withColumn("side", F.lit(1)).unionByName(p.withColumn("side", F.lit(2))).groupBy(*key).agg(F.sum("side").alias("s")).where("s <> 3")
    asked = p.select("answer_id").distinct()
    return both.join(asked, "answer_id", "left_semi").select(F.lit("HISTORICAL_SOURCE_SUBSTITUTION").alias("code"), F.col("answer_id").alias("claim_id")).distinct()


def chain_faults(events: DataFrame, order: str, digest: str, previous: str) -> DataFrame:
    """Events whose previous digest isn't the digest of the event before, or of nothing for the first; keyed chains by entity keep each window small."""
    w = Window.partitionBy("entity_id").orderBy(order)
    before = F.lag(digest).over(w)
    return events.withColumn("expected", before).where(~F.col(previous).eqNullSafe(F.col("expected")))


def path_snapshot(files: DataFrame, under: str) -> DataFrame:
    """(n, digest) of the files whose path lies under a folder, by their paths from there on; another folder with the same files has the same digest."""
    inside = files.where(F.col("path").startswith(under.rstrip("/") + "/"))
    rel = inside.select(F.lit("all").alias("all"), F.substring("path", len(under.rstrip("/")) + 2, 1 << 20).alias("rel"), "content_hash")
    return manifest_digest(rel, "all", "rel", "content_hash").drop("all")


def exists_at(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """wanted (git_commit, path) with what a commit has there: file, directory (files below it), or null."""
    s = snapshots.select("git_commit", "path", F.lit(1).alias("_f"))
    parents = snapshots.select("git_commit", F.explode(_folders(F.col("path"))).alias("path")).distinct().withColumn("_d", F.lit(1))
    j = wanted.withColumn("path", F.regexp_replace("path", "/+$", "")).join(s, ["git_commit", "path"], "left").join(parents, ["git_commit", "path"], "left")
    return j.select("git_commit", "path", F.when(F.col("_f").isNotNull(), "file").when(F.col("_d").isNotNull(), "directory").alias("kind"))


def _folders(path):
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def directory_at(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """(git_commit, directory, n, digest): the digest of the directory's files as a commit has them; wanted: git_commit, path."""
    w = wanted.select("git_commit", F.regexp_replace("path", "/+$", "").alias("directory")).distinct()
    inside = snapshots.select("git_commit", "path", "content_hash", F.explode(_folders(F.col("path"))).alias("directory")).join(w, ["git_commit", "directory"])
    rel = F.expr("substring(path, length(directory) + 2)")
    lines = inside.select("git_commit", "directory", rel.alias("rel"), F.concat(rel, F.lit(":"), F.regexp_replace("content_hash", "^sha256:", "")).alias("line"))
    return ordered_digest(lines, ["git_commit", "directory"], ["rel"], "line")
