"""Events, their receipts and what rests on them, as rules over tables: the first rule that a row breaks names its fault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import file_digest, ordered_digest

REVISED, FROZEN = "DefinitionRevised", "ReportFrozen"
#: Keys that a definition's wrapping sets, so that a body may not (fixed values).
RESERVED = ("entity_id", "version_ref", "previous", "schema_version")


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition holds; null for none. A condition that is null doesn't hold."""
    return F.coalesce(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in rules])


def same(a: str | Column, b: str | Column) -> Column:
    return (F.col(a) if isinstance(a, str) else a).eqNullSafe(F.col(b) if isinstance(b, str) else b)


def digest_of(**fields: Column) -> Column:
    """The digest of a document of these fields in canonical form: keys in order, nulls left out."""
    return file_digest(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])))


def entity_of(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^(.*)@v[0-9]+$", 1)


def version_of(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, r"@v([0-9]+)$", 1), F.lit("")).cast("int")


def successor(ref: Column) -> Column:
    """The next version of a version's reference; null for what isn't one."""
    return F.concat(entity_of(ref), F.lit("@v"), (version_of(ref) + 1).cast("string"))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _live(df: DataFrame, files: DataFrame, path: str, name: str) -> DataFrame:
    """df with the hash that the file at a path has now; null where there is none."""
    return df.join(files.select(F.col("path").alias("_path"), F.col("content_hash").alias(name)), F.col(path) == F.col("_path"), "left").drop("_path")


def freeze_faults(events: DataFrame, receipts: DataFrame, files: DataFrame) -> DataFrame:
    """(event_id, fault): of each receipt of a frozen report, or event without one, the first rule broken; null for none.

    events: event_id, transaction_id, event_hash (of the file as it is), report_path, report_hash, manifest_path, manifest_hash, current_hash, as the event declares them.
    receipts: event_id (of the file's name), inner_id, transaction_id, event_hash, report_hash, manifest_hash, current_after_hash, output_digest. files: path, content_hash.
    """
    e, r = _prefixed(events, "e_"), _prefixed(receipts, "r_")
    j = e.join(r, e["e_event_id"] == r["r_event_id"], "full")
    j = _live(_live(j, files, "e_report_path", "report_now"), files, "e_manifest_path", "manifest_now")
    outputs = digest_of(report_hash=F.col("r_report_hash"), manifest_hash=F.col("r_manifest_hash"), current_after_hash=F.col("r_current_after_hash"))
    # Faults in the order in which they are told (fixed values).
    fault = first_broken([
        ("event-missing", F.col("e_event_id").isNull()),
        ("receipt-missing", F.col("r_event_id").isNull()),
        ("event-id-mismatch", ~same("r_inner_id", "r_event_id")),
        ("tx-id-mismatch", ~same("r_transaction_id", "e_transaction_id")),
        ("event-hash-mismatch", ~same("r_event_hash", "e_event_hash")),
        ("report-hash-mismatch", ~same("r_report_hash", "e_report_hash")),
        ("manifest-hash-mismatch", ~same("r_manifest_hash", "e_manifest_hash")),
        ("report-file-mismatch", ~same("r_report_hash", "report_now")),
        ("manifest-file-mismatch", ~same("r_manifest_hash", "manifest_now")),
        ("output-digest-mismatch", ~same(F.col("r_output_digest"), outputs)),
        ("current-after-mismatch", ~same("r_current_after_hash", "e_current_hash")),
    ])
    return j.select(F.coalesce("e_event_id", "r_event_id").alias("event_id"), fault.alias("fault"))


def revision_faults(events: DataFrame, receipts: DataFrame, definitions: DataFrame, pins: DataFrame) -> DataFrame:
    """(event_id, subject, fault, definition_hash): of each receipt of a revised definition, or event without one, the first rule broken; null for none.

    events: event_id (of the file's name), inner_id, transaction_id, event_hash, subject, previous, definition_path, definition_hash, proposed_hash, approved_before_hash,
    previous_path, previous_hash, as the event declares them. receipts: event_id, inner_id, transaction_id, event_hash, definition_hash, approved_before_hash,
    approved_after_hash, approved_ref_after, output_digest. definitions: path, content_hash, entity_id, version_ref, previous of the files as they are. pins: path, content_hash as committed at the start.
    A predecessor's authority is the definition hash of its own event's receipt, if there is such an event: where that receipt is broken there is none, and so on up
    the chain; without an event it is its pin, if the file is still as pinned.
    """
    e, r = _prefixed(events, "e_"), _prefixed(receipts, "r_")
    j = e.join(r, e["e_event_id"] == r["r_event_id"], "full").join(_prefixed(definitions, "d_"), F.col("e_definition_path") == F.col("d_path"), "left")
    outputs = digest_of(**{k: F.col(f"r_{k}") for k in ("event_hash", "definition_hash", "approved_after_hash", "approved_ref_after")})
    subject, previous = F.col("e_subject"), F.col("e_previous")
    file_name = F.regexp_extract("e_definition_path", "([^/]+)$", 1)
    # Faults in the order in which they are told (fixed values).
    rules = [
        ("event-missing", F.col("e_event_id").isNull()),
        ("receipt-missing", F.col("r_event_id").isNull()),
        ("event-id-mismatch", ~same("r_inner_id", "r_event_id")),
        ("event-internal-id-mismatch", ~same("e_inner_id", "e_event_id")),
        ("tx-id-mismatch", ~same("r_transaction_id", "e_transaction_id")),
        ("event-hash-mismatch", ~same("r_event_hash", "e_event_hash")),
        ("definition-output-ref-missing", F.col("e_definition_path").isNull()),
        ("definition-hash-mismatch", ~same("r_definition_hash", "d_content_hash")),
        ("output-refs-definition-hash-mismatch", ~same("e_definition_hash", "r_definition_hash")),
        ("proposed-definition-hash-mismatch", ~same("e_proposed_hash", "r_definition_hash")),
        ("approved-ref-after-mismatch", ~same("r_approved_ref_after", "e_subject")),
        ("approved-before-hash-mismatch", ~same("r_approved_before_hash", "e_approved_before_hash")),
        ("output-digest-mismatch", ~same(F.col("r_output_digest"), outputs)),
        ("subject-not-successor-of-previous", ~same(subject, successor(previous))),
        ("definition-path-basename-mismatch", ~same(file_name, F.concat(subject, F.lit(".yaml")))),
        ("definition-entity-id-mismatch", ~same(F.col("d_entity_id"), entity_of(subject))),
        ("definition-version-ref-mismatch", ~same(F.col("d_version_ref"), subject)),
        ("definition-previous-mismatch", ~same(F.col("d_previous"), previous)),
        ("previous-input-ref-missing", F.col("e_previous_path").isNull()),
        ("previous-input-ref-path-mismatch", ~same(F.col("e_previous_path"), F.concat(F.lit("definitions/"), entity_of(previous), F.lit("/"), previous, F.lit(".yaml")))),
    ]
    local = j.select(F.coalesce("e_event_id", "r_event_id").alias("event_id"), subject.alias("subject"), previous.alias("previous"), "e_previous_path", "e_previous_hash", F.col("r_definition_hash").alias("definition_hash"), first_broken(rules).alias("local"))
    before = local.select(F.col("subject").alias("b_subject"), F.col("definition_hash").alias("b_hash")).where("b_subject is not null").dropDuplicates(["b_subject"])
    pinned = pins.select(F.col("path").alias("p_path"), F.col("content_hash").alias("p_hash"))
    now = definitions.select(F.col("path").alias("n_path"), F.col("content_hash").alias("n_hash"))
    g = local.join(before, local["previous"] == before["b_subject"], "left").join(pinned, F.col("e_previous_path") == F.col("p_path"), "left").join(now, F.col("e_previous_path") == F.col("n_path"), "left")
    chained = F.col("b_subject").isNotNull()
    own = F.coalesce("local", F.when(~chained & ~F.coalesce(F.col("p_hash") == F.col("n_hash"), F.lit(False)), "previous-authority-missing"), F.when(~same(F.col("e_previous_hash"), F.when(chained, F.col("b_hash")).otherwise(F.col("p_hash"))), "previous-input-ref-authority-mismatch"))
    g = g.withColumns({"own": own, "entity": entity_of(F.col("subject")), "version": version_of(F.col("subject")), "starts": (~chained).cast("int")})
    line = Window.partitionBy("entity").orderBy("version", "event_id")  # a chain is a run of an entity's versions, each with an event
    g = g.withColumn("run", F.sum("starts").over(line))
    above = Window.partitionBy("entity", "run").orderBy("version", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    broken = chained & F.coalesce(F.max(F.col("own").isNotNull()).over(above), F.lit(False))
    fault = F.coalesce("local", F.when(broken, "previous-authority-missing"), "own")
    return g.select("event_id", "subject", fault.alias("fault"), "definition_hash")


def predecessor_authority(asked: DataFrame, faults: DataFrame, pins: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, authority, origin, condition) of versions asked for (ref, path): the hash of the valid receipt of the event whose subject they are, else the pin, never both.

    An event whose receipt is broken leaves none (PROVENANCE_BROKEN); without an event, so does a version without a pin, and one whose file isn't as pinned has DEF_POINTER_DIVERGED.
    """
    of = faults.where("subject is not null").groupBy("subject").agg(F.max(F.when(F.col("fault").isNull(), F.col("definition_hash"))).alias("receipt_hash"))
    j = asked.join(of, asked["ref"] == of["subject"], "left").join(pins.select(F.col("path").alias("p"), F.col("content_hash").alias("pin")), asked["path"] == F.col("p"), "left")
    j = _live(j, files, "path", "now")
    event = F.col("subject").isNotNull()
    authority = F.when(event, F.col("receipt_hash")).when(same("pin", "now"), F.col("pin"))
    condition = F.when(event & F.col("receipt_hash").isNull() | (~event & F.col("pin").isNull()), "PROVENANCE_BROKEN").when(~event & ~same("pin", "now"), "DEF_POINTER_DIVERGED")
    return j.select("ref", authority.alias("authority"), F.when(authority.isNull(), None).when(event, "receipt").otherwise("pin").alias("origin"), condition.alias("condition"))


def bootstrap_faults(pins: DataFrame, files: DataFrame) -> DataFrame:
    """(path, code): files of a start whose content isn't as pinned, or that only one of both has; a pin or file that can't be read (null hash) is PROVENANCE_BROKEN."""
    p, f = pins.select(F.col("path").alias("a"), F.col("content_hash").alias("pin"), F.lit(1).alias("pinned")), files.select(F.col("path").alias("b"), F.col("content_hash").alias("now"), F.lit(1).alias("there"))
    j = p.join(f, p["a"] == f["b"], "full")
    unread = (F.col("pinned").isNotNull() & F.col("pin").isNull()) | (F.col("there").isNotNull() & F.col("now").isNull())
    code = F.when(unread, "PROVENANCE_BROKEN").when(~same("pin", "now"), "DEF_POINTER_DIVERGED")
    return j.select(F.coalesce("a", "b").alias("path"), code.alias("code")).where("code is not null")


def wrap_faults(inputs: DataFrame) -> DataFrame:
    """(request, fault) of revisions asked for (request, entity, expected, subject, keys of the body; inner_entity, inner_version, inner_previous of the staged file): reserved keys, then identity; null for none."""
    fault = first_broken([
        ("DEF_PAYLOAD_MISMATCH", F.arrays_overlap("keys", F.array(*[F.lit(k) for k in RESERVED]))),
        ("DEF_IDENTITY_MISMATCH", ~same("inner_entity", "entity") | ~same("inner_version", "subject") | ~same("inner_previous", "expected")),
        ("DEF_SUCCESSOR_MISMATCH", ~same(F.col("subject"), successor(F.col("expected")))),
    ])
    return inputs.select("request", fault.alias("fault"))


def markers(faults: DataFrame, events: DataFrame, existing: DataFrame) -> DataFrame:
    """(event_id, transaction_id, state): of each event with a sound receipt, whether its marker (transaction_id) stands or is to be rebuilt; others are needs_reconcile."""
    m = existing.select(F.col("transaction_id").alias("m")).distinct()
    j = events.select("event_id", "transaction_id").join(faults.select("event_id", "fault"), "event_id").join(m, F.col("transaction_id") == F.col("m"), "left")
    return j.select("event_id", "transaction_id", F.when(F.col("fault").isNotNull(), "needs_reconcile").when(F.col("m").isNull(), "rebuilt").otherwise("committed").alias("state"))


def pointer_faults(pointers: DataFrame, faults: DataFrame, receipts: DataFrame) -> DataFrame:
    """(entity_id, code): current pointers (entity_id, ref, content_hash; ref null if it can't be read) against each entity's last sound revision, whose receipt says what they should be."""
    r = receipts.select(F.col("event_id").alias("r_event"), "approved_ref_after", "approved_after_hash")
    sound = faults.where("fault is null and subject is not null").join(r, F.col("event_id") == F.col("r_event"))
    last = sound.groupBy(entity_of(F.col("subject")).alias("entity")).agg(F.max_by(F.struct("approved_ref_after", "approved_after_hash"), version_of(F.col("subject"))).alias("want"))
    j = last.join(pointers.withColumn("there", F.lit(True)), last["entity"] == pointers["entity_id"], "left")
    code = first_broken([
        ("PROVENANCE_BROKEN", F.col("there").isNull() | F.col("ref").isNull()),
        ("DEF_POINTER_DIVERGED", ~same("ref", "want.approved_ref_after") | ~same("content_hash", "want.approved_after_hash")),
    ])
    return j.select(F.col("entity").alias("entity_id"), code.alias("code")).where("code is not null")


def tx_issues(recoveries: DataFrame, marked: DataFrame, existing: DataFrame, events: DataFrame, receipts: DataFrame, approvals: DataFrame, current: DataFrame, pointers: DataFrame, faults: DataFrame, starts: DataFrame) -> DataFrame:
    """(check, subject, code): what is wrong with the transactions as a whole, by seven checks; aborted and completed ones are clean.

    recoveries (tx, action); marked by markers(); existing markers (transaction_id); approvals as committed (approval_ref, digest), which events (event_id, transaction_id, subject, approval_ref,
    approval_digest) claim; current (report): the report that the current one's region names; pointers and faults as in pointer_faults(); starts by bootstrap_faults().
    """
    row = lambda df, check, subject, code: df.select(F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject"), (F.col(code) if code in df.columns else F.lit(code)).alias("code"))
    unresolved = recoveries.where("action in ('hold', 'resume')")
    lost = marked.where("state = 'needs_reconcile'")
    ids = receipts.select(F.col("event_id").alias("r"))
    orphaned = existing.join(events.select("event_id", F.col("transaction_id").alias("t")), F.col("transaction_id") == F.col("t")).join(ids, F.col("event_id") == F.col("r"), "left_anti")
    last = events.where("subject like 'REPORT-%'").join(faults.where("fault is null").select(F.col("event_id").alias("sound")), F.col("event_id") == F.col("sound"), "left_semi").agg(F.max("subject").alias("last"))
    region = current.join(F.broadcast(last), ~same("report", "last"))  # one row each
    claims = events.where("approval_digest is not null").join(faults.where("fault is null").select(F.col("event_id").alias("s")), F.col("event_id") == F.col("s"), "left_semi")
    evidence = claims.join(approvals.select(F.col("approval_ref").alias("a"), F.col("digest").alias("given")), F.col("approval_ref") == F.col("a"), "left").where(~same("approval_digest", "given"))
    parts = [
        row(unresolved, "recovery", "tx", "NEEDS_RECONCILE"), row(lost, "receipt", "event_id", "NEEDS_RECONCILE"), row(orphaned, "marker", "transaction_id", "PROVENANCE_BROKEN"),
        row(region, "current", "report", "CURRENT_CONFLICT"), row(evidence, "approval", "event_id", "APPROVAL_EVIDENCE_MISMATCH"),
        row(pointer_faults(pointers, faults, receipts), "pointer", "entity_id", "code"), row(starts, "bootstrap", "path", "code"),
    ]
    return reduce(DataFrame.unionByName, parts)


def commitments(rows: DataFrame, by: str, order: str, *fields: str) -> DataFrame:
    """(by, n, digest): of each group the digest of its rows' digests in the order of their bytes; a digest that stands twice makes it null (it is rejected)."""
    each = rows.select(by, F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted({order, *fields})])), 256).alias("d"))
    return ordered_digest(each.withColumn("line", F.col("d")), [by], ["d"], "line", unique=True)
