"""Event logs and what follows from them: idempotency, recovery, receipts, authorisation, folded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import dependents


def next_ids(ids: DataFrame, column: str, width: int = 6) -> DataFrame:
    """(prefix, next_id): of each prefix the number after the highest, padded; ids without a number don't count."""
    parts = ids.select(F.regexp_extract(column, r"^(.*-)(\d+)$", 1).alias("prefix"), F.try_to_number(F.nullif(F.regexp_extract(column, r"^(.*-)(\d+)$", 2), F.lit("")), F.lit("999999999999")).cast("long").alias("n"))
    top = parts.where("n is not null").groupBy("prefix").agg(F.max("n").alias("n"))
    return top.select("prefix", F.concat("prefix", F.lpad((F.col("n") + 1).cast("string"), width, "0")).alias("next_id"))


def idempotency(requests: DataFrame, log: DataFrame) -> DataFrame:
    """requests (key, fingerprint) with outcome: miss, replay (same, with receipt), incomplete (same, none), conflict (another request has the key)."""
    l = log.groupBy("key").agg(F.min("fingerprint").alias("f"), F.count_distinct("fingerprint").alias("n"), F.bool_or("committed").alias("committed"))  # noqa: E741
    r = requests.join(l, "key", "left")
    out = F.when(F.col("n").isNull(), "miss").when((F.col("n") > 1) | (F.col("f") != F.col("fingerprint")), "conflict").when(F.col("committed"), "replay").otherwise("incomplete")
    return r.select("key", "fingerprint", out.alias("outcome"))


def recovery(plan: DataFrame, observed: DataFrame) -> DataFrame:
    """(tx, action, n): what to do with an interrupted transaction, from its plan (tx, path, before, after) and the hashes seen.

    All files as before: abort. All as after: complete. Each one of the two: resume. Any other content: hold for a person.
    """
    p = plan.join(observed.select(F.col("path").alias("seen"), F.col("content_hash").alias("now")), plan["path"] == F.col("seen"), "left")
    old, new = F.col("now").eqNullSafe(F.col("before")), F.col("now").eqNullSafe(F.col("after"))
    g = p.groupBy("tx").agg(F.bool_and(old).alias("old"), F.bool_and(new).alias("new"), F.bool_or(~old & ~new).alias("alien"), F.count("*").alias("n"))
    return g.select("tx", F.when(F.col("alien"), "hold").when(F.col("new"), "complete").when(F.col("old"), "abort").otherwise("resume").alias("action"), "n")


def receipt_faults(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """(event_id, rule): the first rule that an event's receipt breaks: present, once, transaction, event hash, output, time."""
    r = receipts.groupBy("event_id").agg(*[F.min(c).alias(f"r_{c}") for c in ("transaction_id", "event_hash", "output_digest", "committed_at")], F.count("*").alias("n"))
    j = events.join(r, "event_id", "left")
    rule = (
        F.when(F.col("n").isNull(), "a_missing").when(F.col("n") > 1, "b_repeated").when(~F.col("transaction_id").eqNullSafe(F.col("r_transaction_id")), "c_transaction")
        .when(~F.col("event_hash").eqNullSafe(F.col("r_event_hash")), "d_event_hash").when(~F.col("output_digest").eqNullSafe(F.col("r_output_digest")), "e_output").when(F.col("r_committed_at") < F.col("occurred_at"), "f_time")
    )
    return j.select("event_id", rule.alias("rule")).where("rule is not null")


def authorise(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """requests (request_id, auth_ref, actor, scope) with outcome, by the first rule that fails: existence, grantee, scope (equal, no part), validity."""
    g = registry.select(F.col("ref").alias("g_ref"), "grantee", F.col("scope").alias("granted"), "valid")
    r = requests.join(g, requests["auth_ref"] == g["g_ref"], "left")
    out = F.when(F.col("g_ref").isNull(), "AUTH_MISSING").when(F.col("grantee") != F.col("actor"), "AUTH_GRANTEE").when(F.col("granted") != F.col("scope"), "AUTH_SCOPE").when(~F.col("valid"), "AUTH_INVALID").otherwise("ok")
    return r.select("request_id", out.alias("outcome"))


def latest(events: DataFrame, by: str, order: str, *values: str) -> DataFrame:
    """(by, order, values): of each entity its last event's."""
    return events.groupBy(by).agg(F.max_by(F.struct(order, *values), order).alias("e")).select(by, "e.*")


def materialise(log: DataFrame) -> DataFrame:
    """The event table from its log: each id once, the first line of it, in order. Run again, it gives the same."""
    w = Window.partitionBy("event_id").orderBy("occurred_at", "subject")
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rebuild_markers(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """Committed events from the log: those whose receipt breaks no rule."""
    return events.join(receipt_faults(events, receipts), "event_id", "left_anti")


def fold(state: DataFrame, mutations: DataFrame) -> DataFrame:
    """state (ref, status, content_hash) after mutations (ref, step, kind, value): of each field the last mutation counts.

    Kinds: set_status, set_hash, remove, add. A removal drops what came before it; an add after it brings the object back.
    """
    last = lambda kind, name: F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.col("step"))).alias(name)
    at = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col("step"))).alias(name)
    m = mutations.groupBy(F.col("ref").alias("m_ref")).agg(last("set_status", "new_status"), last("set_hash", "new_hash"), at("remove", "removed"), at("add", "added"))
    j = state.join(m, state["ref"] == m["m_ref"], "full")
    alive = F.coalesce(F.col("added"), F.lit(-1)) > F.coalesce(F.col("removed"), F.lit(-1))
    j = j.where(F.when(F.col("ref").isNull(), alive).otherwise(F.col("removed").isNull() | alive))
    return j.select(F.coalesce("ref", "m_ref").alias("ref"), F.coalesce("new_status", "status").alias("status"), F.coalesce("new_hash", "content_hash").alias("content_hash"))


# Kinds of mutations and the set that each puts its target into; those of the index change its state (fixed values).
MARKS = {
    "external_update": ("changed",), "semantic_change": ("changed",), "raw_invalidation": ("invalid", "changed"), "create_version": ("changed",), "duplicate_version": ("ambiguous",),
    "delete_file": ("missing",), "tamper_file": ("mismatched",), "runtime_deviation": ("mismatched",), "create_file": ("orphan",), "semantic_tamper": ("tampered",),
}
INDEX = {"create_file": "stale", "touch_file": "stale", "corrupt_index": "stale", "delete_tree": "missing"}


def marks(mutations: DataFrame, objects: DataFrame, relations: DataFrame) -> DataFrame:
    """(ref, mark) after mutations (step, kind, target): what each of the kinds marks, and as stale whatever depends on an invalidated object at any distance.

    A version is marked ambiguous by its entity. A target that is no object (but for new files, versions and trees) is marked unknown instead.
    """
    table = F.create_map(*[x for k, v in MARKS.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))])
    known = objects.select(F.col("ref").alias("k")).union(objects.select("entity_id")).distinct()
    m = mutations.where(F.col("kind").isin(*MARKS)).join(known, F.col("target") == F.col("k"), "left")
    free = F.col("kind").isin("create_file", "create_version")
    given = m.select(F.col("target").alias("ref"), F.explode(F.when(free | F.col("k").isNotNull(), F.element_at(table, F.col("kind"))).otherwise(F.array(F.lit("unknown")))).alias("mark"))
    sick = m.where("kind = 'raw_invalidation' and k is not null").select(F.col("target").alias("ref")).distinct()
    return given.unionByName(dependents(relations, sick).select("ref", F.lit("stale").alias("mark"))).distinct()


def index_state(mutations: DataFrame) -> DataFrame:
    """(state): present, stale or missing, by the last mutation that changes it; index brings it back, and a tree that is deleted counts if it is the index's own."""
    table = F.create_map(*[x for k, v in INDEX.items() for x in (F.lit(k), F.lit(v))])
    state = F.when(F.col("kind") == "index", "present").when((F.col("kind") != "delete_tree") | (F.col("target") == ".index"), F.element_at(table, F.col("kind")))
    return mutations.select("step", state.alias("state")).where("state is not null").agg(F.coalesce(F.max_by("state", "step"), F.lit("present")).alias("state"))


def transitions(states: DataFrame, legal: list[tuple[str, str]]) -> DataFrame:
    """Steps (entity_id, step, state) that no legal edge allows."""
    before = F.lag("state").over(Window.partitionBy("entity_id").orderBy("step"))
    edges = states.sparkSession.createDataFrame(legal, "before string, state string")
    return states.withColumn("before", before).where("before is not null").join(edges, ["before", "state"], "left_anti")
