"""The engine's public operations over a state of tables; each answers with an envelope that fails closed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, history, integrity, lookup, semantic, transactions
from .envelope import Envelope

# What changed dependents of a definition may be (fixed values).
DEPENDENT_KINDS = ("organized_result", "report", "run", "experiment_spec", "source_binding")


@dataclass
class State:
    """Tables: objects (ref, kind, entity_id, version_ref, path, status, content_hash, git_commit, lifecycle_start), facts (fact_id, subject, predicate, value,
    occurred_at), relations (source_ref, relation, target_ref), atoms (atom_id, artifact_ref, kind), externals (ref, pinned_hash, pinned_value), log of events;
    and what is known to be wrong."""

    objects: DataFrame
    facts: DataFrame
    relations: DataFrame
    atoms: DataFrame
    externals: DataFrame
    log: DataFrame | None = None
    index_state: str = "present"
    lock_held: bool = False
    ambiguous: frozenset[str] = field(default_factory=frozenset)
    missing: frozenset[str] = field(default_factory=frozenset)
    mismatched: frozenset[str] = field(default_factory=frozenset)
    tampered: frozenset[str] = field(default_factory=frozenset)
    orphans: frozenset[str] = field(default_factory=frozenset)
    stale: frozenset[str] = field(default_factory=frozenset)
    #: Tells why the index doesn't stand for its tree, or None; asked before each operation that reads it.
    freshness: Callable[[], str | None] | None = None
    #: Builds the index anew and returns its watermark.
    rebuild: Callable[[], dict] | None = None
    #: Recovers interrupted transactions and returns the issues (check, subject, code) that are left.
    transactions: Callable[[], DataFrame] | None = None
    #: Holds the index's tables against the tree and returns the issues (code, subject).
    issues: Callable[[], DataFrame] | None = None


class Engine:
    def __init__(self, state: State):
        self.state = state

    # -- parts that operations share

    def _object(self, locator: str) -> DataFrame:
        o = self.state.objects
        return lookup.unique_object(o, locator.removeprefix("definition:"))

    def _set(self, refs: frozenset[str]) -> DataFrame:
        return self.state.objects.sparkSession.createDataFrame([(r,) for r in sorted(refs)], "ref string")

    def _rows(self, objects: DataFrame) -> DataFrame:
        return lookup.overlay(objects, self._set(self.state.stale), self._set(self.state.missing))

    def _gate(self) -> list[str]:
        """An index that doesn't stand for its tree answers nothing."""
        code = self.state.freshness() if self.state.freshness else None
        return [code] if code else []

    def _errors(self, locator: str) -> list[str]:
        """The condition that a locator's answer carries, by precedence; one row decides."""
        s = self.state
        o = self._object(locator).select("ref", "entity_id").first()
        ref, entity = (o["ref"], o["entity_id"]) if o else (locator, locator)
        flags = [(ref, entity in s.ambiguous, ref in s.mismatched, ref in s.missing, ref in s.tampered, o is not None)]
        row = integrity.condition(s.objects.sparkSession.createDataFrame(flags, "ref string, ambiguous boolean, mismatch boolean, missing boolean, tampered boolean, found boolean")).first()
        code = row["error_semantic"]
        return [{"CANONICAL_SEMANTIC_DRIFT": "DRIFT_DETECTED", "DEF_NOT_FOUND": "NOT_FOUND"}.get(code, code)] if code else []

    def _answer(self, name: str, results: DataFrame, locator: str | None = None, **more) -> Envelope:
        errors = self._gate() or (self._errors(locator) if locator is not None else [])
        return Envelope(name, results, errors=errors, **more)

    def _subject(self, locator: str) -> DataFrame:
        return self.state.facts.join(self._object(locator).select(F.col("ref").alias("_r")), F.col("subject") == F.col("_r"), "left_semi")

    # -- operations

    def query_entity(self, locator: str) -> Envelope:
        return self._answer("query_entity", self._rows(self._object(locator)), locator)

    def query_exact_routing(self, locator: str) -> Envelope:
        return self._answer("query_exact_routing", self._rows(self.state.objects.where(F.col("ref") == locator)), locator)

    def query_project_current(self, locator: str) -> Envelope:
        return self._answer("query_project_current", self._rows(self._object(locator)), locator)

    def query_project_index(self, locator: str) -> Envelope:
        return self._answer("query_project_index", self._object(locator), locator)

    def query_facts(self, locator: str, predicates: list[str] | None = None, as_of: str | None = None) -> Envelope:
        return self._answer("query_facts", lookup.facts(self._subject(locator), None, predicates, as_of), locator)

    def query_lineage(self, locator: str) -> Envelope:
        bound = self._subject(locator).where("predicate = 'bound_version'")
        o = self._object(locator).select("entity_id").first()
        versions = self.state.objects.where(F.col("entity_id") == (o["entity_id"] if o else None)).where("version_ref is not null")
        number = F.regexp_extract("version_ref", r"v(\d+)$", 1).cast("int")
        chain = versions.select("entity_id", number.alias("version"), "version_ref").join(self.state.relations.where("relation = 'supersedes'").select(F.col("source_ref").alias("version_ref"), F.col("target_ref").alias("previous")), "version_ref", "left")
        rows = graph.lineage(chain)
        return self._answer("query_lineage", rows.join(bound.select(F.col("value").alias("version_ref"), F.lit(True).alias("bound")), "version_ref", "left"), locator)

    def query_state(self, locator: str) -> Envelope:
        return self._answer("query_state", self._rows(self._object(locator)).select("ref", "status", "is_stale"), locator)

    def query_external_basis(self, locator: str) -> Envelope:
        pinned = self._subject(locator).where("predicate = 'authority_source'")
        e = self.state.externals
        return self._answer("query_external_basis", pinned.join(e, pinned["value"] == e["ref"]).select("subject", e["ref"], "pinned_hash", "pinned_value"), locator)

    def query_sources(self, locator: str, relation_types: list[str] | None = None) -> Envelope:
        edges = self.state.relations.join(self._object(locator).select("ref"), F.col("source_ref") == F.col("ref"), "left_semi")
        if relation_types:
            edges = edges.where(F.col("relation").isin(relation_types))
        o = self.state.objects
        rows = edges.join(o, edges["target_ref"] == o["ref"]).select("entity_id", F.lit(None).cast("string").alias("version_ref"), "path", "content_hash", F.lit("based_on").alias("relation_type"), "ref")
        s = self.state
        rows = lookup.overlay(rows, self._set(s.stale), self._set(frozenset())).drop("is_available")
        below = graph.closure(s.relations, self._object(locator).select("ref"))
        broken = bool(s.missing) and not below.join(self._set(s.missing), "ref", "left_semi").isEmpty()
        return Envelope("query_sources", rows, errors=self._gate() or (["SOURCE_MISSING"] if broken else self._errors(locator)))

    def _trace(self, name: str, locator: str) -> Envelope:
        roots = self._object(locator).select("ref")
        return self._answer(name, graph.dependencies(self.state.relations, roots), locator)

    def trace_graph(self, locator: str) -> Envelope:
        return self._trace("trace_graph", locator)

    def trace_evidence(self, locator: str) -> Envelope:
        roots = self._object(locator).select("ref")
        reached = graph.closure(self.state.relations, roots).select("ref")
        return self._answer("trace_evidence", self.state.atoms.join(reached, F.col("artifact_ref") == reached["ref"], "left_semi"), locator)

    def query_history(self, as_of: str | None = None) -> Envelope:
        facts = lookup.facts(self.state.facts, as_of=as_of)
        rows = self.state.objects.join(facts.select(F.col("subject").alias("_s")), F.col("ref") == F.col("_s"), "left_semi")
        return self._answer("query_history", rows)

    def query_as_of_state(self, as_of: str) -> Envelope:
        seen = history.snapshot(self.state.objects, self.state.facts, self.state.relations, as_of)["objects"]
        return self._answer("query_as_of_state", seen.withColumn("git_commit", F.lit(None).cast("string")))

    def _text(self, name: str, text: str) -> Envelope:
        asked = self.state.objects.sparkSession.createDataFrame([(0, text)], "query_id long, text string")
        return self._answer(name, semantic.token_match(self.state.facts, asked), authority="advisory")

    def query_text_lexical(self, text: str) -> Envelope:
        return self._text("query_text_lexical", text)

    def query_text_semantic(self, text: str) -> Envelope:
        return self._text("query_text_semantic", text)

    def impact(self, locator: str, change_type: str) -> Envelope:
        below = graph.dependents(self.state.relations, self._object(locator).select("ref"))
        rows = self.state.objects.where(F.col("kind").isin(*DEPENDENT_KINDS)).join(below.select(F.col("ref").alias("_r")), F.col("ref") == F.col("_r"), "left_semi")
        return self._answer("impact", rows.withColumn("change_type", F.lit(change_type)), locator)

    def stale_status(self, locator: str, change_type: str) -> Envelope:
        return self._answer("stale_status", graph.propagation(self.state.relations, self._object(locator).select("ref")), locator)

    def reconcile_integrity(self) -> Envelope:
        s = self.state
        issues = [("DRIFT_DETECTED", "index")] if s.index_state == "stale" else []
        issues += [("HASH_MISMATCH", r) for r in sorted(s.mismatched)] + [("SOURCE_MISSING", r) for r in sorted(s.missing)]
        issues += [("CANONICAL_SEMANTIC_DRIFT", r) for r in sorted(s.tampered)] + [("ORPHAN", r) for r in sorted(s.orphans)]
        rows = s.objects.sparkSession.createDataFrame(issues, "code string, subject string")
        if s.issues is None:
            return Envelope("reconcile_integrity", rows, warnings=[c for c, _ in issues])
        rows = rows.unionByName(s.issues().select("code", "subject"))
        return Envelope("reconcile_integrity", rows, warnings=sorted({r["code"] for r in rows.select("code").distinct().collect()}))  # a row a code

    def tx_reconcile(self) -> Envelope:
        """What is left to a person after recovery; without transactions to look at, what the log repeats."""
        s = self.state
        if s.transactions is not None:
            rows = s.transactions()
        elif s.log is not None:
            rows = integrity.duplicates(s.log, "event_id").selectExpr("'log' as check", "event_id as subject", "'DUPLICATE_ID' as code")
        else:
            rows = s.objects.sparkSession.createDataFrame([], "check string, subject string, code string")
        return Envelope("tx_reconcile", rows, warnings=sorted({r["code"] for r in rows.select("code").distinct().collect()}))

    def index(self) -> Envelope:
        """Builds the index, if the state can, and brings it back to being present; one row tells what it stands for."""
        mark = self.state.rebuild() if self.state.rebuild else {}
        self.state.index_state = "present"
        rows = self.state.objects.sparkSession.createDataFrame([("present", mark.get("fingerprint"), mark.get("last_event"))], "index_state string, fingerprint string, last_event string")
        return Envelope("index", rows, watermark=mark)

    def freeze_report(self, key: str, fingerprint: str, done: DataFrame) -> Envelope:
        """What a freeze request comes to, against the log of those done (key, fingerprint, committed); a held lock refuses it."""
        asked = done.sparkSession.createDataFrame([(key, fingerprint)], "key string, fingerprint string")
        rows = transactions.idempotency(asked, done)
        return Envelope("freeze_report", rows, errors=["CURRENT_CONFLICT"] if self.state.lock_held else [])

    @property
    def operations(self) -> dict[str, Callable[..., Envelope]]:
        names = (
            "freeze_report impact index query_as_of_state query_entity query_exact_routing query_external_basis query_facts query_history query_lineage query_project_current "
            "query_project_index query_sources query_state query_text_lexical query_text_semantic reconcile_integrity stale_status trace_evidence trace_graph tx_reconcile"
        )
        return {n: getattr(self, n) for n in names.split()}
