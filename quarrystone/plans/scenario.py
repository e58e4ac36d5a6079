"""Scenarios: actions folded over a state into sealed answers, and predictions judged against them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .engine import Engine, State
from .envelope import Envelope

#: Of an answer's rows, the fields that are compared, where they are there.
COMPARED = ("ref", "entity_id", "version_ref", "path", "content_hash", "git_commit", "is_stale", "relation_type", "source_ref", "relation", "target_ref", "subject", "predicate", "value", "atom_id", "code")


def mutate(state: State, kind: str, target: str, **given) -> State:
    """The state after one mutation; the old one stays as it is."""
    sets = {"tamper_hash": "mismatched", "delete_source": "missing", "duplicate_version": "ambiguous", "tamper_semantics": "tampered", "add_orphan": "orphans", "mark_stale": "stale"}
    undo = {"restore_source": "missing", "restore_hash": "mismatched", "remove_orphan": "orphans"}
    if kind in sets:
        return replace(state, **{sets[kind]: getattr(state, sets[kind]) | {target}})
    if kind in undo:
        return replace(state, **{undo[kind]: getattr(state, undo[kind]) - {target}})
    if kind in ("hold_lock", "release_lock"):
        return replace(state, lock_held=kind == "hold_lock")
    if kind == "index_drift":
        return replace(state, index_state="stale")
    if kind == "set_status":
        return replace(state, objects=state.objects.withColumn("status", F.when(F.col("ref") == target, given["status"]).otherwise(F.col("status"))))
    if kind == "create_version":
        row = state.objects.sparkSession.createDataFrame([given["row"]], state.objects.schema)
        return replace(state, objects=state.objects.unionByName(row))
    raise ValueError(f"{kind} is no mutation")


def compile_gold(state: State, actions: list[dict]) -> list[dict]:
    """A checkpoint for each invocation, by the state as it is at that step."""
    out = []
    for a in actions:
        if a["action"] == "mutate":
            state = mutate(state, **{k: v for k, v in a.items() if k != "action"})
        elif a["action"] == "invoke":
            answer = Engine(state).operations[a["operation"]](**a.get("params", {}))
            out.append(checkpoint(answer, a.get("capture", a["operation"])))
        else:
            raise ValueError(f"{a['action']} is no action")
    return out


def checkpoint(answer: Envelope, capture: str) -> dict:
    """An answer as plain data, its rows in one order; a closed answer has none."""
    columns = [c for c in COMPARED if c in answer.results.columns]
    rows = [r.asDict() for r in answer.results.select(*columns).collect()] if answer.status != "fail_closed" else []
    rows.sort(key=lambda r: [(v is not None, str(v)) for v in r.values()])
    return {"capture": capture, "status": answer.status, "error_semantic": answer.error_semantic, "results": rows}


def judge(gold: list[dict], predicted: list[dict]) -> dict:
    """checks (capture, kind, passed) and passed, which needs all: every capture once, status and error equal, rows equal as multisets, nothing with a refusal."""
    by: dict[str, list[dict]] = {}
    for p in predicted:
        by.setdefault(p.get("capture"), []).append(p)
    checks = [(c, "expected", False) for c in by if c not in {g["capture"] for g in gold}]
    key = lambda rows: sorted(repr(sorted(r.items(), key=lambda x: x[0])) for r in rows)
    for g in gold:
        given = by.get(g["capture"], [])
        checks.append((g["capture"], "once", len(given) == 1))
        if len(given) == 1:
            p = given[0]
            checks.append((g["capture"], "status", p.get("status") == g["status"]))
            checks.append((g["capture"], "error", p.get("error_semantic") == g["error_semantic"]))
            checks.append((g["capture"], "rows", key(p.get("results") or []) == key(g["results"])))
            checks.append((g["capture"], "closed", g["status"] != "fail_closed" or not p.get("results")))
    return {"checks": checks, "passed": bool(gold) and all(ok for *_, ok in checks)}
