"""Predictions against sealed checkpoints: each is taken apart into facets, rows of canonical JSON by kind, and every facet that a checkpoint has must be there, row for row."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import canonical

# Closed vocabularies of predictions, and of what an observation says (fixed values).
PREDICTION = ("schema_version", "capture_id", "status", "error_semantic", "warnings", "errors", "results", "provenance_graph", "asserted_facts", "evidence", "retrieval_mode", "ranking_authority", "route_sequence", "as_of")
RESULT = ("entity_id", "version_ref", "path", "content_hash", "git_commit", "status", "is_stale", "relation_type", "section", "is_available")
STATUSES = ("success", "warning", "error", "fail_closed", "review_required")
OBSERVED = ("external_termination", "signal", "tx_residue_empty", "index_present", "session_id", "process_restarted")
#: Facets that are compared as sets of references, and counted.
SETS = ("result_set_exact", "impact_set_exact", "stale_set_exact")

_FACETS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


def _rows(value) -> list[str]:
    return sorted(canonical(x) for x in value or [] if isinstance(x, dict))


def _refs(rows, stale: bool = False) -> list[str]:
    return sorted({str(r.get("ref") or r.get("entity_id")) for r in rows or [] if isinstance(r, dict) and (r.get("ref") or r.get("entity_id")) and (not stale or r.get("is_stale") is True)})


def _pick(rows, *names: str) -> list[str]:
    return _rows([{"ref": r.get("ref") or r.get("entity_id"), **{n: r.get(n) for n in names}} for r in rows or [] if isinstance(r, dict)])


def _graph(graph) -> list[str]:
    g = graph if isinstance(graph, dict) else {}
    return [*(f"node {x}" for x in _rows(g.get("nodes"))), *(f"edge {x}" for x in _rows(g.get("edges")))]


def contract_faults(p: dict, capture: str) -> list[str]:
    """What of a prediction isn't as agreed: keys, ids, vocabularies, types; each in words."""
    out = [f"keys {sorted(p.keys() ^ set(PREDICTION))}"] if p.keys() != set(PREDICTION) else []
    out += ["capture_id"] if p.get("capture_id") != capture else []
    out += [f"status {p.get('status')!r}"] if p.get("status") not in STATUSES else []
    out += [f"{k} is no list" for k in ("warnings", "errors", "asserted_facts", "evidence", "route_sequence") if not isinstance(p.get(k), list)]
    rows = p.get("results")
    if rows is not None and not isinstance(rows, list):
        return [*out, "results is no list"]
    bad = next((r for r in rows or [] if not isinstance(r, dict) or not set(RESULT) <= r.keys() <= {*RESULT, "ref"}), None)
    return [*out, f"a result's keys: {bad}"] if bad is not None else out


def _of_prediction(text: str | None, capture: str) -> dict[str, list[str]]:
    try:
        p = json.loads(text or "")
        p = p if isinstance(p, dict) else {}
    except ValueError:
        p = {}
    if "observation" in p:
        o = p["observation"]
        return {"observation_present": ["true"]} | {k: [canonical(o.get(k))] for k in OBSERVED} | {"canonical_index_exact": [str(o.get("cle_digest"))], "canonical_state_exact": [str(o.get("canonical_digest"))]}
    faults = contract_faults(p, capture)
    if faults:
        return {"prediction_present": ["true"], "prediction_contract": faults}
    rows, issues = p["results"] or [], [{"code": r.get("code"), "ref": r.get("ref")} for r in [*p["warnings"], *p["errors"]] if isinstance(r, dict) and isinstance(r.get("code"), str)]
    empty = not (rows or p["asserted_facts"] or p["evidence"] or p["provenance_graph"])
    facts = [f for f in p["asserted_facts"] if isinstance(f, dict)]
    return {
        "prediction_present": ["true"], "prediction_contract": [], "expected_condition": [f"{p['status']} {p['error_semantic']}"], "closed": [str(empty).lower()],
        "result_set_exact": _refs(rows), "impact_set_exact": _refs(rows), "stale_set_exact": _refs(rows, stale=True),
        "version_binding_exact": sorted({canonical({"subject": f.get("subject"), "value": str(f.get("value"))}) for f in facts if f.get("predicate") == "bound_version"}),
        "asserted_facts_exact": _rows(facts), "lineage_exact": sorted(str(r["version_ref"]) for r in rows if r.get("version_ref")), "evidence_exact": _rows(p["evidence"]), "provenance_graph_exact": _graph(p["provenance_graph"]),
        "routing_policy": [str(x) for x in p["route_sequence"]], "ranking_authority": [str(p["ranking_authority"])], "integrity_issues_exact": _rows(issues),
        "historical_binding_exact": _pick(rows, "content_hash", "git_commit"), "as_of_exact": [str(p["as_of"])], "state_exact": _rows([{"ref": r.get("ref") or r.get("entity_id"), "is_stale": r.get("is_stale") is True} for r in rows]),
    }


def _of_checkpoint(text: str) -> dict[str, list[str]]:
    g = json.loads(text)
    if "expected_observation" in g:
        o = g["expected_observation"]
        out = {"observation_present": ["true"]} | {k: [canonical(o[k])] for k in OBSERVED if k in o}
        return out | {kind: [str(o[name])] for kind, name in (("canonical_index_exact", "cle_digest"), ("canonical_state_exact", "canonical_digest")) if name in o}
    c = g["expected_condition"]
    closed = c.get("behavior") == "fail_closed"
    out = {"prediction_present": ["true"], "prediction_contract": [], "expected_condition": [f"{c['status']} {c['error_semantic']}"]} | ({"closed": ["true"]} if closed else {})
    has = lambda name, kind, rows: {kind: rows(g[name])} if name in g else {}
    out |= has("results", "result_set_exact", _refs) | has("impact_set", "impact_set_exact", lambda x: sorted(set(x))) | has("stale_set", "stale_set_exact", lambda x: sorted(set(x)))
    out |= has("version_bindings", "version_binding_exact", lambda x: sorted({canonical({"subject": r["subject"], "value": str(r["value"])}) for r in x}))
    out |= has("asserted_facts", "asserted_facts_exact", _rows) | has("lineage", "lineage_exact", sorted) | has("evidence", "evidence_exact", _rows) | has("provenance_graph", "provenance_graph_exact", _graph)
    out |= has("route_sequence", "routing_policy", list) | has("integrity_issues", "integrity_issues_exact", _rows) | has("historical_bindings", "historical_binding_exact", lambda x: _pick(x, "content_hash", "git_commit"))
    out |= has("as_of", "as_of_exact", lambda x: [str(x)]) | has("state_assertions", "state_exact", _rows)
    return out if closed else out | has("ranking_authority", "ranking_authority", lambda x: [str(x)])


@F.pandas_udf(_FACETS)
def prediction_facets(body: pd.Series, capture: pd.Series) -> pd.Series:
    return pd.Series([_of_prediction(b, c) for b, c in zip(body, capture, strict=True)], dtype=object)


@F.pandas_udf(_FACETS)
def checkpoint_facets(body: pd.Series) -> pd.Series:
    return body.map(_of_checkpoint)


def judge(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(scenario, capture, kind, passed, tp, fp, fn): one row for each facet of each checkpoint; counts only for sets of references.

    gold and predictions: scenario, capture, body (JSON). A prediction that is missing, or given twice, fails prediction_present and nothing else is looked at; one that isn't as agreed
    fails prediction_contract, likewise. A prediction for no checkpoint fails as unexpected.
    """
    given = predictions.groupBy("scenario", "capture").agg(F.count("*").alias("n"), F.first("body").alias("given"))
    g = gold.select("scenario", "capture", checkpoint_facets("body").alias("want")).join(given, ["scenario", "capture"], "left")
    g = g.withColumn("has", F.when(F.col("n") == 1, prediction_facets("given", "capture")).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))))
    unfit = F.size(F.coalesce(F.element_at("has", "prediction_contract"), F.array().cast("array<string>"))) > 0
    looked = F.filter(F.map_keys("want"), lambda k: k.isin("prediction_present", "observation_present") | ((F.size("has") > 0) & ((k == "prediction_contract") | ~unfit)))
    rows = g.select("scenario", "capture", "want", "has", F.explode(looked).alias("kind"))
    want, has = F.element_at("want", F.col("kind")), F.element_at("has", F.col("kind"))
    counted = F.col("kind").isin(*SETS)
    n = lambda value, name: F.when(counted, F.size(value).cast("long")).alias(name)
    none = F.coalesce(has, F.array().cast("array<string>"))
    checked = rows.select("scenario", "capture", "kind", F.coalesce(want == has, F.lit(False)).alias("passed"), n(F.array_intersect(want, none), "tp"), n(F.array_except(none, want), "fp"), n(F.array_except(want, none), "fn"))
    null = F.lit(None).cast("long")
    stray = predictions.select("scenario", "capture").distinct().join(gold.select("scenario", "capture"), ["scenario", "capture"], "left_anti")
    return checked.unionByName(stray.select("scenario", "capture", F.lit("unexpected").alias("kind"), F.lit(False).alias("passed"), null.alias("tp"), null.alias("fp"), null.alias("fn")))


def outcomes(checks: DataFrame, violations: DataFrame) -> DataFrame:
    """One row a scenario: passed (all checks, no violation), score, civ_count, counts of impact and stale sets, and whether versions, graphs and refusals were right (null where none was asked)."""
    v = violations.groupBy(F.col("scenario").alias("v")).agg(F.count("*").alias("civ"))
    total = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).alias(f"{kind.partition('_')[0]}_{c}")
    right = lambda kind, name: F.bool_and(F.when(F.col("kind") == kind, F.col("passed"))).alias(name)
    s = checks.groupBy("scenario").agg(
        F.bool_and("passed").alias("fine"), *[total(k, c) for k in ("impact_set_exact", "stale_set_exact") for c in ("tp", "fp", "fn")],
        right("version_binding_exact", "version_correct"), right("provenance_graph_exact", "graph_exact_match"), right("closed", "fail_closed_correct"),
    )
    j = s.join(v, s["scenario"] == v["v"], "left").withColumn("civ_count", F.coalesce("civ", F.lit(0)))
    passed = F.col("fine") & (F.col("civ_count") == 0)
    return j.select("scenario", passed.alias("passed"), passed.cast("double").alias("score"), *[c for c in j.columns if c not in ("scenario", "fine", "v", "civ")])


def normalised(answers: DataFrame) -> DataFrame:
    """answers (scenario, capture, body: an engine's own JSON) as predictions with exactly the agreed fields; what has the wrong type takes its default."""

    @F.pandas_udf(T.StringType())
    def agreed(body: pd.Series, capture: pd.Series) -> pd.Series:
        def one(text, capture):
            try:
                a = json.loads(text or "")
            except ValueError:
                a = {}
            a = a if isinstance(a, dict) else {}
            kind = lambda name, type_, default: a[name] if isinstance(a.get(name), type_) else default
            status = {"replay": "success"}.get(a.get("status"), a.get("status"))
            rows = [{n: r.get(n) for n in RESULT} | {"status": r.get("status") if isinstance(r.get("status"), str) else None, "is_stale": r.get("is_stale") is True, "is_available": r.get("is_available") is not False} if isinstance(r, dict) else r for r in kind("results", list, [])]
            mode = kind("query_type", str, None)
            p = dict.fromkeys(PREDICTION) | {"schema_version": "prediction/v1", "capture_id": capture, "status": status if status in STATUSES else "error", "results": rows}
            p |= {n: kind(n, list, []) for n in ("warnings", "errors", "asserted_facts", "evidence")} | {n: kind(n, str, None) for n in ("error_semantic", "as_of")}
            authority = kind("ranking_authority", str, "authoritative" if a.get("authority") in ("canonical", "derived") else None)
            return json.dumps(p | {"provenance_graph": kind("provenance_graph", dict, None), "retrieval_mode": mode, "route_sequence": [mode] if mode else [], "ranking_authority": authority})

        return pd.Series([one(b, c) for b, c in zip(body, capture, strict=True)], dtype=object)

    return answers.select("scenario", "capture", agreed("body", "capture").alias("body"))
