"""The engine's operations as registered queries: one state over the test tables, each operation asked of it, with the SQL that its answer must equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import integrity
from .engine import Engine, State
from .queries import ORACLE, registered
from .rules import _text
from .substrate import Substrate

#: Kinds of the test tables' objects as the engine knows them.
KINDS = {"order": "report", "customer": "run", "supplier": "organized_result", "nation": "experiment_spec"}


def _engine(t: Substrate, **known) -> Engine:
    """Objects of the star tables, users and versions; facts of events, bindings and pins; relations with successions; an atom an order; a region is an external source."""
    null = F.lit(None).cast("string")
    kind = reduce(lambda c, k: F.when(F.col("kind") == k[0], k[1]).otherwise(c), KINDS.items(), F.col("kind"))
    columns = ("ref", "kind", "entity_id", "version_ref", "path", "status", "content_hash", "git_commit", "lifecycle_start")
    star = t.objects.withColumns({"kind": kind, "version_ref": null, "git_commit": F.lit("c0")})
    v = t.versions
    versions = v.select(F.col("version_ref").alias("ref"), F.lit("definition").alias("kind"), "entity_id", "version_ref", "path", F.lit("valid").alias("status"), F.sha2("text", 256).alias("content_hash"), F.lit("c0").alias("git_commit"), F.lit("1993-01-01").alias("lifecycle_start"))
    users = t.table("events").select(_text("user:", F.col("user_id")).alias("ref")).distinct().select("ref", F.lit("user").alias("kind"), F.col("ref").alias("entity_id"), null.alias("version_ref"), F.regexp_replace("ref", ":", "/").alias("path"), F.lit("valid").alias("status"), F.sha2("ref", 256).alias("content_hash"), F.lit("c0").alias("git_commit"), F.lit("1994-01-01").alias("lifecycle_start"))
    objects = star.select(*columns).unionByName(versions).unionByName(users)
    at = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    fact = lambda df, id_, subject, predicate, value: df.select(id_.alias("fact_id"), subject.alias("subject"), F.lit(predicate).alias("predicate"), value.alias("value"), at.alias("occurred_at"))
    facts = t.facts.withColumns({"fact_id": F.col("fact_id").cast("string"), "value": F.col("predicate")})
    facts = facts.unionByName(fact(v.where("current"), _text("b:", F.col("version_ref")), F.col("version_ref"), "bound_version", F.col("version_ref")))
    facts = facts.unionByName(fact(t.table("nation"), _text("p:", F.col("n_nationkey")), _text("nation:", F.col("n_nationkey")), "authority_source", _text("ext:", F.col("n_regionkey"))))
    facts = facts.unionByName(fact(v, _text("t:", F.col("version_ref")), F.col("version_ref"), "text", F.col("text")))
    succession = v.where("previous is not null").select(F.col("version_ref").alias("source_ref"), F.lit("supersedes").alias("relation"), F.col("previous").alias("target_ref"))
    atoms = t.table("orders").select(_text("a:", F.col("o_orderkey")).alias("atom_id"), _text("order:", F.col("o_orderkey")).alias("artifact_ref"), F.lit("command").alias("kind"))
    externals = t.table("region").select(_text("ext:", F.col("r_regionkey")).alias("ref"), F.sha2("r_name", 256).alias("pinned_hash"), F.col("r_name").alias("pinned_value"))
    return Engine(State(objects, facts.select("fact_id", "subject", "predicate", "value", "occurred_at"), t.relations.unionByName(succession), atoms, externals, **known))


_NATION = "select 'nation:3' as ref, 'experiment_spec' as kind, 'nation/3' as path, 'valid' as status, 'sha256:' || sha256(n_nationkey || '|' || n_name) as content_hash, true as is_stale, true as is_available from nation where n_nationkey = 3"
_ROW = ("ref", "kind", "path", "status", "content_hash", "is_stale", "is_available")


def _only(answer, *columns: str | Column) -> DataFrame:
    return answer.results.select(*columns).withColumn("answer", F.lit(answer.status))


@registered("", f"select *, 'success' as answer from ({_NATION})")
def engine_query_entity(t: Substrate) -> DataFrame:
    return _only(_engine(t, stale=frozenset(["nation:3"])).query_entity("nation/3"), *_ROW)


@registered("", f"select *, 'success' as answer from ({_NATION})")
def engine_query_exact_routing(t: Substrate) -> DataFrame:
    return _only(_engine(t, stale=frozenset(["nation:3"])).query_exact_routing("nation:3"), *_ROW)


@registered("", f"select *, 'success' as answer from ({_NATION})")
def engine_query_project_current(t: Substrate) -> DataFrame:
    return _only(_engine(t, stale=frozenset(["nation:3"])).query_project_current("nation:3"), *_ROW)


@registered("", f"select ref, kind, path, 'success' as answer from ({_NATION})")
def engine_query_project_index(t: Substrate) -> DataFrame:
    return _only(_engine(t).query_project_index("nation:3"), "ref", "kind", "path")


@registered("", f"select ref, status, is_stale, 'success' as answer from ({_NATION})")
def engine_query_state(t: Substrate) -> DataFrame:
    return _only(_engine(t, stale=frozenset(["nation:3"])).query_state("nation:3"), "ref", "status", "is_stale")


@registered("", "select event_id::varchar as fact_id, event_type as predicate, event_type as value, 'success' as answer from events where user_id = 5 and event_type in ('click', 'error') and ts <= timestamp '2025-06-01'")
def engine_query_facts(t: Substrate) -> DataFrame:
    return _only(_engine(t).query_facts("user:5", ["click", "error"], "2025-06-01 00:00:00"), "fact_id", "predicate", "value")


_LONGEST = "select conv_id, max(turn) as last from conversations where conv_id % 13 <> 0 and conv_id % 17 <> 0 group by conv_id order by last desc, conv_id limit 1"


@registered("", f"select 'conv:' || conv_id || '@v' || turn as version_ref, turn::int as place, case when turn = last then true end as bound, 'success' as answer from conversations join ({_LONGEST}) using (conv_id)")
def engine_query_lineage(t: Substrate) -> DataFrame:
    c = t.table("conversations").where("conv_id % 13 <> 0 and conv_id % 17 <> 0").groupBy("conv_id").agg(F.max("turn").alias("last"))
    first = c.orderBy(F.desc("last"), "conv_id").first()  # the feature is one entity's lineage; the longest is asked for
    return _only(_engine(t).query_lineage(f"conv:{first['conv_id']}@v{first['last']}"), "version_ref", "place", "bound")


@registered("", "select 'nation:3' as subject, 'ext:' || r_regionkey as ref, sha256(r_name) as pinned_hash, r_name as pinned_value, 'success' as answer from nation join region on n_regionkey = r_regionkey where n_nationkey = 3")
def engine_query_external_basis(t: Substrate) -> DataFrame:
    return _only(_engine(t).query_external_basis("nation:3"), "subject", "ref", "pinned_hash", "pinned_value")


@registered("", "select 'part:' || l_partkey as ref, 'based_on' as relation_type, l_partkey = 7 as is_stale, 'success' as answer from (select distinct l_partkey from lineitem where l_orderkey = (select min(l_orderkey) from lineitem))")
def engine_query_sources(t: Substrate) -> DataFrame:
    first = t.table("lineitem").agg(F.min("l_orderkey")).first()[0]
    return _only(_engine(t, stale=frozenset(["part:7"])).query_sources(f"order:{first}", ["uses"]), "ref", "relation_type", "is_stale")


_BELOW = """with recursive e as (select 'nation:' || n_nationkey as s, 'based_on' as r, 'region:' || n_regionkey as t from nation union all select 'customer:' || c_custkey, 'based_on', 'nation:' || c_nationkey from customer
  union all select 'supplier:' || s_suppkey, 'based_on', 'nation:' || s_nationkey from supplier union all select 'order:' || o_orderkey, 'derived_from', 'customer:' || o_custkey from orders
  union all select distinct 'order:' || l_orderkey, 'uses', 'part:' || l_partkey from lineitem union all select distinct 'order:' || l_orderkey, 'cites', 'supplier:' || l_suppkey from lineitem),
down as (select 'order:' || (select min(l_orderkey) from lineitem) as ref union select t from down join e on s = ref), up as (select 'nation:3' as ref union select s from up join e on t = ref)"""


@registered("", _BELOW + " select s as source_ref, r as relation, t as target_ref, 'success' as answer from e where s in (select ref from down)")
def engine_trace_graph(t: Substrate) -> DataFrame:
    first = t.table("lineitem").agg(F.min("l_orderkey")).first()[0]
    return _only(_engine(t).trace_graph(f"order:{first}"), "source_ref", "relation", "target_ref")


@registered("", _BELOW + " select 'a:' || o_orderkey as atom_id, 'success' as answer from orders where 'order:' || o_orderkey in (select ref from down)")
def engine_trace_evidence(t: Substrate) -> DataFrame:
    first = t.table("lineitem").agg(F.min("l_orderkey")).first()[0]
    return _only(_engine(t).trace_evidence(f"order:{first}"), "atom_id")


@registered("", _BELOW + " select ref, 'scope_change' as change_type, 'success' as answer from up where ref <> 'nation:3'")
def engine_impact(t: Substrate) -> DataFrame:
    return _only(_engine(t).impact("nation:3", "scope_change"), "ref", "change_type")


@registered("", _BELOW + " select s as source_ref, r as relation, t as target_ref, 'success' as answer from e where s in (select ref from up) and t in (select ref from up)")
def engine_stale_status(t: Substrate) -> DataFrame:
    return _only(_engine(t).stale_status("nation:3", "scope_change"), "source_ref", "relation", "target_ref")


@registered("", "select distinct 'user:' || user_id as ref, 'success' as answer from events where ts <= timestamp '2024-03-01'")
def engine_query_history(t: Substrate) -> DataFrame:
    return _only(_engine(t).query_history("2024-03-01 00:00:00"), "ref")


@registered(
    "objects",
    """ select ref, null::varchar as status, 'success' as answer from objects where lifecycle_start <= '1993-06-01' union all select 'conv:' || conv_id || '@v' || turn, null::varchar, 'success' from conversations""",
)
def engine_query_as_of_state(t: Substrate) -> DataFrame:
    return _only(_engine(t).query_as_of_state("1993-06-01"), "ref", "status")


_ASKED = "select list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))[1:2] as q from conversations where text is not null order by conv_id, turn limit 1"


def _two_words(t: Substrate) -> str:
    """A query of two words that some turn has."""
    first = t.table("conversations").where("text is not null").orderBy("conv_id", "turn").select(F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))), 1, 2)).first()
    return " ".join(first[0])


@registered("", f"select 'conv:' || conv_id || '@v' || turn as subject, 'success' as answer from conversations, ({_ASKED}) where list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), q)")
def engine_query_text_lexical(t: Substrate) -> DataFrame:
    return _only(_engine(t).query_text_lexical(_two_words(t)), "subject")


@registered("", f"select 'conv:' || conv_id || '@v' || turn as subject, 'success' as answer from conversations, ({_ASKED}) where list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), q)")
def engine_query_text_semantic(t: Substrate) -> DataFrame:
    return _only(_engine(t).query_text_semantic(_two_words(t)), "subject")


@registered("", "select * from (values ('DRIFT_DETECTED', 'index', 'warning'), ('HASH_MISMATCH', 'part:1', 'warning'), ('SOURCE_MISSING', 'part:2', 'warning'), ('CANONICAL_SEMANTIC_DRIFT', 'part:3', 'warning'), ('ORPHAN', 'x/y', 'warning')) as v(code, subject, answer)")
def engine_reconcile_integrity(t: Substrate) -> DataFrame:
    known = {"mismatched": "part:1", "missing": "part:2", "tampered": "part:3", "orphans": "x/y"}
    return _only(_engine(t, index_state="stale", **{k: frozenset([v]) for k, v in known.items()}).reconcile_integrity(), "code", "subject")


@registered("", f"select code, subject, 'warning' as answer from ({ORACLE['reconcile_issues']}) union all select 'DRIFT_DETECTED', 'index', 'warning'")
def engine_reconcile_tables(t: Substrate) -> DataFrame:
    """Every issue of the index's tables against the tree, as the engine answers them, with a stale index."""
    found = lambda: integrity.reconcile(t.documents, t.source_refs, t.live, t.snapshots)
    return _only(_engine(t, index_state="stale", issues=found).reconcile_integrity(), "code", "subject")


@registered("", "select 'log' as \"check\", user_id::varchar as subject, 'DUPLICATE_ID' as code, 'warning' as answer from events group by user_id having count(*) > 1")
def engine_tx_reconcile(t: Substrate) -> DataFrame:
    """A log in which users stand for events, so that ids repeat."""
    return _only(_engine(t, log=t.table("events").select(F.col("user_id").cast("string").alias("event_id"))).tx_reconcile(), "check", "subject", "code")


@registered("", "select 'present' as index_state, 'sha256:' || sha256(count(*)::varchar) as fingerprint, 'success' as answer from documents")
def engine_index(t: Substrate) -> DataFrame:
    e = _engine(t, index_state="missing", rebuild=lambda: {"fingerprint": t.documents.agg(_text("sha256:", F.sha2(F.count("*").cast("string"), 256))).first()[0], "last_event": None})
    return _only(e.index(), "index_state", "fingerprint")


@registered("", "select 'k1' as key, 'replay' as outcome, 'success' as answer from events where event_id = 1")
def engine_freeze_report(t: Substrate) -> DataFrame:
    done = t.table("events").select(_text("k", F.col("event_id")).alias("key"), _text("f", F.col("user_id")).alias("fingerprint"), F.lit(True).alias("committed"))
    first = t.table("events").where("event_id = 1").first()
    return _only(_engine(t).freeze_report("k1", f"f{first['user_id']}", done), "key", "outcome")


@registered("", _BELOW + " select ref, 'fail_closed' as answer from up where false")
def engine_closed_answer(t: Substrate) -> DataFrame:
    """An answer whose target is ambiguous has no rows, whatever there is."""
    return _only(_engine(t, ambiguous=frozenset(["nation:3"])).impact("nation:3", "scope_change"), "ref")
