"""More registered queries: lookups by many names, trails, orders, receipts and what rests on them, and an index over files made from tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import checks, graph, impact, integrity, ledger, lookup, navigation, orders, scoring, transactions
from ..sources import framed, manifest, workspace
from .queries import _VERIFIED, registered
from .substrate import Substrate, sql


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


# ---- lookups


@registered("docs", " select id, 'raw' as doc_type, path, content_hash from docs where doc_type = 'src0'")
def raw_listing(t: Substrate) -> DataFrame:
    d = t.documents.withColumn("doc_type", F.when(F.col("doc_type") == "src0", "raw").otherwise(F.col("doc_type")))
    return lookup.select(d, raw=True).select("id", "doc_type", "path", "content_hash")


@registered(
    "versions",
    """, o as (select 'obj:' || version_ref as ref, entity_id, version_ref, path from versions),
ask as (select ref as locator from o union select entity_id from o union select version_ref from o union select path from o where version_ref like '%@v0' union select 'none:' || entity_id from o),
hits as (select locator, ref, true as own from ask join o on locator = ref union all select locator, ref, false from ask join o on locator in (o.entity_id, o.version_ref, o.path))
select a.locator, coalesce(max(ref) filter (where own), case when count(distinct ref) = 1 then max(ref) end) as ref from ask a left join hits using (locator) group by a.locator""",
)
def unique_objects(t: Substrate) -> DataFrame:
    o = t.versions.select(_text("obj:", F.col("version_ref")).alias("ref"), "entity_id", "version_ref", "path")
    names = ["ref", "entity_id", "version_ref"]
    ask = reduce(DataFrame.union, [o.select(F.col(c).alias("locator")) for c in names] + [o.where("version_ref like '%@v0'").select("path"), o.select(_text("none:", F.col("entity_id")))])
    return lookup.unique(ask.distinct(), o)


@registered("versions", " select entity_id as subject, version_ref as value from versions where current and right(entity_id, 1) in ('0', '2', '4', '6', '8')")
def version_bindings(t: Substrate) -> DataFrame:
    v = t.versions
    facts = v.where("current").select(F.col("entity_id").alias("subject"), F.lit("bound_version").alias("predicate"), F.col("version_ref").alias("value"))
    facts = facts.unionByName(v.select(F.col("entity_id").alias("subject"), F.lit("role").alias("predicate"), F.col("role").alias("value")))
    return lookup.bindings(facts, v.where("right(entity_id, 1) in ('0', '2', '4', '6', '8')").select(F.col("entity_id").alias("ref")))


@registered(
    "docs",
    """ select id, doc_type as entity_type, path, case when doc_id % 4 <> 0 then content_hash end as content_hash, case when doc_id % 4 <> 0 then 'c' || doc_id % 3 end as git_commit from docs
union all select 'ghost:' || r_regionkey, 'ghost', 'ghosts/' || r_regionkey, null, null from region""",
)
def entity_documents(t: Substrate) -> DataFrame:
    d = t.documents
    ghosts = t.table("region").select(_text("ghost:", F.col("r_regionkey")).alias("id"), F.lit("ghost").alias("entity_type"), _text("ghosts/", F.col("r_regionkey")).alias("path"))
    entities = d.select("id", F.col("doc_type").alias("entity_type"), "path").unionByName(ghosts)
    return lookup.with_documents(entities, d.where("doc_id % 4 <> 0").select("id", "content_hash", _text("c", F.col("doc_id") % 3).alias("git_commit")))


_REFS = """, refs as (select 'order:' || l_orderkey as owner, l_linenumber as n, 'part/' || l_partkey || case l_linenumber % 3 when 1 then '/' when 2 then '//' else '' end as ref_path from lineitem)"""


def _part_refs(t: Substrate) -> DataFrame:
    slashes = F.when(F.col("l_linenumber") % 3 == 1, "/").when(F.col("l_linenumber") % 3 == 2, "//").otherwise("")
    return t.table("lineitem").select(_text("order:", F.col("l_orderkey")).alias("owner"), F.col("l_linenumber").alias("n"), _text("part/", F.col("l_partkey"), slashes).alias("ref_path"))


@registered("objects", _REFS + " select owner, n, ref_path from refs where rtrim(ref_path, '/') in (select 'part/' || p_partkey from part where p_size > 40)")
def citing_paths(t: Substrate) -> DataFrame:
    slash = F.when(F.col("p_partkey") % 2 == 0, "/").otherwise("")
    return lookup.citing(_part_refs(t), t.table("part").where("p_size > 40").select(_text("part/", F.col("p_partkey"), slash).alias("path")))


@registered("objects", _REFS + " select r.owner, r.n, coalesce(o.ref, r.ref_path) as name from refs r left join objects o on r.ref_path = o.path")
def named_paths(t: Substrate) -> DataFrame:
    return lookup.named_paths(_part_refs(t), t.objects.select(F.col("ref").alias("id"), "path"), "ref_path").select("owner", "n", "name")


@registered(
    "versions docs",
    """, v as (select entity_id, version_ref, 'sha256:' || sha256(text) as h from versions), e as (select distinct entity_id from versions where version = 1),
f as (select version_ref || ':role' as fact_id, version_ref as subject, 'role' as predicate, role as value from versions
  union all select entity_id || ':basis', entity_id, 'authority_source', 'doc:' || replace(entity_id, 'conv:', '') from versions where version = 0),
about as (select e.entity_id, v.version_ref as s from e join v using (entity_id) union select entity_id, entity_id from e),
said as (select a.entity_id, f.fact_id, f.predicate, f.value from about a join f on f.subject = a.s)
select entity_id, 'version' as section, version_ref as item, h as value from v join e using (entity_id) union all select entity_id, 'fact', fact_id, value from said
union all select distinct entity_id, 'pin', d.id, d.content_hash from said s join docs d on s.predicate = 'authority_source' and s.value = d.id
union all select e.entity_id, 'downstream', o.version_ref, (o.version - 1)::varchar from e join versions o using (entity_id) where o.version > 1""",
)
def maximal_envelope(t: Substrate) -> DataFrame:
    v = t.versions
    facts = v.select(_text(F.col("version_ref"), ":role").alias("fact_id"), F.col("version_ref").alias("subject"), F.lit("role").alias("predicate"), F.col("role").alias("value"))
    basis = v.where("version = 0").select(_text(F.col("entity_id"), ":basis").alias("fact_id"), F.col("entity_id").alias("subject"), F.lit("authority_source").alias("predicate"), F.regexp_replace("entity_id", "conv:", "doc:").alias("value"))
    targets = v.where("version = 1").select("entity_id", "version_ref")
    below = graph.closure(v.where("previous is not null").select(F.col("previous").alias("source_ref"), F.col("version_ref").alias("target_ref")), targets.select(F.col("version_ref").alias("ref"))).where("depth > 0")
    downstream = below.join(targets, below["root"] == targets["version_ref"]).select("entity_id", "ref", "depth")
    versions = v.select("entity_id", "version_ref", _text("sha256:", F.sha2("text", 256)).alias("content_hash"))
    return lookup.envelope(targets, versions, facts.unionByName(basis), t.documents.select(F.col("id").alias("ref"), F.col("content_hash").alias("pinned_hash")), downstream)


# ---- trails: orders rest on customers, those on nations, those on regions


def _trail(t: Substrate) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References, entities and starts: every order by id or path, and some that are none."""
    ref = lambda kind, key: _text(f"{kind}:", F.col(key))
    path = lambda kind, key: _text(f"{kind}/", F.col(key))
    fault = lambda key: F.when(F.col(key) % 7 == 0, "HASH_MISMATCH").when(F.col(key) % 5 == 0, "SOURCE_CHANGED_SINCE_PIN").otherwise("ok")
    hop = lambda table, kind, own, to, key, type_: t.table(table).select(ref(kind, own).alias("owner"), path(kind, own).alias("owner_path"), path(to, key).alias("ref_path"), F.lit(type_).alias("source_type"), fault(key).alias("outcome"))
    refs = hop("orders", "order", "o_orderkey", "customer", "o_custkey", "file").unionByName(hop("customer", "customer", "c_custkey", "nation", "c_nationkey", "directory")).unionByName(hop("nation", "nation", "n_nationkey", "region", "n_regionkey", "directory"))
    kind = F.when(F.col("kind") == "order", "report_historical").when(F.col("kind") == "customer", "organized").otherwise(F.col("kind"))
    entities = t.objects.where("kind <> 'region'").select(F.col("ref").alias("id"), kind.alias("entity_type"), "path")
    k = F.col("o_orderkey")
    starts = t.table("orders").select(F.when(k % 3 == 0, path("order", "o_orderkey")).otherwise(ref("order", "o_orderkey")).alias("ref"))
    return refs, entities, starts.unionByName(t.table("region").select(path("region", "r_regionkey").alias("ref")))


_TRAIL = """, o as (select o_orderkey as k, o_custkey as c from orders), a as (select 'order:' || k as root, c from o),
b as (select root, c, c_nationkey as n from a join customer on c = c_custkey where c % 7 <> 0), d as (select root, n, n_regionkey as r from b join nation on n = n_nationkey where n % 7 <> 0),
edges as (select root, root as owner, 'customer/' || c as ref_path, 'based_on' as relation_type, c % 7 <> 0 as is_available, c % 7 <> 0 and c % 5 = 0 as is_stale from a
  union all select root, 'customer:' || c, 'nation/' || n, 'organized_from', n % 7 <> 0, n % 7 <> 0 and n % 5 = 0 from b
  union all select root, 'nation:' || n, 'region/' || r, 'uses', r % 7 <> 0, r % 7 <> 0 and r % 5 = 0 from d)"""


@registered("", "with x as (select 1)" + _TRAIL + " select * from edges")
def trace_edges(t: Substrate) -> DataFrame:
    return graph.trace(*_trail(t))[1]


@registered(
    "",
    "with x as (select 1)"
    + _TRAIL
    + """ select root, root as entity_id, 'report_historical' as entity_type, 0 as depth, 'start' as relation_type from a union all select root, 'customer:' || c, 'organized', 1, 'child' from b
union all select root, 'nation:' || n, 'raw', 2, 'child' from d union all select root, 'region/' || r, 'raw', 3, 'child' from d where r % 7 <> 0""",
)
def trace_nodes(t: Substrate) -> DataFrame:
    return graph.trace(*_trail(t))[0]


@registered(
    "",
    "with x as (select 1)"
    + _TRAIL
    + """, f as (select root, bool_or(not is_available) as broken, bool_or(is_stale) as stale from edges group by root)
select case when k % 3 = 0 then 'order/' || k else 'order:' || k end as ref, case when broken then 'fail_closed' when stale then 'warning' else 'success' end as status from o join f on root = 'order:' || k
union all select 'region/' || r_regionkey, 'error' from region""",
)
def trace_status(t: Substrate) -> DataFrame:
    refs, entities, starts = _trail(t)
    return graph.trace_status(starts, entities, graph.trace(refs, entities, starts)[1])


@registered(
    "",
    """select 'region/' || n_regionkey as root, 'nation:' || n_nationkey as entity_id, 'nation/' || n_nationkey as path from nation
union all select 'region/' || n_regionkey, 'customer:' || c_custkey, 'customer/' || c_custkey from customer join nation on c_nationkey = n_nationkey
union all select 'region/' || n_regionkey, 'order:' || o_orderkey, 'order/' || o_orderkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
)
def physical_impact(t: Substrate) -> DataFrame:
    starts = t.table("region").select(_text("region/", F.col("r_regionkey"), F.when(F.col("r_regionkey") % 2 == 0, "/").otherwise("")).alias("ref"))
    return graph.physical_impact(_trail(t)[0], starts)


@registered(
    "",
    """with d as (select 'conv:' || conv_id as entity_id, max(turn)::varchar as why from conversations group by conv_id), p as (select 'conv:' || doc_id as entity_id, 'file' as why from labels)
select * from d union all select distinct * from p where entity_id not in (select entity_id from d)""",
)
def impact_merged(t: Substrate) -> DataFrame:
    own = t.table("conversations").groupBy(_text("conv:", F.col("conv_id")).alias("entity_id")).agg(F.max("turn").cast("string").alias("why"))
    return impact.merge(own, t.table("labels").select(_text("conv:", F.col("doc_id")).alias("entity_id"), F.lit("file").alias("why")))


@registered(
    "",
    """with s as (select 'EXP-' || n_nationkey as experiment, case when n_nationkey % 5 = 0 then '' else 'H' || n_regionkey end as hypothesis, case when n_nationkey % 2 = 0 then 'active' end as status from nation),
r as (select 'EXP-' || case when c_custkey % 10 = 0 then 90 + c_nationkey else c_nationkey end as experiment, count(*) as n from customer group by 1)
select coalesce(nullif(hypothesis, ''), '未分配假设') as hypothesis, experiment, coalesce(status, 'active') as status, coalesce(n, 0) as n_runs from s full join r using (experiment)""",
)
def hypothesis_index(t: Substrate) -> DataFrame:
    n = F.col("n_nationkey")
    specs = t.table("nation").select(_text("EXP-", n).alias("experiment"), F.when(n % 5 == 0, "").otherwise(_text("H", F.col("n_regionkey"))).alias("hypothesis"), F.when(n % 2 == 0, "active").alias("status"))
    of = F.when(F.col("c_custkey") % 10 == 0, F.col("c_nationkey") + 90).otherwise(F.col("c_nationkey"))
    return navigation.hypothesis_index(specs, t.table("customer").select(_text("EXP-", of, "@v", F.col("c_custkey") % 2).alias("experiment_ref")))


# ---- orders


@registered(
    "",
    """with v as (select user_id, event_id, case event_id % 6 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 else 4 end as kind,
  case when event_id % 6 = 3 then event_id - 500 end as n, case when event_id % 6 > 3 then '"' || event_type || '"' end as s from events)
select event_id, row_number() over (partition by user_id order by kind, n nulls first, s nulls first, event_id)::int as place from v""",
)
def prediction_order(t: Substrate) -> DataFrame:
    k = F.col("event_id")
    value = F.when(k % 6 == 0, "null").when(k % 6 == 1, "false").when(k % 6 == 2, "true").when(k % 6 == 3, (k - 500).cast("string")).otherwise(_text('"', F.col("event_type"), '"'))
    rows = t.table("events").select("user_id", "event_id", value.alias("v"))
    return rows.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(orders.value_key(F.col("v")), "event_id")).alias("place"))


@registered("", "select lang, doc_id, 'sha256:' || sha256(text) as digest, count(*) over (partition by sha256(text)) > 1 as repeated from documents where text is not null")
def digest_order(t: Substrate) -> DataFrame:
    return orders.digests(t.table("documents").where("text is not null").select("lang", "doc_id", _text("sha256:", F.sha2("text", 256)).alias("digest")), "digest")


@registered(
    "",
    """with e as (select event_type, sha256('{"event_id":' || event_id || ',"user_id":' || user_id || '}') as d from events)
select event_type, count(*) as n, 'sha256:' || sha256(string_agg(d, chr(10) order by d)) as digest from e group by event_type""",
)
def commitment_digests(t: Substrate) -> DataFrame:
    return ledger.commitments(t.table("events").select("event_type", "event_id", "user_id"), "event_type", "event_id", "user_id")


@registered("", """select event_id, '{"k":' || (props->>'k') || '}' as canonical, 'sha256:' || sha256('{"k":' || (props->>'k') || '}') as digest from events where props is not null""")
def canonical_json(t: Substrate) -> DataFrame:
    c = t.table("events").where("props is not null").select("event_id", hashing.canonical_json(F.col("props")).alias("canonical"))
    return c.select("event_id", "canonical", hashing.file_digest(F.col("canonical")).alias("digest"))


# ---- integrity


@registered(
    "docs source_refs live snapshots",
    _VERIFIED
    + """, twice as (select 'label:' || doc_id as owner, path as ref_path from docs where doc_id % 10 = 0 and doc_id in (select doc_id from labels)),
every as (select owner, ref_path, computed_hash, outcome from verified union all select t.owner, t.ref_path, l.content_hash, case when l.content_hash is null then 'SOURCE_MISSING' else 'ok' end from twice t left join live l on t.ref_path = l.path),
bad as (select distinct t.owner from twice t join source_refs r on t.owner = r.owner and t.ref_path = r.ref_path where r.content_hash <> '' or r.git_commit is not null)
select owner, ref_path, case when owner not in (select owner from bad) then computed_hash end as computed_hash, case when owner in (select owner from bad) then 'AMBIGUOUS_VERSION' else outcome end as outcome from every""",
)
def sources_closed(t: Substrate) -> DataFrame:
    labelled = t.table("labels").select(F.col("doc_id").alias("l"))
    d = t.documents.where("doc_id % 10 = 0").join(labelled, F.col("doc_id") == F.col("l"), "left_semi")
    twice = d.select(_text("label:", F.col("doc_id")).alias("owner"), F.col("path").alias("ref_path"), F.lit("current").alias("reference_scope"), F.lit("").alias("content_hash"), F.lit(None).cast("string").alias("git_commit"))
    return integrity.sources(t.source_refs.unionByName(twice), t.live, t.snapshots)


@registered(
    "docs live",
    """, reports as (select path, doc_id from docs where doc_type in ('src1', 'src2', 'src3')), sides as (select path || '.sources.yaml' as path from reports where doc_id % 3 > 0)
select path, path || '.sources.yaml' as sidecar from reports where path || '.sources.yaml' not in (select path from sides)""",
)
def missing_sidecars(t: Substrate) -> DataFrame:
    reports = t.documents.where("doc_type in ('src1', 'src2', 'src3')").select("path", "doc_id")
    sides = reports.where("doc_id % 3 > 0").select(_text(F.col("path"), ".sources.yaml").alias("path"), F.lit("h").alias("content_hash"))
    return integrity.without_sidecar(reports.select("path"), t.live.unionByName(sides))


@registered(
    "docs",
    """, f as (select id as ref, doc_id, doc_id % 29 = 0 as locked, doc_id % 13 = 0 as ambiguous, case when doc_id % 23 = 0 then 'SOURCE_UNAVAILABLE' end as source_error, doc_id % 7 = 0 as mismatch, doc_id % 11 = 0 as missing,
  doc_id % 5 = 0 as tampered, doc_id % 17 = 0 as drifted, doc_id % 3 > 0 as found from docs),
e as (select ref, case when locked then 'TX_LOCKED' when ambiguous then 'AMBIGUOUS_VERSION' when source_error is not null then source_error when mismatch then 'HASH_MISMATCH' when missing then 'SOURCE_MISSING'
  when tampered then 'CANONICAL_SEMANTIC_DRIFT' when drifted then 'DRIFT_DETECTED' when not found then 'NOT_FOUND' end as error_semantic from f)
select ref, case when error_semantic is null then 'success' when error_semantic = 'CANONICAL_SEMANTIC_DRIFT' then 'review_required' else 'fail_closed' end as status, error_semantic from e""",
)
def condition_chain(t: Substrate) -> DataFrame:
    k = F.col("doc_id")
    flags = {"locked": k % 29 == 0, "ambiguous": k % 13 == 0, "source_error": F.when(k % 23 == 0, "SOURCE_UNAVAILABLE"), "mismatch": k % 7 == 0, "missing": k % 11 == 0, "tampered": k % 5 == 0, "drifted": k % 17 == 0, "found": k % 3 > 0}
    return integrity.condition(t.documents.select(F.col("id").alias("ref"), *[c.alias(n) for n, c in flags.items()]))


@registered(
    "versions",
    """, c as (select version_ref as id, entity_id, version, role, text from versions)
select 'AMBIGUITY_SILENTLY_RESOLVED' as code, id as claim_id from c where version % 3 = 0 and role = 'user'
union all select 'UNVERIFIED_FACT_ASSERTED_AS_AUTHORITATIVE', id from c where version % 4 = 1
union all select distinct 'HISTORICAL_SOURCE_SUBSTITUTION', entity_id from c where version % 5 = 2""",
)
def civ_answers(t: Substrate) -> DataFrame:
    v, n = t.versions, F.col("version")
    answers = v.select(F.col("version_ref").alias("answer_id"), F.when(n % 3 == 0, "AMBIGUOUS_VERSION").alias("expected_error"), F.when(F.col("role") == "user", "success").otherwise("fail_closed").alias("status"), F.lit(1).alias("rows"))
    facts = v.select(F.col("version_ref").alias("subject"), F.lit("role").alias("predicate"), F.col("role").alias("value"))
    asserted = v.select(F.col("version_ref").alias("claim_id"), F.col("version_ref").alias("subject"), F.lit("role").alias("predicate"), F.when(n % 4 == 1, "nobody").otherwise(F.col("role")).alias("value"))
    pinned = v.select(F.col("entity_id").alias("answer_id"), F.col("version_ref").alias("ref"), F.sha2("text", 256).alias("content_hash"), F.lit("c").alias("git_commit"))
    given = pinned.join(v.select(F.col("version_ref").alias("ref"), "version"), "ref").withColumn("content_hash", F.when(n % 5 == 2, "other").otherwise(F.col("content_hash")))
    found = integrity.silent_ambiguity(answers).unionByName(integrity.unverified_facts(asserted, facts, "authoritative").select("code", "claim_id"))
    return found.unionByName(integrity.substituted(given, pinned))


@registered("", "select count(*) as n, 'sha256:' || sha256(string_agg(substr('conversations/' || conv_id || '/v' || turn, 15) || ':' || sha256(text), chr(10) order by substr('conversations/' || conv_id || '/v' || turn, 15))) as digest from conversations")
def path_snapshot(t: Substrate) -> DataFrame:
    return integrity.path_snapshot(t.versions.select("path", _text("sha256:", F.sha2("text", 256)).alias("content_hash")), "conversations/")


def _committed(t: Substrate) -> DataFrame:
    """Files as two commits have them: all in c0, those of even turns in c1."""
    files = t.versions.select("path", _text("sha256:", F.sha2("text", 256)).alias("content_hash"), F.explode(F.when(F.col("version") % 2 == 0, F.array(F.lit("c0"), F.lit("c1"))).otherwise(F.array(F.lit("c0")))).alias("git_commit"))
    return files


_COMMITTED = "files as (select c as git_commit, conv_id, turn, 'v' || turn as rel, sha256(text) as h from conversations, (select unnest(['c0', 'c1']) as c) where c = 'c0' or turn % 2 = 0)"


@registered("", f"with {_COMMITTED} select git_commit, 'conversations/' || conv_id as directory, count(*) as n, 'sha256:' || sha256(string_agg(rel || ':' || h, chr(10) order by rel)) as digest from files group by git_commit, conv_id")
def directories_at_commits(t: Substrate) -> DataFrame:
    wanted = t.versions.select(F.explode(F.array(F.lit("c0"), F.lit("c1"))).alias("git_commit"), F.regexp_replace("path", "v[0-9]+$", "").alias("path"))
    return integrity.directory_at(_committed(t), wanted)


@registered(
    "",
    """with w as (select 'c1' as git_commit, conv_id, turn from conversations)
select git_commit, 'conversations/' || conv_id || '/v' || turn as path, case when turn % 2 = 0 then 'file' end as kind from w
union all select distinct git_commit, 'conversations/' || conv_id, 'directory' from w union all select distinct git_commit, 'conversations/' || conv_id || '/none', null from w""",
)
def paths_at_commits(t: Substrate) -> DataFrame:
    v = t.versions
    folder = F.regexp_replace("path", "/v[0-9]+$", "")
    wanted = v.select("path").union(v.select(_text(folder, "/")).distinct()).union(v.select(_text(folder, "/none")).distinct())
    return integrity.exists_at(wanted.withColumn("git_commit", F.lit("c1")), _committed(t))


# ---- receipts: each turn of a conversation after the first revises the one before


def _revisions(t: Substrate) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events, receipts, definitions and pins, with a fault of each kind planted by number."""
    v = t.versions
    conv = F.regexp_extract("entity_id", "([0-9]+)$", 1).cast("long")
    k = (conv * 10 + F.col("version")).alias("k")
    hash_ = _text("sha256:", F.sha2("text", 256))
    path = lambda ref: _text("definitions/", F.col("entity_id"), "/", ref, ".yaml")
    before = v.select(F.col("version_ref").alias("b_ref"), hash_.alias("b_hash"))
    v = v.select("*", k, conv.alias("conv"), hash_.alias("h"), _text("EV-", conv, "-", F.col("version")).alias("event_id")).join(before, F.col("previous") == F.col("b_ref"), "left")
    bad = lambda n, value, otherwise: F.when(F.col("k") % n == 0, value).otherwise(otherwise)
    nothing = F.lit(None).cast("string")
    own = F.col("event_id")
    later = v.where("version > 0")
    events = later.select(
        "event_id", bad(41, "x", own).alias("inner_id"), _text("TX-", own).alias("transaction_id"), _text("sha256:", F.sha2(own, 256)).alias("event_hash"), F.col("version_ref").alias("subject"), "previous",
        bad(43, nothing, path(F.col("version_ref"))).alias("definition_path"), bad(47, "bad", F.col("h")).alias("definition_hash"), F.col("h").alias("proposed_hash"), F.lit("ab").alias("approved_before_hash"),
        bad(53, nothing, path(F.col("previous"))).alias("previous_path"), bad(59, "bad", F.col("b_hash")).alias("previous_hash"),
    )
    receipts = later.where("k % 37 <> 0").select(
        "event_id", own.alias("inner_id"), bad(61, "TX-no", _text("TX-", own)).alias("transaction_id"), _text("sha256:", F.sha2(own, 256)).alias("event_hash"), bad(67, "no", F.col("h")).alias("definition_hash"),
        F.lit("ab").alias("approved_before_hash"), F.sha2("version_ref", 256).alias("approved_after_hash"), bad(71, F.col("previous"), F.col("version_ref")).alias("approved_ref_after"), "k",
    )
    digest = ledger.digest_of(**{c: F.col(c) for c in ("event_hash", "definition_hash", "approved_after_hash", "approved_ref_after")})
    receipts = receipts.withColumn("output_digest", bad(73, "no", digest)).drop("k")
    definitions = v.select(path(F.col("version_ref")).alias("path"), F.col("h").alias("content_hash"), "entity_id", bad(79, "zz", F.col("version_ref")).alias("version_ref"), "previous")
    pins = v.where("version = 0 and conv % 11 <> 0").select(path(F.col("version_ref")).alias("path"), F.when(F.col("conv") % 13 == 0, "other").otherwise(F.col("h")).alias("content_hash"))
    return events, receipts, definitions, pins


_REVISED = """with recursive v as (select conv_id as c, turn as n, conv_id * 10 + turn as k, 'conv:' || conv_id as entity, 'conv:' || conv_id || '@v' || turn as ref, 'sha256:' || sha256(text) as h,
  'EV-' || conv_id || '-' || turn as event_id, 'definitions/conv:' || conv_id || '/conv:' || conv_id || '@v' || turn || '.yaml' as path, max(turn) over (partition by conv_id) as last from conversations),
own as (select a.*, case when a.k % 37 = 0 then 'receipt-missing' when a.k % 41 = 0 then 'event-internal-id-mismatch' when a.k % 61 = 0 then 'tx-id-mismatch' when a.k % 43 = 0 then 'definition-output-ref-missing'
  when a.k % 67 = 0 then 'definition-hash-mismatch' when a.k % 47 = 0 then 'output-refs-definition-hash-mismatch' when a.k % 71 = 0 then 'approved-ref-after-mismatch' when a.k % 73 = 0 then 'output-digest-mismatch'
  when a.k % 79 = 0 then 'definition-version-ref-mismatch' when a.k % 53 = 0 then 'previous-input-ref-missing' end as local,
  case when a.n = 1 and (a.c % 11 = 0 or a.c % 13 = 0) then 'previous-authority-missing' when a.k % 59 = 0 then 'previous-input-ref-authority-mismatch' end as chain from v a where a.n > 0),
walked as (select c, n, event_id, ref, h, k, coalesce(local, chain) as fault from own where n = 1
  union all select o.c, o.n, o.event_id, o.ref, o.h, o.k, coalesce(o.local, case when w.fault is not null then 'previous-authority-missing' end, o.chain) from walked w join own o on o.c = w.c and o.n = w.n + 1)"""


@registered("", _REVISED + " select event_id, ref as subject, fault, case when k % 37 = 0 then null when k % 67 = 0 then 'no' else h end as definition_hash from walked")
def revision_receipts(t: Substrate) -> DataFrame:
    return ledger.revision_faults(*_revisions(t))


@registered(
    "",
    _REVISED
    + """ select v.ref, case when v.n > 0 then case when w.fault is null then w.h end when v.c % 11 <> 0 and v.c % 13 <> 0 then v.h end as authority,
  case when v.n > 0 and w.fault is null then 'receipt' when v.n = 0 and v.c % 11 <> 0 and v.c % 13 <> 0 then 'pin' end as origin,
  case when v.n > 0 and w.fault is not null or v.n = 0 and v.c % 11 = 0 then 'PROVENANCE_BROKEN' when v.n = 0 and v.c % 13 = 0 then 'DEF_POINTER_DIVERGED' end as condition from v left join walked w on v.c = w.c and v.n = w.n""",
)
def predecessor_authority(t: Substrate) -> DataFrame:
    events, receipts, definitions, pins = _revisions(t)
    asked = t.versions.select(F.col("version_ref").alias("ref"), _text("definitions/", F.col("entity_id"), "/", F.col("version_ref"), ".yaml").alias("path"))
    return ledger.predecessor_authority(asked, ledger.revision_faults(events, receipts, definitions, pins), pins, definitions.select("path", "content_hash"))


@registered(
    "",
    """with v as (select conv_id as c, 'definitions/conv:' || conv_id || '/conv:' || conv_id || '@v0.yaml' as path from conversations where turn = 0)
select path, 'DEF_POINTER_DIVERGED' as code from v where c % 11 = 0 or c % 13 = 0""",
)
def bootstrap_pins(t: Substrate) -> DataFrame:
    _, _, definitions, pins = _revisions(t)
    return ledger.bootstrap_faults(pins, definitions.where("previous is null").select("path", "content_hash"))


def _marked(t: Substrate) -> tuple[DataFrame, ...]:
    events, receipts, definitions, pins = _revisions(t)
    faults = ledger.revision_faults(events, receipts, definitions, pins)
    existing = events.where("subject like '%@v1' or subject like '%@v3'").select("transaction_id")
    return events, receipts, definitions, pins, faults, existing


@registered("", _REVISED + " select event_id, 'TX-' || event_id as transaction_id, case when fault is not null then 'needs_reconcile' when n in (1, 3) then 'committed' else 'rebuilt' end as state from walked")
def marker_rebuild(t: Substrate) -> DataFrame:
    events, _, _, _, faults, existing = _marked(t)
    return ledger.markers(faults, events, existing)


@registered(
    "",
    _REVISED
    + """, last as (select c, max(n) as n from walked where fault is null group by c), x as (select l.c, l.n, o.last from last l join (select c, any_value(last) as last from own group by c) o using (c))
select 'recovery' as "check", 'TX-' || event_id as subject, 'NEEDS_RECONCILE' as code from walked where k % 5 in (1, 3)
union all select 'receipt', event_id, 'NEEDS_RECONCILE' from walked where fault is not null
union all select 'marker', 'TX-' || event_id, 'PROVENANCE_BROKEN' from walked where n in (1, 3) and k % 37 = 0
union all select 'approval', event_id, 'APPROVAL_EVIDENCE_MISMATCH' from walked where fault is null and k % 3 = 0
union all select 'pointer', 'conv:' || c, case when c % 9 = 0 then 'PROVENANCE_BROKEN' else 'DEF_POINTER_DIVERGED' end from x where c % 9 = 0 or n <> last
union all select 'bootstrap', 'definitions/conv:' || conv_id || '/conv:' || conv_id || '@v0.yaml', 'DEF_POINTER_DIVERGED' from conversations where turn = 0 and (conv_id % 11 = 0 or conv_id % 13 = 0)""",
)
def tx_reconcile_issues(t: Substrate) -> DataFrame:
    events, receipts, definitions, pins, faults, existing = _marked(t)
    k = F.regexp_extract("event_id", "-([0-9]+)-", 1).cast("long") * 10 + F.regexp_extract("event_id", "([0-9]+)$", 1).cast("long")
    actions = F.element_at(F.array(*[F.lit(a) for a in ("abort", "hold", "complete", "resume", "complete")]), (k % 5 + 1).cast("int"))
    recoveries = events.select(F.col("transaction_id").alias("tx"), actions.alias("action"))
    claims = events.withColumns({"approval_ref": _text("APR-", k), "approval_digest": F.sha2("event_id", 256)})
    approvals = claims.select("approval_ref", F.when(k % 3 == 0, "other").otherwise(F.col("approval_digest")).alias("digest"))
    last = t.versions.groupBy("entity_id").agg(F.max_by("version_ref", "version").alias("ref"), F.max("version").alias("n")).where("n > 0")
    conv = F.regexp_extract("entity_id", "([0-9]+)$", 1).cast("long")
    pointers = last.select("entity_id", F.when(conv % 9 > 0, F.col("ref")).alias("ref"), F.sha2("ref", 256).alias("content_hash"))
    current = t.spark.createDataFrame([("REPORT-001",)], "report string").where("false")
    starts = ledger.bootstrap_faults(pins, definitions.where("previous is null").select("path", "content_hash"))
    return ledger.tx_issues(recoveries, ledger.markers(faults, events, existing), existing, claims, receipts, approvals, current, pointers, faults, starts)


@registered(
    "docs",
    """, e as (select doc_id as k, 'EV-' || doc_id as event_id, path, content_hash as h, case when doc_id % 23 = 0 then null when doc_id % 5 = 0 then 'sha256:1' else content_hash end as now from docs)
select event_id, case when k % 31 = 0 then 'receipt-missing' when k % 37 = 0 then 'event-id-mismatch' when k % 41 = 0 then 'tx-id-mismatch' when k % 43 = 0 then 'event-hash-mismatch' when k % 47 = 0 then 'report-hash-mismatch'
  when k % 53 = 0 then 'manifest-hash-mismatch' when now is null or now <> h then 'report-file-mismatch' when k % 59 = 0 then 'output-digest-mismatch' when k % 61 = 0 then 'current-after-mismatch' end as fault from e
union all select 'EV-none-' || r_regionkey, 'event-missing' from region""",
)
def freeze_receipts(t: Substrate) -> DataFrame:
    d = t.documents
    bad = lambda n, value, otherwise: F.when(F.col("doc_id") % n == 0, value).otherwise(otherwise)
    own, h = _text("EV-", F.col("doc_id")), F.col("content_hash")
    events = d.select(own.alias("event_id"), F.lit("TX").alias("transaction_id"), F.sha2(own, 256).alias("event_hash"), F.col("path").alias("report_path"), h.alias("report_hash"), F.lit("m").alias("manifest_path"), F.lit("mh").alias("manifest_hash"), bad(61, "other", F.lit("cur")).alias("current_hash"))
    receipts = d.where("doc_id % 31 <> 0").select("doc_id", own.alias("event_id"), bad(37, "x", own).alias("inner_id"), bad(41, "x", F.lit("TX")).alias("transaction_id"), bad(43, "x", F.sha2(own, 256)).alias("event_hash"), bad(47, "x", h).alias("report_hash"), bad(53, "x", F.lit("mh")).alias("manifest_hash"), F.lit("cur").alias("current_after_hash"))
    receipts = receipts.withColumn("output_digest", bad(59, "x", ledger.digest_of(**{c: F.col(c) for c in ("report_hash", "manifest_hash", "current_after_hash")}))).drop("doc_id")
    stray = t.table("region").select(_text("EV-none-", F.col("r_regionkey")).alias("event_id"))
    receipts = receipts.unionByName(stray, allowMissingColumns=True)
    files = t.live.unionByName(t.spark.createDataFrame([("m", "mh")], "path string, content_hash string"))
    return ledger.freeze_faults(events, receipts, files)


@registered(
    "",
    """select conv_id || '/' || turn as request, case when turn % 4 = 1 then 'DEF_PAYLOAD_MISMATCH' when turn % 4 = 2 or turn % 7 = 3 then 'DEF_IDENTITY_MISMATCH' when turn % 5 = 4 then 'DEF_SUCCESSOR_MISMATCH' end as fault from conversations""",
)
def wrap_rules(t: Substrate) -> DataFrame:
    v, n = t.versions, F.col("version")
    subject = _text(F.col("entity_id"), "@v", F.when(n % 5 == 4, n + 2).otherwise(n + 1))
    keys = F.when(n % 4 == 1, F.array(F.lit("title"), F.lit("previous"))).otherwise(F.array(F.lit("title")))
    inputs = v.select(F.regexp_replace(F.regexp_replace("path", "conversations/", ""), "/v", "/").alias("request"), "entity_id", F.col("entity_id").alias("entity"), F.col("version_ref").alias("expected"), subject.alias("subject"), keys.alias("keys"), n.alias("n"))
    inputs = inputs.select("*", F.when(F.col("n") % 7 == 3, "other").otherwise(F.col("entity")).alias("inner_entity"), F.when(F.col("n") % 4 == 2, "other").otherwise(F.col("subject")).alias("inner_version"), F.col("expected").alias("inner_previous"))
    return ledger.wrap_faults(inputs)


# ---- an index over files made from tables


def _tree(t: Substrate) -> workspace.Index:
    """Customers are runs, suppliers raw files, nations organized notes, regions experiments, orders reports with sidecars."""
    c = F.col
    exp = lambda k: _text("EXP-", c(k) % 5)
    raw = lambda k: _text("raw/", exp(k), "/R", c(k))
    note = lambda k: _text("organized/", exp(k), "/n", c(k), ".md")
    report = _text("reports/history/REPORT-", F.lpad(c("o_orderkey").cast("string"), 9, "0"))
    status = F.when(c("c_custkey") % 6 == 0, "failed").otherwise("completed")
    rows = [
        t.table("supplier").select(_text(raw("s_nationkey"), "/s", c("s_suppkey"), ".csv").alias("path"), c("s_name").alias("text")),
        t.table("nation").where("n_nationkey % 4 = 1").select(_text(raw("n_nationkey"), "/STATUS.yaml").alias("path"), F.lit("status: invalid\n").alias("text")),
        t.table("nation").select(note("n_nationkey").alias("path"), _text("---\nid: N", c("n_nationkey"), F.when(c("n_nationkey") % 3 > 0, _text("\nversion: ", c("n_nationkey") % 3)).otherwise(""), "\nsources:\n  - path: ", raw("n_nationkey"), "\n    content_hash: sha256:0\n---\n# ", c("n_name"), "\n").alias("text")),
        t.table("customer").select(_text("runs/R", c("c_custkey"), "/manifest.yaml").alias("path"), _text("run_id: R", c("c_custkey"), "\nexperiment_ref: ", exp("c_nationkey"), "@v1\nstatus: ", status, "\nmodel: ", c("c_mktsegment"), "\nraw_ref:\n  path: ", raw("c_nationkey"), "\n  git_commit: abcdef0123\n").alias("text")),
        t.table("region").select(_text("experiments/EXP-", c("r_regionkey"), "/spec.yaml").alias("path"), F.lit("version: 1\n").alias("text")),
        t.table("orders").select(_text(report, ".md").alias("path"), _text("report ", c("o_orderkey")).alias("text")),
        t.table("orders").where("o_orderkey % 2 = 0").select(_text(report, ".sources.yaml").alias("path"), _text("sources:\n  - path: ", note("o_custkey"), "\n    git_commit: 0123456789abcdef\n").alias("text")),
    ]
    files = reduce(DataFrame.unionByName, rows).select("path", c("text").cast("binary").alias("content"), _text("sha256:", F.sha2("text", 256)).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))
    return workspace.Index(files, "c0")


_TREE = """files as (
  select 'raw/EXP-' || s_nationkey % 5 || '/R' || s_nationkey as dir, 's' || s_suppkey || '.csv' as rel, sha256(s_name) as h, s_nationkey as n from supplier
  union all select 'raw/EXP-' || n_nationkey % 5 || '/R' || n_nationkey, 'STATUS.yaml', sha256('status: invalid' || chr(10)), n_nationkey from nation where n_nationkey % 4 = 1),
rep as (select o_orderkey as k, o_custkey as c, 'REPORT-' || lpad(o_orderkey::varchar, 9, '0') as id from orders)"""


@registered(
    "",
    f"""with {_TREE} select dir as id, 'raw' as doc_type, dir as path, null as version, 'sha256:' || sha256(string_agg(rel || ':' || h, chr(10) order by rel)) as content_hash, case when bool_or(rel = 'STATUS.yaml') then 'invalid' else 'valid' end as status from files group by dir
union all select id, 'report_historical', 'reports/history/' || id || '.md', null, 'sha256:' || sha256('report ' || k), 'frozen' from rep
union all select 'R' || c_custkey, 'run_manifest', 'runs/R' || c_custkey || '/manifest.yaml', null, 'sha256:' || sha256('run_id: R' || c_custkey || chr(10) || 'experiment_ref: EXP-' || c_nationkey % 5 || '@v1' || chr(10) || 'status: ' || case when c_custkey % 6 = 0 then 'failed' else 'completed' end
  || chr(10) || 'model: ' || c_mktsegment || chr(10) || 'raw_ref:' || chr(10) || '  path: raw/EXP-' || c_nationkey % 5 || '/R' || c_nationkey || chr(10) || '  git_commit: abcdef0123' || chr(10)), case when c_custkey % 6 = 0 then 'failed' else 'completed' end from customer
union all select 'EXP-' || r_regionkey, 'experiment_spec', 'experiments/EXP-' || r_regionkey || '/spec.yaml', null, 'sha256:' || sha256('version: 1' || chr(10)), 'frozen' from region
union all select 'N' || n_nationkey, 'organized', 'organized/EXP-' || n_nationkey % 5 || '/n' || n_nationkey || '.md', 'v' || case when n_nationkey % 3 > 0 then n_nationkey % 3 else 1 end, 'sha256:' || sha256('---' || chr(10) || 'id: N' || n_nationkey || case when n_nationkey % 3 > 0 then chr(10) || 'version: ' || n_nationkey % 3 else '' end
  || chr(10) || 'sources:' || chr(10) || '  - path: raw/EXP-' || n_nationkey % 5 || '/R' || n_nationkey || chr(10) || '    content_hash: sha256:0' || chr(10) || '---' || chr(10) || '# ' || n_name || chr(10)), 'valid' from nation""",
)
def index_documents(t: Substrate) -> DataFrame:
    return _tree(t).documents.drop("git_commit")


@registered("", "select 'R' || c_custkey as run_id, 'EXP-' || c_nationkey % 5 || '@v1' as experiment_ref, case when c_custkey % 6 = 0 then 'failed' else 'completed' end as status, c_mktsegment as model, 'raw/EXP-' || c_nationkey % 5 || '/R' || c_nationkey as raw_ref_path, 'abcdef0123' as raw_ref_commit from customer")
def index_runs(t: Substrate) -> DataFrame:
    return _tree(t).runs.select("run_id", "experiment_ref", "status", "model", "raw_ref_path", "raw_ref_commit")


@registered(
    "",
    f"""with {_TREE} select 'R' || c_custkey as owner, 'raw/EXP-' || c_nationkey % 5 || '/R' || c_nationkey as ref_path, 'directory' as source_type, 'historical' as reference_scope, '' as content_hash, 'abcdef0123' as git_commit from customer
union all select 'N' || n_nationkey, 'raw/EXP-' || n_nationkey % 5 || '/R' || n_nationkey, 'directory', 'historical', 'sha256:0', null from nation
union all select id, 'organized/EXP-' || c % 5 || '/n' || c || '.md', 'file', 'current', '', '0123456789abcdef' from rep where k % 2 = 0""",
)
def index_source_refs(t: Substrate) -> DataFrame:
    return _tree(t).source_refs.select("owner", "ref_path", "source_type", "reference_scope", "content_hash", "git_commit")


@registered(
    "",
    f"""with {_TREE} select 'N' || n_nationkey as source, 'organized_from' as relation, 'raw/EXP-' || n_nationkey % 5 || '/R' || n_nationkey as target, null as target_version from nation
union all select 'R' || c_custkey, 'uses', 'raw/EXP-' || c_nationkey % 5 || '/R' || c_nationkey, null from customer
union all select id, 'based_on', 'organized/EXP-' || c % 5 || '/n' || c || '.md', '01234567' from rep where k % 2 = 0
union all select * from (select id, 'supersedes', lag(id) over (order by id) as b, null from rep) where b is not null""",
)
def index_relations(t: Substrate) -> DataFrame:
    return _tree(t).relations


# ---- the vector whose answers are known


@registered("", "select * from (values ('A', 0.55::double, 0.85::double), ('B', 0.1::double, 0.3::double), ('A-B', 0.25::double, 0.75::double)) as v(participant, low, high)")
def bootstrap_known_answer(t: Substrate) -> DataFrame:
    """Eight families with two instances each and five repetitions; the contract fixes the input, the seed and the intervals."""
    bits = {"A": ("11111", "01010"), "B": ("00000", "01010")}
    passes = [(p, f"F{f:02d}", f"I{i}", n, int(b)) for p, both in bits.items() for f in range(1, 9) for i, row in enumerate(both) for n, b in enumerate(row)]
    scores = scoring.instance_scores(t.spark.createDataFrame(passes, "participant string, family string, instance string, repetition int, passed int"))
    estimates = scoring.bootstrap(scores, "f25bf832810e022df4c1a9ff893497c3e4fc83f844efeb0bee3221f7c03a96cf")
    every = estimates.unionByName(scoring.paired(estimates, "A", "B"))
    ends = scoring.interval(every)
    return ends.select("participant", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


# ---- scenarios: each conversation is one, each turn a checkpoint

_GOLD = """with g as (select conv_id as scenario, turn as n, conv_id || ':' || turn as capture, conv_id * 10 + turn as k, (conv_id * 10 + turn) % 4 = 0 as closed from conversations),
p as (select *, case when k % 19 = 0 then 'none' when k % 23 = 0 then 'twice' when k % 17 = 0 then 'unfit' else 'ok' end as given from g),
k as (select scenario, capture, k, closed, given, unnest(case when given in ('none', 'twice') then ['prediction_present'] when given = 'unfit' then ['prediction_present', 'prediction_contract']
  when closed then ['prediction_present', 'prediction_contract', 'expected_condition', 'closed'] else ['prediction_present', 'prediction_contract', 'expected_condition', 'result_set_exact', 'stale_set_exact', 'as_of_exact', 'version_binding_exact', 'asserted_facts_exact', 'routing_policy'] end) as kind from p),
checks as (select scenario, capture, kind, case kind when 'prediction_present' then given in ('ok', 'unfit') when 'prediction_contract' then given = 'ok' when 'expected_condition' then k % 5 > 0 when 'closed' then k % 3 > 0 when 'result_set_exact' then k % 6 <> 5
    when 'stale_set_exact' then k % 6 <> 5 when 'as_of_exact' then k % 7 > 0 when 'routing_policy' then k % 11 > 0 else k % 13 > 0 end as passed,
  case kind when 'result_set_exact' then case when k % 6 = 5 then 1 else 2 end when 'stale_set_exact' then case when k % 6 = 5 then 0 else 1 end end::bigint as tp, case kind when 'result_set_exact' then case when k % 6 = 5 then 1 else 0 end when 'stale_set_exact' then case when k % 6 = 5 then 1 else 0 end end::bigint as fp,
  case kind when 'result_set_exact' then case when k % 6 = 5 then 1 else 0 end when 'stale_set_exact' then case when k % 6 = 5 then 1 else 0 end end::bigint as fn from k
  union all select 'none', 'none:' || r_regionkey, 'unexpected', false, null, null, null from region)"""


def _scenarios(t: Substrate) -> tuple[DataFrame, DataFrame]:
    """Checkpoints, and what an engine of many faults answers, as JSON."""
    c = t.table("conversations")
    k = F.col("conv_id") * 10 + F.col("turn")
    capture = _text(F.col("conv_id"), ":", F.col("turn"))
    rows = c.select(F.col("conv_id").cast("string").alias("scenario"), capture.alias("capture"), k.alias("k"))
    text = lambda *parts: _text(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    closed = F.col("k") % 4 == 0
    ref = lambda n: text("r", F.col("k"), f".{n}")
    body = F.when(closed, F.lit('{"expected_condition":{"status":"fail_closed","error_semantic":"NOT_FOUND","behavior":"fail_closed"}}')).otherwise(
        text('{"expected_condition":{"status":"success","error_semantic":null,"behavior":"answer"},"results":[{"ref":"', ref(1), '"},{"ref":"', ref(2), '"}],"stale_set":["', ref(2), '"],"as_of":"t', F.col("k"), '","version_bindings":[{"subject":"s","value":"', F.col("k"), '"}],"asserted_facts":[{"predicate":"bound_version","subject":"s","value":"', F.col("k"), '"}],"route_sequence":["exact"]}')
    )
    gold = rows.select("scenario", "capture", body.alias("body"))
    when = lambda n, rest, yes, no: F.when(F.col("k") % n == rest, yes).otherwise(no)
    result = lambda r, stale: text('{"ref":"', r, '","entity_id":null,"version_ref":null,"path":null,"content_hash":null,"git_commit":null,"status":null,"is_stale":', stale, ',"relation_type":null,"section":null,"is_available":true}')
    two = text(result(ref(1), "false"), ",", result(F.when(F.col("k") % 6 == 5, ref(9)).otherwise(ref(2)), "true"))
    results = F.when(closed, when(3, 0, result(ref(1), "false"), F.lit(""))).otherwise(two)
    status = when(5, 0, F.lit('"status":"error","error_semantic":"X"'), F.when(closed, '"status":"fail_closed","error_semantic":"NOT_FOUND"').otherwise('"status":"success","error_semantic":null'))
    facts = F.when(closed, "").otherwise(text('{"subject":"s","value":"', F.col("k") + (F.col("k") % 13 == 0).cast("int"), '","predicate":"bound_version"}'))
    said = text('{"schema_version":"prediction/v1","capture_id":"', F.col("capture"), '",', status, ',"warnings":[],"errors":[],"results":[', results, '],"provenance_graph":null,"asserted_facts":[', facts, '],"evidence":[],"retrieval_mode":null,"ranking_authority":null,"route_sequence":[', when(11, 0, F.lit('"lexical"'), F.lit('"exact"')), '],"as_of":"t', F.col("k") + (F.col("k") % 7 == 0).cast("int"), '"', when(17, 0, F.lit(',"more":1'), F.lit("")), "}")
    given = rows.where("k % 19 <> 0").select("scenario", "capture", said.alias("body"), F.explode(when(23, 0, F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)))).alias("times")).drop("times")
    stray = t.table("region").select(F.lit("none").alias("scenario"), _text("none:", F.col("r_regionkey")).alias("capture"), F.lit("{}").alias("body"))
    return gold, given.unionByName(stray)


@registered("", _GOLD + " select * from checks")
def scenario_checks(t: Substrate) -> DataFrame:
    return checks.judge(*_scenarios(t))


@registered(
    "",
    _GOLD
    + """, civ as (select conv_id::varchar as scenario from conversations where conv_id % 8 = 1), v as (select scenario, count(*) as n from civ group by scenario)
select c.scenario, bool_and(passed) and coalesce(any_value(v.n), 0) = 0 as passed, (bool_and(passed) and coalesce(any_value(v.n), 0) = 0)::int::double as score, coalesce(any_value(v.n), 0) as civ_count,
  0::bigint as impact_tp, 0::bigint as impact_fp, 0::bigint as impact_fn, coalesce(sum(tp) filter (where kind = 'stale_set_exact'), 0)::bigint as stale_tp, coalesce(sum(fp) filter (where kind = 'stale_set_exact'), 0)::bigint as stale_fp, coalesce(sum(fn) filter (where kind = 'stale_set_exact'), 0)::bigint as stale_fn,
  bool_and(passed) filter (where kind = 'version_binding_exact') as version_correct, null::boolean as graph_exact_match, bool_and(passed) filter (where kind = 'closed') as fail_closed_correct
from checks c left join v on c.scenario = v.scenario group by c.scenario""",
)
def scenario_outcomes(t: Substrate) -> DataFrame:
    civ = t.table("conversations").where("conv_id % 8 = 1").select(F.col("conv_id").cast("string").alias("scenario"))
    return checks.outcomes(checks.judge(*_scenarios(t)), civ)


_KINDS = ("external_update", "semantic_change", "raw_invalidation", "create_version", "duplicate_version", "delete_file", "tamper_file", "create_file", "delete_tree", "touch_file", "corrupt_index", "semantic_tamper", "runtime_deviation")


@registered(
    "",
    """with m as (select event_id as step, event_id % 13 as k, case when event_id % 13 in (3, 7) then 'new:' || event_id when event_id % 13 = 8 then 'raw' when event_id % 5 = 0 then 'customer:0' else 'nation:' || (event_id % 25) end as target from events),
marked as (select target as ref, k, case k when 0 then 'changed' when 1 then 'changed' when 2 then 'invalid' when 3 then 'changed' when 4 then 'ambiguous' when 5 then 'missing' when 6 then 'mismatched' when 7 then 'orphan' when 11 then 'tampered' when 12 then 'mismatched' end as mark from m)
select distinct ref, case when ref = 'customer:0' then 'unknown' else mark end as mark from marked where mark is not null
union select ref, 'changed' from marked where k = 2 and ref <> 'customer:0'
union select 'customer:' || c_custkey, 'stale' from customer where 'nation:' || c_nationkey in (select ref from marked where k = 2) union select 'supplier:' || s_suppkey, 'stale' from supplier where 'nation:' || s_nationkey in (select ref from marked where k = 2)
union select 'order:' || o_orderkey, 'stale' from orders join customer on o_custkey = c_custkey where 'nation:' || c_nationkey in (select ref from marked where k = 2)
union select 'order:' || l_orderkey, 'stale' from lineitem join supplier on l_suppkey = s_suppkey where 'nation:' || s_nationkey in (select ref from marked where k = 2)""",
)
def mutation_marks(t: Substrate) -> DataFrame:
    k = F.col("event_id") % 13
    target = F.when(k.isin(3, 7), _text("new:", F.col("event_id"))).when(k == 8, "raw").when(F.col("event_id") % 5 == 0, "customer:0").otherwise(_text("nation:", F.col("event_id") % 25))
    m = t.table("events").select(F.col("event_id").alias("step"), F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k + 1).cast("int")).alias("kind"), target.alias("target"))
    return transactions.marks(m, t.objects.where("ref <> 'customer:0'"), t.relations)


@registered("", "select case when arg_max(event_id % 13, event_id) filter (where event_id % 13 in (7, 9, 10)) is null then 'present' else 'stale' end as state from events")
def mutation_index_state(t: Substrate) -> DataFrame:
    k = F.col("event_id") % 13
    m = t.table("events").select(F.col("event_id").alias("step"), F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k + 1).cast("int")).alias("kind"), F.lit("raw").alias("target"))
    return transactions.index_state(m)


# ---- entities of an index, framed files, sealed manifests, dumps


def _definitions(t: Substrate) -> workspace.Index:
    """Turns as versions of definitions that are based on the version before and, by declaration, on a part; some can't be read. Customers are runs that use the first version of one."""
    v = t.versions
    body = _text("entity_id: ", F.col("entity_id"), "\nversion_ref: ", F.col("version_ref"), "\nbased_on: ", F.coalesce("previous", F.lit("none")), "\ndependencies:\n  uses:\n    - ref: part:", F.col("version"), "@v1\n    - plain\n", F.when(F.col("version") % 5 == 4, "entity_id: again\n").otherwise(""))
    files = v.select(_text("definitions/", F.regexp_replace("entity_id", ":", "-"), "/", F.regexp_replace("version_ref", ":", "-"), ".yaml").alias("path"), body.alias("text"))
    c = F.col("c_custkey")
    runs = t.table("customer").select(_text("runs/R", c, "/manifest.yaml").alias("path"), _text("status: completed\nrelations:\n  caused_by: conv:", c % 20, "@v0\n").alias("text"))
    more = t.table("region").select(_text("organized/n", F.col("r_regionkey"), ".md").alias("path"), _text("version_ref: TS-", F.col("r_regionkey"), "@r1\nreferences:\n  - conv:1@v0\n").alias("text"))
    every = files.unionByName(runs).unionByName(more)
    return workspace.Index(every.select("path", F.col("text").cast("binary").alias("content"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size")))


_ENTITIES = """with e as (select case when turn % 5 = 4 then 'conv-' || conv_id else 'conv:' || conv_id end as entity_id, case when turn % 5 = 4 then 'conv-' || conv_id || '@v' || turn else 'conv:' || conv_id || '@v' || turn end as version_ref, 'definition' as kind,
  'definitions/conv-' || conv_id || '/conv-' || conv_id || '@v' || turn || '.yaml' as path, case when turn % 5 = 4 then 'IMPACT_INVALID' end as condition, conv_id, turn from conversations
  union all select 'R' || c_custkey, 'R' || c_custkey, 'run', 'runs/R' || c_custkey || '/manifest.yaml', null, c_custkey % 20, null from customer
  union all select 'n' || r_regionkey, 'TS-' || r_regionkey || '@r1', 'organized', 'organized/n' || r_regionkey || '.md', null, 1, null from region)"""


@registered("", _ENTITIES + " select entity_id, version_ref, kind, path, condition from e")
def impact_entities(t: Substrate) -> DataFrame:
    return _definitions(t).impact_entities.drop("body")


@registered(
    "",
    _ENTITIES
    + """ select version_ref, 'based_on' as relation, 'conv:' || conv_id || '@v' || (turn - 1) as ref from e where kind = 'definition' and condition is null and turn > 0
union all select version_ref, 'uses', 'part:' || turn || '@v1' from e where kind = 'definition' and condition is null union all select version_ref, 'caused_by', 'conv:' || conv_id || '@v0' from e where kind = 'run'
union all select version_ref, 'references', 'conv:1@v0' from e where kind = 'organized'""",
)
def declared_references(t: Substrate) -> DataFrame:
    return _definitions(t).impact_entities.select("version_ref", F.explode(impact.declared(F.col("body"))).alias("d")).select("version_ref", "d.relation", "d.ref")


_BEGIN, _END, _SCHEMA = "<<<node\n", "\nnode>>>\n", "node/v1"


def _framed(t: Substrate) -> DataFrame:
    """Turns as framed files, with a fault of each kind planted by number; those of turn 1 stand twice under one reference."""
    v, k = t.versions, F.regexp_extract("entity_id", "([0-9]+)$", 1).cast("long") * 10 + F.col("version")
    text = F.coalesce("text", F.lit(""))
    digest = F.when(k % 11 == 0, "sha256:0").otherwise(_text("sha256:", F.sha2(text, 256)))
    version = F.when((k % 7 == 0) & (F.col("version") > 0), 0).otherwise(F.col("version"))
    path = F.col("path")
    said = F.when(k % 13 == 0, "elsewhere").otherwise(path)
    status = F.when(k % 17 == 0, "gone").otherwise("valid")
    head = _text('{"content_hash":"', digest, '","current":true,"entity_id":"', F.col("entity_id"), '","git_commit":"c0","path":"', said, '","relations":{"depends_on":["', F.coalesce("previous", F.lit("none:x")), '"],"derived_from":[],"evidence":[],"sources":[]},"schema_version":"node/v1","status":"', status, '","version":"v', version, '"}')
    body = F.when(k % 19 == 0, text).otherwise(_text(_BEGIN, head, _END, text))
    return v.select("path", body.cast("binary").alias("content"))


@registered(
    "",
    """with v as (select conv_id, turn, conv_id * 10 + turn as k, 'conversations/' || conv_id || '/v' || turn as path, 'conv:' || conv_id || '@v' || case when (conv_id * 10 + turn) % 7 = 0 and turn > 0 then 0 else turn end as ref from conversations),
f as (select path, case when k % 13 = 0 then 'INVALID_FRONTMATTER' when k % 11 = 0 then 'HASH_MISMATCH' when k % 17 = 0 then 'INVALID_FRONTMATTER' end as fault, ref from v where k % 19 <> 0),
n as (select ref, count(*) as n from f where fault is null group by ref)
select path, coalesce(fault, case when n.n > 1 then 'AMBIGUOUS' end) as fault, case when fault is null then f.ref end as ref from f left join n on f.ref = n.ref and fault is null""",
)
def framed_nodes(t: Substrate) -> DataFrame:
    return framed.nodes(_framed(t), _BEGIN.encode(), _END.encode(), _SCHEMA).select("path", "fault", "ref")


@registered("", "select 'conv:' || conv_id || '@v' || turn as source_ref, 'depends_on' as relation, 'conv:' || conv_id || '@v' || (turn + 90) as target_ref from conversations where turn % 3 = 0")
def unverified_edges(t: Substrate) -> DataFrame:
    v = t.versions
    ahead = F.when(F.col("version") % 3 == 0, F.col("version") + 90).otherwise(0)
    edges = v.select(F.col("version_ref").alias("source_ref"), F.lit("depends_on").alias("relation"), _text(F.col("entity_id"), "@v", ahead).alias("target_ref"))
    logical = v.select(F.col("version_ref").alias("source_ref"), F.lit("cites").alias("relation"), F.lit("external:x").alias("target_ref"))
    nodes = v.select(F.concat(F.lit("definition:"), "version_ref").alias("ref"), "path").select(F.regexp_replace("ref", "^definition:", "").alias("ref"), "path")
    plain = lambda c: F.regexp_replace(c, ":", "-")  # noqa: E731  a reference with a colon is a logical one
    both = edges.unionByName(logical)
    out = framed.unverified(both.withColumns({"source_ref": plain("source_ref"), "target_ref": F.when(F.col("relation") == "cites", F.col("target_ref")).otherwise(plain("target_ref"))}), nodes.withColumn("ref", plain("ref")), t.live.select("path"))
    return out.withColumns({"source_ref": F.regexp_replace("source_ref", "-", ":"), "target_ref": F.regexp_replace("target_ref", "-", ":")})


@registered(
    "",
    """with e as (select conv_id as c, turn as n, conv_id || '@' || turn as ref from conversations)
select 'object_unique' as rule, ref as key from e where n = 3 union all select 'object_kind', ref from e where n % 7 = 2 union all select 'object_time', ref from e where n % 5 = 1 union all select 'object_time', ref from e where n = 3 and n % 5 = 1
union all select 'fact_subject', 'f' || ref from e where n % 4 = 3 union all select 'fact_time', 'f' || ref from e where n % 6 = 5 union all select 'relation_target', ref from e where n % 8 = 7
union all select 'atom_kind', 'a' || ref from e where n % 3 = 2 union all select 'external_digest', 'x' || r_regionkey from region where r_regionkey % 2 = 1""",
)
def manifest_breaches(t: Substrate) -> DataFrame:
    """A sealed manifest with planted breaches: each rule finds its own."""
    c = t.table("conversations")
    n, ref = F.col("turn"), _text(F.col("conv_id"), "@", F.col("turn"))
    when = lambda m, r, yes, no: F.when(n % m == r, yes).otherwise(no)
    time = F.lit("2024-01-01T00:00:00Z")
    objects = c.select(ref.alias("ref"), when(7, 2, F.lit(""), F.lit("run")).alias("kind"), F.lit("e").alias("entity_id"), F.lit(None).cast("string").alias("version_ref"), F.lit("p").alias("path"), F.lit("valid").alias("status"), when(5, 1, F.lit("2024-01-01"), time).alias("lifecycle_start"))
    objects = objects.unionByName(c.where("turn = 3").select(ref.alias("ref"), F.lit("run").alias("kind"), F.lit("e").alias("entity_id"), F.lit(None).cast("string").alias("version_ref"), F.lit("p").alias("path"), F.lit("valid").alias("status"), time.alias("lifecycle_start")))
    facts = c.select(_text("f", ref).alias("fact_id"), when(4, 3, F.lit("nobody"), ref).alias("subject"), F.lit("content").alias("predicate"), F.lit("v").alias("value"), when(6, 5, F.lit("soon"), time).alias("occurred_at"))
    relations = c.select(ref.alias("source_ref"), F.lit("uses").alias("relation"), when(8, 7, F.lit("nothing"), ref).alias("target_ref"))
    relations = relations.withColumn("target_ref", F.when(F.col("target_ref") == "nothing", F.concat(F.lit("!"), "source_ref")).otherwise(F.col("target_ref")))
    atoms = c.select(_text("a", ref).alias("atom_id"), ref.alias("artifact_ref"), when(3, 2, F.lit("song"), F.lit("command")).alias("kind"))
    queries = c.limit(0).select(ref.alias("query_id"), F.lit("x").alias("operation"), ref.alias("target_ref"), ref.alias("participant_locator"), ref.alias("as_of"))
    externals = t.table("region").select(_text("x", F.col("r_regionkey")).alias("ref"), F.when(F.col("r_regionkey") % 2 == 1, "md5:1").otherwise(_text("sha256:", F.sha2("r_name", 256))).alias("pinned_content_hash"))
    events = c.limit(0).select(ref.alias("event_id"))
    found = manifest.breaches(objects, facts, relations, atoms, queries, externals, events)
    return found.withColumn("key", F.regexp_replace("key", "^!", ""))


@registered(
    "",
    """with r as (select 'nation' as "table", '["' || n_nationkey || '"]' as key, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' as line from nation
  union all select 'supplier', '["' || s_suppkey || '"]', '{"s_acctbal":"' || printf('%.6f', s_acctbal) || '","s_name":"' || s_name || '","s_suppkey":' || s_suppkey || '}' from supplier)
select "table", count(*) as n, 'sha256:' || sha256(string_agg(line, chr(10) order by key) || chr(10)) as digest from r group by "table" """,
)
def logical_dump(t: Substrate) -> DataFrame:
    lines = hashing.table_lines(t.table("nation"), "nation", ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"])
    return hashing.dump_digest(lines.unionByName(hashing.table_lines(t.table("supplier"), "supplier", ["s_suppkey", "s_name", "s_acctbal"], ["s_suppkey"])))


# residue of an order's number, the rule that its rows break, and how the key of the row begins
_PLANTED = [
    (1, "object_kind", "o"), (2, "object_entity", "o"), (3, "object_status", "o"), (4, "object_time", "o"), (5, "object_unique", "o"), (6, "fact_subject", "f"), (7, "fact_time", "f"), (8, "fact_unique", "f"),
    (9, "fact_event", "g"), (10, "fact_external", "h"), (11, "fact_version", "i"), (12, "fact_lifecycle", "j"), (13, "relation_source", "?"), (14, "relation_target", "!"), (15, "atom_artifact", "a"), (16, "atom_kind", "a"),
    (17, "atom_unique", "a"), (18, "query_semantic_target", "q"), (19, "query_locator", "q"), (20, "query_time", "q"), (21, "query_unique", "q"), (22, "external_digest", "x"), (23, "external_unique", "x"),
]


@registered("", f"select rule, prefix || o_orderkey as key from orders join (values {', '.join(map(str, _PLANTED))}) as p(r, rule, prefix) on o_orderkey % 97 = r")
def manifest_every_rule(t: Substrate) -> DataFrame:
    """A sealed manifest over all orders in which each of its 23 rules is broken by some, next to values that look like breaches and are none: the same instant in another zone, every alias as a locator, queries without a time."""
    o = t.table("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 97).alias("r"))
    named = lambda prefix: _text(prefix, F.col("k"))
    time, none = F.lit("2024-01-01T00:00:00Z"), F.lit("none")

    def broken(r: int, no: Column, yes: Column) -> Column:
        return F.when(F.col("r") == r, no).otherwise(yes)

    def twice(df: DataFrame, r: int) -> DataFrame:
        return df.unionByName(df.where(F.col("r") == r))

    entity = broken(2, F.lit(""), named("E"))
    objects = twice(o.select("r", named("o").alias("ref"), broken(1, F.lit(""), F.lit("run")).alias("kind"), entity.alias("entity_id"), named("V").alias("version_ref"), named("p/").alias("path"), broken(3, F.lit(""), F.lit("valid")).alias("status"), broken(4, F.lit("2024-01-01"), time).alias("lifecycle_start")), 5)
    fact = lambda prefix, predicate, value, subject=named("o"), at=time: o.select("r", named(prefix).alias("fact_id"), subject.alias("subject"), F.lit(predicate).alias("predicate"), value.alias("value"), at.alias("occurred_at"))
    facts = twice(fact("f", "content", F.lit("v"), broken(6, none, named("o")), broken(7, F.lit("soon"), time)), 8)
    facts = facts.unionByName(fact("g", "introduced_event", broken(9, none, named("ev")))).unionByName(fact("h", "authority_source", broken(10, none, named("x")))).unionByName(fact("i", "bound_version", broken(11, none, named("V"))))
    facts = facts.unionByName(fact("j", "lifecycle_start", broken(12, F.lit("2025-01-01T00:00:00Z"), F.lit("2024-01-01T01:00:00+01:00"))).where("r <> 4"))
    relations = o.select(broken(13, named("?"), named("o")).alias("source_ref"), F.lit("uses").alias("relation"), broken(14, named("!"), named("o")).alias("target_ref"))
    atoms = twice(o.select("r", named("a").alias("atom_id"), broken(15, none, named("o")).alias("artifact_ref"), broken(16, F.lit("song"), F.when(F.col("k") % 2 == 0, "command").otherwise("metric_cell")).alias("kind")), 17)
    alias = F.when(F.col("k") % 4 == 0, named("o")).when(F.col("k") % 4 == 1, entity).when(F.col("k") % 4 == 2, named("V")).otherwise(named("p/"))
    asked = broken(20, F.lit("yesterday"), F.when(F.col("k") % 3 != 0, time))
    queries = twice(o.select("r", named("q").alias("query_id"), broken(18, F.lit("query_text_semantic"), F.lit("query_state")).alias("operation"), named("o").alias("target_ref"), broken(19, none, alias).alias("participant_locator"), asked.alias("as_of")), 21)
    externals = twice(o.select("r", named("x").alias("ref"), broken(22, F.lit("md5:1"), _text("sha256:", F.sha2(named("x"), 256))).alias("pinned_content_hash")), 23)
    return manifest.breaches(objects, facts, relations, atoms, queries, externals, o.select(named("ev").alias("event_id")))


# ---- places in orders


@registered("relations", " select source_ref, relation, target_ref, row_number() over (order by source_ref, relation, target_ref) as place from relations")
def edge_order(t: Substrate) -> DataFrame:
    return orders.placed(t.relations.select("source_ref", "relation", "target_ref"), orders.EDGES())


@registered("", "select 'e' || user_id as entity_id, case when event_id % 4 > 0 then event_type || event_id end as version_ref, event_id, row_number() over (order by 'e' || user_id, case when event_id % 4 > 0 then event_type || event_id else '' end, event_id) as place from events")
def impact_order(t: Substrate) -> DataFrame:
    """Events as affected versions of users; every fourth has no version, and those stand first, in the order of their numbers."""
    e = t.table("events").select(_text("e", F.col("user_id")).alias("entity_id"), F.when(F.col("event_id") % 4 > 0, _text(F.col("event_type"), F.col("event_id"))).alias("version_ref"), "event_id")
    return orders.placed(e, [*orders.IMPACT(), F.col("event_id")])


@registered(
    "",
    """with r as (select (l_quantity::bigint % 5) as score_q, 'e' || (l_suppkey % 7) as entity_id, case when l_linenumber > 2 then 'v' || l_linenumber end as versioned_ref, 'p' || l_orderkey || '.' || l_linenumber as path from lineitem)
select *, row_number() over (order by score_q desc, entity_id, coalesce(versioned_ref, ''), path) as place from r""",
)
def semantic_order(t: Substrate) -> DataFrame:
    """Lines as ranked rows that tie by score, by entity and by version."""
    n = F.col("l_linenumber")
    rows = t.table("lineitem").select((F.col("l_quantity").cast("long") % 5).alias("score_q"), _text("e", F.col("l_suppkey") % 7).alias("entity_id"), F.when(n > 2, _text("v", n)).alias("versioned_ref"), _text("p", F.col("l_orderkey"), ".", n).alias("path"))
    return orders.placed(rows, orders.SEMANTIC())
