"""The engine's domain tables as projections of relational test tables, in DataFrames and, for comparison, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Substrate:
    """Domain tables over a folder of Parquet tables. Every frame is lazy and prunes to the columns used."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @staticmethod
    def digest(*columns: Column) -> Column:
        return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256))

    def _kind(self, name: str, kind: str, key: str, *content: str, status: Column | None = None, start: Column | None = None) -> DataFrame:
        c = F.col
        ref = F.concat(F.lit(f"{kind}:"), c(key).cast("string"))
        return self.table(name).select(
            ref.alias("ref"),
            F.lit(kind).alias("kind"),
            ref.alias("entity_id"),
            F.concat(F.lit(f"{kind}/"), c(key).cast("string")).alias("path"),
            (F.lit("valid") if status is None else status).alias("status"),
            self.digest(*[c(x) for x in (key, *content)]).alias("content_hash"),
            (F.lit("1992-01-01") if start is None else start).alias("lifecycle_start"),
        )

    @property
    def objects(self) -> DataFrame:
        """ref, kind, entity_id, path, status, content_hash, lifecycle_start (a date as text)."""
        state = F.when(F.col("o_orderstatus") == "F", "frozen").when(F.col("o_orderstatus") == "O", "fresh").otherwise("completed")
        parts = [
            self._kind("region", "region", "r_regionkey", "r_name"),
            self._kind("nation", "nation", "n_nationkey", "n_name"),
            self._kind("customer", "customer", "c_custkey", "c_name", "c_mktsegment"),
            self._kind("supplier", "supplier", "s_suppkey", "s_name"),
            self._kind("part", "part", "p_partkey", "p_name", "p_brand"),
            self._kind("orders", "order", "o_orderkey", "o_custkey", "o_orderpriority", status=state, start=F.date_format("o_orderdate", "yyyy-MM-dd")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @property
    def relations(self) -> DataFrame:
        """source_ref, relation, target_ref: the source depends on the target."""

        def edge(name: str, source: tuple[str, str], relation: str, target: tuple[str, str], repeated: bool = False) -> DataFrame:
            ref = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
            keys = self.table(name).select(source[1], target[1])
            return (keys.distinct() if repeated else keys).select(ref(*source).alias("source_ref"), F.lit(relation).alias("relation"), ref(*target).alias("target_ref"))

        return (
            edge("nation", ("nation", "n_nationkey"), "based_on", ("region", "n_regionkey"))
            .unionByName(edge("customer", ("customer", "c_custkey"), "based_on", ("nation", "c_nationkey")))
            .unionByName(edge("supplier", ("supplier", "s_suppkey"), "based_on", ("nation", "s_nationkey")))
            .unionByName(edge("orders", ("order", "o_orderkey"), "derived_from", ("customer", "o_custkey")))
            .unionByName(edge("lineitem", ("order", "l_orderkey"), "uses", ("part", "l_partkey"), True))
            .unionByName(edge("lineitem", ("order", "l_orderkey"), "cites", ("supplier", "l_suppkey"), True))
        )

    @property
    def facts(self) -> DataFrame:
        """fact_id, subject, predicate, value, occurred_at."""
        return self.table("events").select(
            F.col("event_id").alias("fact_id"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject"),
            F.col("event_type").alias("predicate"), F.col("value"), F.col("ts").alias("occurred_at"),
        )

    @property
    def versions(self) -> DataFrame:
        """entity_id, version, version_ref, previous, path, current, role, text: one row a turn. Entities by 13 have two current versions, those by 17 none."""
        t = self.table("conversations")
        last = t.groupBy("conv_id").agg(F.max("turn").alias("last"))
        entity = F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))
        ref = lambda n: F.concat(entity, F.lit("@v"), n.cast("string"))
        doubled = (F.col("conv_id") % 13 == 0) & (F.col("turn") >= F.col("last") - 1)
        return t.join(last, "conv_id").select(
            entity.alias("entity_id"), F.col("turn").alias("version"), ref(F.col("turn")).alias("version_ref"),
            F.when(F.col("turn") > 0, ref(F.col("turn") - 1)).alias("previous"),
            F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit("/v"), F.col("turn").cast("string")).alias("path"),
            ((F.col("conv_id") % 17 != 0) & ((F.col("turn") == F.col("last")) | doubled)).alias("current"), "role", "text",
        )

    @property
    def documents(self) -> DataFrame:
        """id, doc_type, path, version, content_hash, status, text, frozen_at."""
        t, labels = self.table("documents"), self.table("labels").select(F.col("doc_id").alias("labelled"), "quality", "toxic")
        status = F.when(F.col("toxic") == 1, "invalid").when(F.col("quality") == 1, "fresh").when(F.col("quality") == 0, "stale").otherwise("completed")
        return t.join(labels, F.col("doc_id") == F.col("labelled"), "left").select(
            F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("doc_type"),
            F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 3 + 1).cast("string").alias("version"),
            F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"), status.alias("status"), "text",
            F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd").alias("frozen_at"), "doc_id", "n_chars",
        )

    @property
    def source_refs(self) -> DataFrame:
        """owner, ref_path, reference_scope, content_hash (as recorded), git_commit: a labelled document cites itself, with planted faults."""
        d = self.table("labels").select(F.col("doc_id").alias("l")).join(self.documents, F.col("l") == F.col("doc_id"))
        k = F.col("doc_id")
        recorded = F.when(k % 7 == 0, F.lit("sha256:0")).when(k % 19 == 0, F.lit("")).otherwise(F.col("content_hash"))
        return d.select(
            F.concat(F.lit("label:"), k.cast("string")).alias("owner"), F.when(k % 11 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("ref_path"),
            F.when(k % 3 == 0, "historical").otherwise("current").alias("reference_scope"), recorded.alias("content_hash"), F.when((k % 3 == 0) & (k % 2 == 0), "c0").alias("git_commit"),
        )

    @property
    def live(self) -> DataFrame:
        """path, content_hash: files as they are. Those by 5 have changed since the snapshot, those by 23 are gone."""
        changed = F.when(F.col("doc_id") % 5 == 0, F.lit("sha256:1")).otherwise(F.col("content_hash"))
        return self.documents.where(F.col("doc_id") % 23 != 0).select("path", changed.alias("content_hash"))

    @property
    def snapshots(self) -> DataFrame:
        """git_commit, path, content_hash: files as committed."""
        return self.documents.select(F.lit("c0").alias("git_commit"), "path", "content_hash")


#: The same tables as SQL common table expressions.
SQL = {
    "objects": """objects as (
  select 'region:' || r_regionkey as ref, 'region' as kind, 'region/' || r_regionkey as path, 'valid' as status, 'sha256:' || sha256(r_regionkey || '|' || r_name) as content_hash, '1992-01-01' as lifecycle_start from region
  union all select 'nation:' || n_nationkey, 'nation', 'nation/' || n_nationkey, 'valid', 'sha256:' || sha256(n_nationkey || '|' || n_name), '1992-01-01' from nation
  union all select 'customer:' || c_custkey, 'customer', 'customer/' || c_custkey, 'valid', 'sha256:' || sha256(c_custkey || '|' || c_name || '|' || c_mktsegment), '1992-01-01' from customer
  union all select 'supplier:' || s_suppkey, 'supplier', 'supplier/' || s_suppkey, 'valid', 'sha256:' || sha256(s_suppkey || '|' || s_name), '1992-01-01' from supplier
  union all select 'part:' || p_partkey, 'part', 'part/' || p_partkey, 'valid', 'sha256:' || sha256(p_partkey || '|' || p_name || '|' || p_brand), '1992-01-01' from part
  union all select 'order:' || o_orderkey, 'order', 'order/' || o_orderkey, case o_orderstatus when 'F' then 'frozen' when 'O' then 'fresh' else 'completed' end,
    'sha256:' || sha256(o_orderkey || '|' || o_custkey || '|' || o_orderpriority), strftime(o_orderdate, '%Y-%m-%d') from orders)""",
    "relations": """relations as (
  select 'nation:' || n_nationkey as source_ref, 'based_on' as relation, 'region:' || n_regionkey as target_ref from nation
  union all select 'customer:' || c_custkey, 'based_on', 'nation:' || c_nationkey from customer
  union all select 'supplier:' || s_suppkey, 'based_on', 'nation:' || s_nationkey from supplier
  union all select 'order:' || o_orderkey, 'derived_from', 'customer:' || o_custkey from orders
  union all select distinct 'order:' || l_orderkey, 'uses', 'part:' || l_partkey from lineitem
  union all select distinct 'order:' || l_orderkey, 'cites', 'supplier:' || l_suppkey from lineitem)""",
    "facts": "facts as (select event_id as fact_id, 'user:' || user_id as subject, event_type as predicate, value, ts as occurred_at from events)",
    "versions": """versions as (
  select 'conv:' || conv_id as entity_id, turn as version, 'conv:' || conv_id || '@v' || turn as version_ref, case when turn > 0 then 'conv:' || conv_id || '@v' || (turn - 1) end as previous,
    'conversations/' || conv_id || '/v' || turn as path, conv_id % 17 <> 0 and (turn = last or (conv_id % 13 = 0 and turn >= last - 1)) as current, role, text
  from (select *, max(turn) over (partition by conv_id) as last from conversations))""",
    "docs": """docs as (
  select 'doc:' || d.doc_id as id, source as doc_type, 'documents/' || d.doc_id as path, (d.doc_id % 3 + 1)::varchar as version, 'sha256:' || sha256(text) as content_hash,
    case when toxic = 1 then 'invalid' when quality = 1 then 'fresh' when quality = 0 then 'stale' else 'completed' end as status, text,
    strftime(date '2024-01-01' + (d.doc_id % 365)::int, '%Y-%m-%d') as frozen_at, d.doc_id, n_chars
  from documents d left join labels l on d.doc_id = l.doc_id)""",
    "source_refs": """source_refs as (
  select 'label:' || doc_id as owner, case when doc_id % 11 = 0 then path || '.gone' else path end as ref_path, case when doc_id % 3 = 0 then 'historical' else 'current' end as reference_scope,
    case when doc_id % 7 = 0 then 'sha256:0' when doc_id % 19 = 0 then '' else content_hash end as content_hash, case when doc_id % 6 = 0 then 'c0' end as git_commit
  from docs where doc_id in (select doc_id from labels))""",
    "live": "live as (select path, case when doc_id % 5 = 0 then 'sha256:1' else content_hash end as content_hash from docs where doc_id % 23 <> 0)",
    "snapshots": "snapshots as (select 'c0' as git_commit, path, content_hash from docs)",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """A statement over domain tables (names, by space; in an order that each may use those before it)."""
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(SQL[n] for n in names.split()) + body
