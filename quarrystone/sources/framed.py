"""Files that carry their node between two markers, and ledgers of JSON rows: read into nodes and edges, with every fault as a row."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a frame holds, its relations, and its states (fixed values).
KEYS = frozenset(("content_hash", "current", "entity_id", "git_commit", "path", "relations", "schema_version", "status", "version"))
RELATIONS = frozenset(("depends_on", "derived_from", "evidence", "sources"))
STATES = ("valid", "invalid", "stale", "deprecated")

_NODE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("fault", "ref", "entity_id", "version_ref", "path", "content_hash", "git_commit", "status")]
    + [T.StructField("current", T.BooleanType()), T.StructField("relations", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]
)


def node(path: str, data: bytes, begin: bytes, end: bytes, schema: str) -> dict:
    """The node of a framed file, or its first fault."""
    stop = data.find(end)
    try:
        head = json.loads(data[len(begin) : stop].decode()) if stop >= 0 else None
    except ValueError:
        head = None
    if not isinstance(head, dict) or head.keys() != KEYS or head["schema_version"] != schema or head["path"] != path:
        return {"fault": "INVALID_FRONTMATTER", "path": path}
    if head["content_hash"] != "sha256:" + hashlib.sha256(data[stop + len(end) :]).hexdigest():
        return {"fault": "HASH_MISMATCH", "path": path}
    if not isinstance(head["relations"], dict) or head["relations"].keys() != RELATIONS or head["status"] not in STATES:
        return {"fault": "INVALID_FRONTMATTER", "path": path}
    ref = f"{head['entity_id']}@{head['version']}" if head["version"] and "@" not in head["version"] else head["version"] or head["entity_id"]
    return {k: head[k] for k in ("entity_id", "content_hash", "git_commit", "status", "relations")} | {"path": path, "ref": ref, "version_ref": head["version"] or None, "current": bool(head["current"])}


def nodes(files: DataFrame, begin: bytes, end: bytes, schema: str) -> DataFrame:
    """Nodes of the framed files of a scan; a ref that stands twice is AMBIGUOUS in each row of it."""

    @F.pandas_udf(_NODE)
    def read(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(_NODE.names)
        rows = [empty | node(p, bytes(c), begin, end, schema) for p, c in zip(path, content, strict=True)]
        return pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in empty})

    framed = files.where(F.substring("content", 1, len(begin)) == F.lit(begin))
    out = framed.select(read("path", "content").alias("n")).select("n.*")
    twice = out.where("ref is not null").groupBy(F.col("ref").alias("t")).count().where("count > 1").select("t")
    return out.join(twice, out["ref"] == twice["t"], "left").withColumn("fault", F.coalesce("fault", F.when(F.col("t").isNotNull(), "AMBIGUOUS"))).drop("t")


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON array file."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def unverified(edges: DataFrame, nodes_: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of which an end is no node, no file, and no logical reference of a kind other than definition."""
    known = nodes_.select(F.col("ref").alias("k")).unionByName(nodes_.select(F.concat(F.lit("definition:"), "ref").alias("k"))).unionByName(files.select(F.col("path").alias("k"))).distinct()
    ends = edges.select("source_ref", "relation", "target_ref", F.explode(F.array("source_ref", "target_ref")).alias("end"))
    logical = F.contains("end", F.lit(":")) & ~F.col("end").startswith("definition:")
    return ends.where(~logical).join(known, F.col("end") == F.col("k"), "left_anti").select("source_ref", "relation", "target_ref").distinct()
