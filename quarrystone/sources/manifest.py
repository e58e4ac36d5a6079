"""Integrity rules of a sealed manifest's tables: every breach as a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import RFC3339

DIGEST = "^sha256:[0-9a-f]{64}$"
#: Rows of a table that a task holds against another's, about.
ROWS = 1 << 19


def _breach(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def breaches(objects: DataFrame, facts: DataFrame, relations: DataFrame, atoms: DataFrame, queries: DataFrame, externals: DataFrame, events: DataFrame) -> DataFrame:
    """(rule, key): unique ids, ends and subjects that exist, timestamps with a zone, values that name what they should, closed kinds."""
    # keys in a row take few bytes when compressed, by which Spark would put ten million of them in a task; so tasks are numbered by rows
    parts = max(df.count() for df in (objects, facts, relations, atoms, queries, externals, events)) // ROWS + 1
    dealt = lambda df, key: df.repartition(parts, key)
    known = dealt(objects.select(F.col("ref").alias("known")), "known").distinct()
    twice = lambda df, key, rule: _breach(dealt(df.select(key), key).groupBy(key).count().where("count > 1"), rule, key)
    unknown = lambda df, column, key, rule: _breach(dealt(df.select(F.col(column).alias("_asked"), F.col(key)), "_asked").join(known, F.col("_asked") == F.col("known"), "left_anti"), rule, key)
    time = lambda df, column, key, rule: _breach(df.where(~F.coalesce(F.col(column).rlike(RFC3339), F.lit(False))), rule, key)
    empty = lambda df, column, key, rule: _breach(df.where(F.coalesce(F.col(column), F.lit("")) == ""), rule, key)
    names = lambda df, predicate, among, column, rule: _breach(
        dealt(df.where(F.col("predicate") == predicate).select("fact_id", "value"), "value").join(dealt(among.select(F.col(column).alias("_v")), "_v").distinct(), F.col("value") == F.col("_v"), "left_anti"), rule, "fact_id"
    )
    start = dealt(objects.select(F.col("ref").alias("_r"), F.col("lifecycle_start").alias("_s")), "_r")
    conflict = dealt(facts.where("predicate = 'lifecycle_start'").select("fact_id", "subject", "value"), "subject").join(start, F.col("subject") == F.col("_r")).where(F.try_to_timestamp("value") != F.try_to_timestamp("_s"))
    target = dealt(objects.select(F.col("ref").alias("_r"), F.array("ref", "entity_id", "version_ref", "path").alias("aliases")), "_r")
    located = dealt(queries.where("participant_locator is not null").select("query_id", "target_ref", "participant_locator"), "target_ref").join(target, F.col("target_ref") == F.col("_r")).where(~F.coalesce(F.array_contains("aliases", F.col("participant_locator")), F.lit(False)))
    rules = [
        twice(objects, "ref", "object_unique"), twice(facts, "fact_id", "fact_unique"), twice(atoms, "atom_id", "atom_unique"), twice(queries, "query_id", "query_unique"), twice(externals, "ref", "external_unique"),
        empty(objects, "kind", "ref", "object_kind"), empty(objects, "entity_id", "ref", "object_entity"), empty(objects, "status", "ref", "object_status"),
        unknown(facts, "subject", "fact_id", "fact_subject"), unknown(relations, "source_ref", "source_ref", "relation_source"), unknown(relations, "target_ref", "target_ref", "relation_target"), unknown(atoms, "artifact_ref", "atom_id", "atom_artifact"),
        time(objects, "lifecycle_start", "ref", "object_time"), time(facts, "occurred_at", "fact_id", "fact_time"), time(queries.where("as_of is not null"), "as_of", "query_id", "query_time"),
        names(facts, "introduced_event", events, "event_id", "fact_event"), names(facts, "authority_source", externals, "ref", "fact_external"), names(facts, "bound_version", objects, "version_ref", "fact_version"),
        _breach(conflict, "fact_lifecycle", "fact_id"), _breach(atoms.where(~F.col("kind").isin("metric_cell", "command")), "atom_kind", "atom_id"),
        _breach(queries.where("operation = 'query_text_semantic' and target_ref is not null"), "query_semantic_target", "query_id"), _breach(located, "query_locator", "query_id"),
        _breach(externals.where(~F.col("pinned_content_hash").rlike(DIGEST)), "external_digest", "ref"),
    ]
    return reduce(DataFrame.unionByName, rules)
