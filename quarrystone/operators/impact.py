"""What a changed definition affects: declared dependents, their class and the reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept
from .graph import closure

# Change types in canonical order with the reason each gives (fixed values).
REASONS = {
    "scope_change": "upstream_scope_changed",
    "population_change": "upstream_definition_changed",
    "measurement_change": "upstream_definition_changed",
    "outcome_change": "upstream_definition_changed",
    "threshold_change": "upstream_definition_changed",
    "method_change": "upstream_method_changed",
    "assumption_change": "upstream_assumption_changed",
    "other_semantic": "other_upstream_change",
}
RELATIONS = ("based_on", "uses", "references", "caused_by")
CONTAINERS = ("dependencies", "relations", "provenance")
#: Reason of a result that was executed but not committed; it stands in place of all others.
OVERRIDE = "active_result_bundle"


def declared(body: Column | str) -> Column:
    """(relation, ref) of the version references that a JSON document declares under the dependency keys, at its top or in a container: at least three characters, with an @.

    A value is a text, a document with a text under ref, or a list of these. What isn't JSON, a null, or a document that names a key twice declares nothing.
    """
    is_text = lambda v: F.schema_of_variant(v) == "STRING"

    def text(v: Column) -> Column:
        ref = F.try_variant_get(v, "$.ref", "variant")
        said = F.when(is_text(v), F.try_variant_get(v, "$", "string")).when(is_text(ref), F.try_variant_get(ref, "$", "string"))
        return F.when(F.contains(said, F.lit("@")) & (F.length(said) >= 3), said)

    def found(doc: Column, place: str, relation: str) -> Column:
        v = F.try_variant_get(doc, f"{place}.{relation}", "variant")
        many = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
        refs = F.filter(F.transform(many, text), lambda r: r.isNotNull())
        return F.transform(refs, lambda r: F.struct(F.lit(relation).alias("relation"), r.alias("ref")))

    every = lambda doc: F.concat(*[found(doc, p, k) for p in ("$", *(f"$.{c}" for c in CONTAINERS)) for k in RELATIONS])
    return F.flatten(F.transform(F.array(F.try_parse_json(body)), every))  # a lambda's variable is one value, so a document is parsed once


def affected(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, ref, relations): dependents at any distance over declared relations, each with every relation by which it depends on something reached."""
    e = edges.where(F.col("relation").isin(*RELATIONS))
    reached = closure(e, roots, "target_ref", "source_ref")
    via = e.join(reached.select("root", F.col("ref").alias("target_ref")), "target_ref")
    return via.groupBy("root", F.col("source_ref").alias("ref")).agg(F.sort_array(F.collect_set("relation")).alias("relations"))


def classify(rows: DataFrame) -> DataFrame:
    """rows (entity_type, lifecycle, committed) with impact; those not affected drop out. Stale is never raised to invalid."""
    done = F.coalesce(F.col("committed"), F.lit(False))
    t, life = F.col("entity_type"), F.coalesce(F.col("lifecycle"), F.lit(""))
    impact = (
        F.when(t == "Run", F.when((life == "committed") | done, "superseded"))
        .when(t == "TaskSlice", F.when(life != "executed", "stale"))
        .when(t == "ResultBundle", F.when((life == "executed") & ~done, "needs_review"))
        .otherwise("stale")
    )
    return rows.withColumn("impact", impact).where("impact is not null")


def reasons(classified: DataFrame, change_types: list[str]) -> DataFrame:
    """classified (relations) with reasons: (reason_code, via_relation), each once, in the canonical order of the change types; unknown types count as other."""
    canon = sorted(set(change_types), key=lambda c: (list(REASONS).index(c) if c in REASONS else len(REASONS), c)) or ["other_semantic"]
    codes = list(dict.fromkeys(REASONS.get(c, "other_upstream_change") for c in canon))
    own = F.when(F.col("impact") == "needs_review", F.array(F.lit(OVERRIDE))).otherwise(F.array(*[F.lit(c) for c in codes]))
    pair = F.transform(F.col("relations"), lambda r: F.transform(own, lambda c: F.struct(c.alias("reason_code"), r.alias("via_relation"))))
    return classified.withColumn("reasons", F.array_distinct(F.flatten(pair)))


def fields(bodies: DataFrame, by: list[str], body: str) -> DataFrame:
    """by, path and value (a VARIANT) of each field of JSON documents; lists, empty documents and nulls are leaves. Level by level, so rounds are as many as the deepest document's levels.

    What isn't a JSON document, or names a key twice, has no fields. A key with a dot in it gives the path of a nested one, and both are given.
    """
    level = bodies.select(*by, F.lit(None).cast("string").alias("path"), F.try_parse_json(body).alias("value"))
    leaves = []
    while True:
        inner = level.select(*by, F.col("path").alias("above"), F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("key", "value"))
        kind = F.schema_of_variant("value")
        inner = kept(inner.select(*by, F.concat_ws(".", "above", "key").alias("path"), "value", (F.startswith(kind, F.lit("OBJECT<")) & (kind != "OBJECT<>")).alias("deeper")))
        leaves.append(inner.where("not deeper").drop("deeper"))
        level = inner.where("deeper").drop("deeper")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, leaves)


def structural_diff(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """pairs with changed: sorted paths that only one of two bodies has, or that differ. Numbers are compared by value, documents within lists whatever the order of their keys."""
    rows = kept(pairs.withColumn("_row", F.monotonically_increasing_id()))  # written, so that rows keep their numbers
    both = rows.select("_row", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(before).alias("body")), F.struct(F.lit(1).alias("side"), F.col(after).alias("body")))).alias("b")).select("_row", "b.*")
    found = fields(both, ["_row", "side"], "body").withColumn("digest", F.sha2(F.to_json("value"), 256))
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("digest"))))
    differ = found.groupBy("_row", "path").agg(of(0).alias("a"), of(1).alias("b")).where("a <> b")
    changed = differ.groupBy("_row").agg(F.array_sort(F.collect_list("path")).alias("changed"))
    out = rows.join(changed, "_row", "left")
    return out.withColumn("changed", F.coalesce("changed", F.array().cast("array<string>"))).drop("_row")


def merge(definitions: DataFrame, physical: DataFrame) -> DataFrame:
    """Affected rows of definitions, then of files, each entity once, definitions first."""
    both = definitions.withColumn("_p", F.lit(0)).unionByName(physical.withColumn("_p", F.lit(1)))
    others = [c for c in definitions.columns if c != "entity_id"]
    best = both.groupBy("entity_id").agg(F.min_by(F.struct(*others), F.struct("_p", *others)).alias("b"))
    return best.select("entity_id", "b.*")
