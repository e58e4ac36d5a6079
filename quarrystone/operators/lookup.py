"""Exact lookups, filters and resolutions. Ids, paths and references match whole, never by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def versioned(entity: Column, version: Column) -> Column:
    return F.when(version.isNotNull(), F.concat(entity, F.lit("@v"), version.cast("string")))


def entity(objects: DataFrame, locator: str, key: str = "ref") -> DataFrame:
    """Rows whose id or path is the locator; none is NOT_FOUND to the caller."""
    return objects.where((F.col(key) == locator) | (F.col("path") == locator))


def select(objects: DataFrame, entity_: str | None = None, doc_type: str | None = None, status: str | None = None, raw: bool = False, text: str | None = None) -> DataFrame:
    """The first criterion given decides, alone: entity, type, status, raw, text, else all."""
    if entity_ is not None:
        return entity(objects, entity_, "id")
    if doc_type is not None:
        return objects.where(F.col("doc_type") == doc_type)
    if status is not None:
        return objects.where(F.col("status") == status)
    if raw:
        return objects.where(F.col("doc_type") == "raw")
    if text is not None:
        return lexical(objects, text)
    return objects


def lexical(documents: DataFrame, text: str) -> DataFrame:
    """Documents that hold a text, without regard to case, in id, path or content; matched_in names the first that does."""
    held = lambda c: F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    where = F.when(held("id"), "id").when(held("path"), "path").when(held("text"), "content")
    return documents.withColumn("matched_in", where).where(F.col("matched_in").isNotNull())


def resolve(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """request, resolved, condition. A request is entity@version, the same after "definition:", a path, or an entity, in that order.

    One with an @ that names no version is NOT_FOUND and never falls back to the latest; a bare entity
    needs just one current version, else it is AMBIGUOUS_VERSION or NOT_FOUND.
    """
    exact = versions.select(F.col("version_ref").alias("k"), F.col("version_ref").alias("by_ref"))
    paths = versions.select(F.col("path").alias("k"), F.col("version_ref").alias("by_path"))
    now = current(versions).select(F.col("entity_id").alias("k"), F.col("version_ref").alias("by_entity"), F.col("condition").alias("of_entity"))
    bare = F.regexp_replace("request", "^definition:", "")
    out = requests.withColumn("bare", bare)
    out = out.join(exact, out.bare == exact.k, "left").drop("k").join(paths, out.request == paths.k, "left").drop("k").join(now, out.bare == now.k, "left").drop("k")
    found = F.coalesce("by_ref", "by_path", F.when(~F.contains("bare", F.lit("@")), F.col("by_entity")))
    missing = F.when(~F.contains("bare", F.lit("@")), F.coalesce("of_entity", F.lit("NOT_FOUND"))).otherwise("NOT_FOUND")
    return out.select("request", found.alias("resolved"), F.when(found.isNull(), missing).alias("condition"))


def current(versions: DataFrame) -> DataFrame:
    """entity_id, version_ref of its one current version, condition where there are none or several."""
    n = F.count_if("current")
    return versions.groupBy("entity_id").agg(
        F.when(n == 1, F.max(F.when(F.col("current"), F.col("version_ref")))).alias("version_ref"), F.when(n == 0, "NOT_FOUND").when(n > 1, "AMBIGUOUS_VERSION").alias("condition")
    )


def unique_object(objects: DataFrame, locator: str) -> DataFrame:
    """The object with that ref, else the only one with that entity_id or path; several are none."""
    keyed = objects.where((F.col("ref") == locator) | (F.col("entity_id") == locator) | (F.col("path") == locator))
    best = keyed.withColumn("first", F.when(F.col("ref") == locator, 0).otherwise(1))
    least = best.agg(F.min("first").alias("f"), F.count("*").alias("n"))
    return best.join(F.broadcast(least), (best["first"] == 0) | ((F.col("f") == 1) & (F.col("n") == 1))).drop("f", "n", "first")  # least is one row


def facts(table: DataFrame, subject: str | None = None, predicates: list[str] | None = None, as_of=None) -> DataFrame:
    """Facts of a subject, of the predicates (none: all), up to a time."""
    if subject is not None:
        table = table.where(F.col("subject") == subject)
    if predicates:
        table = table.where(F.col("predicate").isin(predicates))
    return table if as_of is None else table.where(F.col("occurred_at") <= F.lit(as_of).cast("timestamp_ntz"))


def overlay(rows: DataFrame, stale: DataFrame, missing: DataFrame, key: str = "ref") -> DataFrame:
    """rows with is_stale and is_available from the sets of stale and missing references."""
    flag = lambda df, name: df.select(F.col(key).alias(f"_{name}")).distinct()
    s, m = flag(stale, "s"), flag(missing, "m")
    out = rows.join(s, rows[key] == s["_s"], "left").join(m, rows[key] == m["_m"], "left")
    return out.withColumns({"is_stale": F.col("_s").isNotNull(), "is_available": F.col("_m").isNull()}).drop("_s", "_m")


def pins(table: DataFrame, sources: DataFrame) -> DataFrame:
    """Each external source's value as pinned, with the fact that pins it; never the latest value."""
    return table.join(sources, table["subject"] == sources["ref"]).select("subject", "fact_id", "pinned_hash", "latest_hash", (F.col("pinned_hash") != F.col("latest_hash")).alias("moved"))


def match_rows(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """rows (row_id, entity_id, path, content_hash) with the one object they mean: by entity, else by path, candidates narrowed by hash where given; several are none."""
    o = objects.select(F.col("ref").alias("o_ref"), F.col("entity_id").alias("o_entity"), F.col("path").alias("o_path"), F.col("content_hash").alias("o_hash"))
    fits = F.coalesce(rows["content_hash"], F.col("o_hash")) == F.col("o_hash")
    by = lambda a, b, rank: rows.join(o, (rows[a] == o[b]) & fits).select("row_id", "o_ref", F.lit(rank).alias("rank"))
    hits = by("entity_id", "o_entity", 0).unionByName(by("path", "o_path", 1))
    one = hits.groupBy("row_id", "rank").agg(F.count_distinct("o_ref").alias("n"), F.min("o_ref").alias("ref")).groupBy("row_id").agg(F.min(F.struct("rank", "n", "ref")).alias("b"))
    return rows.join(one, "row_id", "left").select("row_id", F.when(F.col("b.n") == 1, F.col("b.ref")).alias("ref"), F.when(F.col("b").isNull(), "NOT_FOUND").when(F.col("b.n") > 1, "AMBIGUOUS_VERSION").alias("condition"))


def with_documents(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Entities (id, entity_type, path) with the hash and commit of their document, if they have one."""
    d = documents.groupBy(F.col("id").alias("_d")).agg(F.min(F.struct("content_hash", "git_commit")).alias("doc"))
    return entities.join(d, entities["id"] == d["_d"], "left").select("id", "entity_type", "path", F.col("doc.content_hash").alias("content_hash"), F.col("doc.git_commit").alias("git_commit"))


def named_paths(paths: DataFrame, entities: DataFrame, path: str = "path") -> DataFrame:
    """paths with name: the id of the entity that has the path, else the path itself."""
    ids = entities.where("path is not null").groupBy(F.col("path").alias("_p")).agg(F.max("id").alias("_id"))
    return paths.join(ids, paths[path] == ids["_p"], "left").withColumn("name", F.coalesce("_id", F.col(path))).drop("_p", "_id")


def citing(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """refs whose path is one of paths, whatever slashes end either; paths match whole, never by pattern."""
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    p = paths.select(bare(F.col("path")).alias("_p")).distinct()
    return refs.join(p, bare(refs["ref_path"]) == p["_p"], "left_semi")


def unique(locators: DataFrame, objects: DataFrame) -> DataFrame:
    """(locator, ref): the object with that ref, else the only one with that entity_id, version_ref or path; several or none are null. Any number of locators in one join for each name."""
    o = objects.select("ref", "entity_id", "version_ref", "path")
    by = lambda column, rank: locators.join(o.select(F.col(column).alias("k"), F.col("ref").alias("found")), F.col("locator") == F.col("k")).select("locator", "found", F.lit(rank).alias("rank"))
    hits = by("ref", 0)
    for column in ("entity_id", "version_ref", "path"):
        hits = hits.unionByName(by(column, 1))
    best = hits.groupBy("locator").agg(F.min(F.when(F.col("rank") == 0, F.col("found"))).alias("own"), F.count_distinct("found").alias("n"), F.min("found").alias("any"))
    return locators.join(best, "locator", "left").select("locator", F.coalesce("own", F.when(F.col("n") == 1, F.col("any"))).alias("ref"))


def bindings(table: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """(subject, value): the versions that subjects are bound to."""
    bound = table.where("predicate = 'bound_version'")
    if subjects is not None:
        bound = bound.join(subjects.select(F.col("ref").alias("_s")).distinct(), F.col("subject") == F.col("_s"), "left_semi")
    return bound.select("subject", F.col("value").cast("string").alias("value")).distinct()


def envelope(targets: DataFrame, versions: DataFrame, table: DataFrame, pinned: DataFrame, downstream: DataFrame) -> DataFrame:
    """(entity_id, section, item, value): all that there is about each target (entity_id): its versions, facts about them or it, the pins of what those rest on, and what depends on it.

    versions: entity_id, version_ref, content_hash. table: facts. pinned: ref, pinned_hash. downstream: entity_id, ref, depth.
    """
    t = targets.select("entity_id").distinct()
    v = versions.join(t, "entity_id").select("entity_id", "version_ref", "content_hash")
    about = v.select("entity_id", F.col("version_ref").alias("s")).unionByName(t.select("entity_id", F.col("entity_id").alias("s"))).distinct()
    f = table.join(about, F.col("subject") == F.col("s")).select("entity_id", "fact_id", "predicate", F.col("value").cast("string").alias("value"))
    p = f.where("predicate = 'authority_source'").join(pinned, F.col("value") == F.col("ref")).select("entity_id", "ref", "pinned_hash")
    row = lambda df, section, item, value: df.select("entity_id", F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), F.col(value).cast("string").alias("value"))
    parts = row(v, "version", "version_ref", "content_hash").unionByName(row(f, "fact", "fact_id", "value")).unionByName(row(p.distinct(), "pin", "ref", "pinned_hash"))
    return parts.unionByName(row(downstream.join(t, "entity_id"), "downstream", "ref", "depth"))
