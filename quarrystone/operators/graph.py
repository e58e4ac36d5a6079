"""Closures and subgraphs over edge tables, by joins of a frontier with the edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import kept, written
from . import lists

#: Rounds between writes of what has been reached.
CUT_EVERY = 4


def closure(edges: DataFrame, roots: DataFrame, source: str = "source_ref", target: str = "target_ref") -> DataFrame:
    """(root, ref, depth): what each root reaches over edges from source to target, itself at depth 0, least depth.

    Each round joins the frontier with the edges and drops what was reached before, so cycles end; it stops
    when nothing new is found. Reverse closures swap source and target.
    """
    steps = written(edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where("_t is not null"))  # read in each round
    reached = roots.select(F.col("ref").alias("root"), "ref", F.lit(0).alias("depth")).distinct()
    frontier = reached
    for depth in count(1):
        new = frontier.join(steps, frontier["ref"] == steps["_s"]).select("root", F.col("_t").alias("ref")).distinct()
        new = written(new.join(reached.select("root", "ref"), ["root", "ref"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        if depth % CUT_EVERY == 0:
            reached = written(reached)
        frontier = new
    return reached


def dependents(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """What depends on each root, at any distance, without the root."""
    return closure(edges, roots, "target_ref", "source_ref").where("depth > 0")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (root, ref) of one root."""
    a, b = nodes.select("root", F.col("ref").alias("source_ref")), nodes.select("root", F.col("ref").alias("target_ref"))
    return edges.join(a, "source_ref").join(b, ["root", "target_ref"]).select("root", "source_ref", "relation", "target_ref").distinct()


def propagation(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges among each root and its dependents."""
    return induced(edges, closure(edges, roots, "target_ref", "source_ref"))


def dependencies(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All edges that leave what each root depends on, or the root."""
    nodes = closure(edges, roots)
    return edges.join(nodes.select("root", F.col("ref").alias("source_ref")), "source_ref").select("root", "source_ref", "relation", "target_ref").distinct()


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or upstream of one: leaves are peeled until none is left."""
    now = kept(edges.select(F.col("source_ref").alias("s"), F.col("target_ref").alias("t")).where("t is not null").distinct())
    n = now.count()
    while True:
        inner = now.select(F.col("s").alias("k")).distinct()
        now = kept(now.join(inner, now["t"] == inner["k"], "left_semi"))
        before, n = n, now.count()
        if n == before:
            break
    return now.select(F.col("s").alias("ref")).distinct()


def lineage(versions: DataFrame) -> DataFrame:
    """entity_id, version_ref, place, condition: the chain from the one root over single children.

    An entity with several roots, none, or a version with several children is AMBIGUOUS_VERSION and has no places; numbers count, not text, so v10 follows v9.
    """
    by_entity = Window.partitionBy("entity_id")
    kids = Window.partitionBy("entity_id", "previous")
    v = versions.select("entity_id", "version", "version_ref", "previous")
    v = v.withColumn("roots", F.count_if(F.col("previous").isNull()).over(by_entity)).withColumn("siblings", F.when(F.col("previous").isNotNull(), F.count("*").over(kids)).otherwise(1))
    v = v.withColumn("bad", (F.col("roots") != 1) | (F.max("siblings").over(by_entity) > 1))
    before = F.lag("version_ref").over(by_entity.orderBy("version"))
    v = v.withColumn("before", before).withColumn("bad", F.col("bad") | F.max(F.coalesce(~F.col("previous").eqNullSafe(F.col("before")), F.lit(False))).over(by_entity))
    place = F.row_number().over(by_entity.orderBy("version")) - 1
    return v.select("entity_id", "version_ref", F.when(~F.col("bad"), place).alias("place"), F.when(F.col("bad"), "AMBIGUOUS_VERSION").alias("condition"))


def lineage_by_pointers(versions: DataFrame) -> DataFrame:
    """entity_id, version_ref, place, condition: the chain that the pointers to previous versions give, whatever their numbers.

    A version without a previous one among its entity's is a root. An entity with no root or several, a version that is previous to several or stands
    twice, or versions on a cycle is AMBIGUOUS_VERSION and has no places. Long lists are shortened first (lists), and what is left is ranked
    by doubling: each round every pointer leaps as far again, so the number of rounds is the logarithm of the longest chain.
    """
    v = kept(versions.select("entity_id", "version_ref", "previous"))
    known = v.select(F.col("entity_id").alias("of"), F.col("version_ref").alias("up")).distinct()
    up = v.join(known, (F.col("entity_id") == F.col("of")) & (F.col("previous") == F.col("up")), "left").select("entity_id", "version_ref", "up")
    rows = up.groupBy("entity_id", "version_ref").agg(F.count("*").alias("times"), F.max("up").alias("up"))
    forks = rows.where("up is not null").groupBy("entity_id", "up").count().where("count > 1").select("entity_id").distinct().withColumn("fork", F.lit(True))
    per = rows.groupBy("entity_id").agg(F.count_if(F.col("up").isNull()).alias("roots"), F.max("times").alias("times"), F.count("version_ref").alias("n"))
    per = kept(per.join(forks, "entity_id", "left").withColumn("bad", (F.col("roots") != 1) | (F.col("times") > 1) | F.col("fork").isNotNull()))
    good = rows.join(per.where("not bad"), "entity_id", "left_semi").select("entity_id", "version_ref", "up")
    sides = good.select("entity_id", F.inline(F.array(F.struct(F.col("version_ref").alias("node"), F.struct("up").alias("u"), F.lit(None).cast("string").alias("down")), F.struct(F.col("up").alias("node"), F.lit(None).cast("struct<up:string>").alias("u"), F.col("version_ref").alias("down"))))).where("node is not null")
    met = sides.repartition("entity_id", "node").groupBy("entity_id", "node").agg(F.max("u")["up"].alias("up"), F.max("down").alias("down"))  # no version of these is previous to two
    left, gone = lists.shorten(written(met.withColumns({"up_in": F.col("up").isNotNull(), "down_in": F.col("down").isNotNull(), "w": F.col("up").isNotNull().cast("long")})), ["entity_id"])
    links = left.select("entity_id", F.col("node").alias("version_ref"), "up", F.col("w").alias("place"))
    longest = links.groupBy("entity_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range(max(1, (longest - 1).bit_length())):
        far = links.select(F.col("entity_id").alias("of"), F.col("version_ref").alias("k"), F.col("up").alias("up2"), F.col("place").alias("more"))
        leapt = links.join(far, (F.col("entity_id") == F.col("of")) & (F.col("up") == F.col("k")), "left")
        links = written(leapt.select("entity_id", "version_ref", F.col("up2").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")))
    placed = links.where("up is null").select("entity_id", F.col("version_ref").alias("node"), "place")  # what is on a cycle never comes to a root
    first = lambda x: x.where("not up_in").select("entity_id", "node", F.col("w").alias("place"))
    placed = lists.answer(placed, gone, ["entity_id"], first, lambda x: x.select("entity_id", "node", (F.col("place") + F.col("w")).alias("place")))
    whole = placed.groupBy("entity_id").agg(F.count("*").alias("m"))
    per = per.join(whole, "entity_id", "left").select("entity_id", (F.col("bad") | (F.col("n") != F.coalesce("m", F.lit(0)))).alias("bad"))
    out = v.join(per, "entity_id").join(placed.select("entity_id", F.col("node").alias("version_ref"), "place"), ["entity_id", "version_ref"], "left")
    bad = F.col("bad")
    return out.select("entity_id", "version_ref", F.when(~bad, F.col("place")).alias("place"), F.when(bad, "AMBIGUOUS_VERSION").alias("condition"))


def fingerprints(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, n and a fingerprint of each group's rows as a multiset: sums of two hashes of 60 bits a row, over all its other columns, in whatever order they come."""
    others = sorted(c for c in rows.columns if c not in by)
    text = F.md5(F.to_json(F.struct(*others), {"ignoreNullFields": "false"}))
    part = lambda k: F.sum(F.conv(F.substring(text, k, 15), 16, 10).cast("decimal(20,0)"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.struct(part(1).alias("a"), part(17).alias("b")).alias("fingerprint"))


def same_graphs(predicted: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """by, same, missing, extra: for each group of either table whether both hold the same rows equally often, and how many rows one has that the other lacks.

    Groups are compared by their fingerprints, in one pass over either table; only those that differ are compared row by row, by counts.
    """
    a = fingerprints(predicted, by).withColumnRenamed("fingerprint", "_f").withColumnRenamed("n", "_nf")
    b = fingerprints(gold.select(*predicted.columns), by).withColumnRenamed("fingerprint", "_g").withColumnRenamed("n", "_ng")
    both = kept(a.join(b, by, "full").select(*by, (F.col("_f").eqNullSafe(F.col("_g")) & F.col("_nf").eqNullSafe(F.col("_ng"))).alias("same")))
    others = [c for c in predicted.columns if c not in by]
    odd = both.where("not same").select(*by)
    signed = predicted.withColumn("_d", F.lit(-1)).unionByName(gold.select(*predicted.columns).withColumn("_d", F.lit(1))).join(odd, by, "left_semi")
    surplus = signed.groupBy(*by, *others).agg(F.sum("_d").alias("d")).groupBy(*by)
    surplus = surplus.agg(F.sum(F.greatest("d", F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("extra"))
    return both.join(surplus, by, "left").select(*by, "same", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("missing", "extra")])


def same_graph(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often; no credit for parts."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# ---- trails of source references


def _bare_path(path: Column) -> Column:
    """A path without slashes at its end: as it is, with one or without, a path means the same."""
    return F.regexp_replace(path, "/+$", "")


def trace(refs: DataFrame, entities: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (root, entity_id, entity_type, depth, relation_type) and edges (root, owner, ref_path, relation_type, is_available, is_stale) of what each start rests on.

    A start (ref) is an entity's id, else its path; one that is neither has no rows. References (owner, ref_path, source_type, outcome) lead on to the entity
    that has their path, else to the path itself, but only those that are available: verified, or drifted since their pin. Each node is met once. An
    edge is named after its owner's type: an entity's own, where the owner was met as a start or has one, else what the reference says it is.
    """
    ids = entities.select(F.col("id").alias("entity_id"), "entity_type", "path")
    by_id = starts.join(ids, starts["ref"] == ids["entity_id"]).select("ref", "entity_id", F.lit(0).alias("rank"))
    by_path = starts.join(ids, starts["ref"] == ids["path"]).select("ref", "entity_id", F.lit(1).alias("rank"))
    found = by_id.unionByName(by_path).groupBy("ref").agg(F.min(F.struct("rank", "entity_id"))["entity_id"].alias("root"))
    named = ids.groupBy(F.col("path").alias("p")).agg(F.max("entity_id").alias("of_path"))
    hop = refs.join(named, refs["ref_path"] == named["p"], "left").withColumn("child", F.coalesce("of_path", "ref_path")).drop("p", "of_path")
    hop = hop.withColumns({"is_stale": F.col("outcome") == "SOURCE_CHANGED_SINCE_PIN", "is_available": F.col("outcome").isin("ok", "SOURCE_CHANGED_SINCE_PIN")})
    reached = closure(hop.where("is_available").select(F.col("owner").alias("source_ref"), F.col("child").alias("target_ref")), found.select(F.col("root").alias("ref")).distinct())
    guessed = hop.where("is_available").groupBy("child").agg(F.min(F.when(F.col("source_type") == "directory", "raw").otherwise("organized")).alias("guess"))
    kinds = ids.groupBy("entity_id").agg(F.min("entity_type").alias("entity_type"))
    nodes = reached.select("root", F.col("ref").alias("entity_id"), "depth").join(kinds, "entity_id", "left").join(guessed, F.col("entity_id") == F.col("child"), "left")
    kind = F.when(F.col("depth") == 0, F.col("entity_type")).otherwise(F.coalesce("guess", "entity_type"))
    nodes = nodes.select("root", "entity_id", kind.alias("entity_type"), "depth", F.when(F.col("depth") == 0, "start").otherwise("child").alias("relation_type"))
    label = F.when(F.col("entity_type").startswith("report"), "based_on").when(F.col("entity_type") == "organized", "organized_from").otherwise("uses")
    edges = nodes.join(hop, nodes["entity_id"] == hop["owner"]).select("root", "owner", "ref_path", label.alias("relation_type"), "is_available", "is_stale")
    return nodes, edges


def trace_status(starts: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref, status) of each start: error for one that is no entity, fail_closed where a reference on its trail is broken, warning where one has drifted, else success."""
    known = entities.select(F.col("id").alias("k"), F.col("id").alias("root")).unionByName(entities.select(F.col("path").alias("k"), F.col("id").alias("root")))
    roots = starts.join(known, starts["ref"] == known["k"], "left").groupBy("ref").agg(F.min("root").alias("root"))
    flags = edges.groupBy(F.col("root").alias("r")).agg(F.bool_or(~F.col("is_available")).alias("broken"), F.bool_or("is_stale").alias("stale"))
    status = F.when(F.col("root").isNull(), "error").when(F.col("broken"), "fail_closed").when(F.col("stale"), "warning").otherwise("success")
    return roots.join(flags, F.col("root") == F.col("r"), "left").select("ref", status.alias("status"))


def physical_impact(refs: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, entity_id, path): owners (owner, owner_path) whose references (ref_path) lead to a start, by owner and by path, over any number of steps; paths match whole, whatever slashes end them."""
    up = refs.select(_bare_path(F.col("ref_path")).alias("source_ref"), F.col("owner").alias("target_ref"))
    own = refs.where("owner_path is not null").select(F.col("owner").alias("source_ref"), _bare_path(F.col("owner_path")).alias("target_ref"))
    reached = closure(up.unionByName(own).distinct(), starts.select(_bare_path(F.col("ref")).alias("ref"))).where("depth > 0")
    owners = refs.groupBy("owner").agg(F.min("owner_path").alias("path"))
    return reached.join(owners, reached["ref"] == owners["owner"]).select("root", F.col("owner").alias("entity_id"), "path")
