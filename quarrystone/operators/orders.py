"""Total orders that answers and digests are given in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written


# the orders by name; columns need a session, so each is made when it is asked for
EDGES = lambda: [F.col(c) for c in ("source_ref", "relation", "target_ref")]
IMPACT = lambda: [F.col("entity_id"), F.coalesce("version_ref", F.lit(""))]
SEMANTIC = lambda: [F.desc("score_q"), F.col("entity_id"), F.coalesce("versioned_ref", F.lit("")), F.col("path")]


def edges(rows: DataFrame) -> DataFrame:
    """Edges by source, relation and target, in the order of their bytes."""
    return rows.orderBy(*EDGES())


def impact(rows: DataFrame) -> DataFrame:
    """Affected rows by entity and version, those without a version first."""
    return rows.orderBy(*IMPACT())


def semantic(rows: DataFrame) -> DataFrame:
    """Ranked rows by score, best first, then entity, version and path; a missing version counts as empty."""
    return rows.orderBy(*SEMANTIC())


def placed(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """rows with place: their number in the order of the keys, from 1, over the whole table. Rows that no key tells apart get places of their own, in any order.

    Rows are dealt out by ranges of the keys and written; each range is numbered by itself and set off by the sizes of those before it, so no task sorts the table.
    """
    dealt = written(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    before = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = dealt.withColumn("place", F.row_number().over(Window.partitionBy("_range").orderBy(*keys)))
    return within.join(before, F.col("_range") == F.col("_r")).withColumn("place", F.col("place") + F.col("_before")).drop("_range", "_r", "_before")


def value_key(json: Column) -> Column:
    """What JSON scalars sort by: null, false, true, whole numbers by size, strings by their bytes; anything else comes last, by its text."""
    text = F.trim(json)
    kind = F.when(text.isNull() | (text == "null"), 0).when(text == "false", 1).when(text == "true", 2).when(text.rlike(r"^-?[0-9]+$"), 3).when(text.startswith('"'), 4).otherwise(5)
    number = F.when(kind == 3, text.try_cast("decimal(38,0)"))
    return F.struct(kind.alias("kind"), number.alias("number"), F.when(kind > 3, text).alias("text"))


def predictions(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by the values of their columns, each JSON text of a scalar, in the order of value_key()."""
    return rows.orderBy(*[value_key(F.col(c)) for c in columns])


def digests(rows: DataFrame, digest: str) -> DataFrame:
    """Rows by the bytes that their digests stand for, with repeated (whether a digest stands more than once, which a commitment rejects); what isn't hexadecimal comes first."""
    raw = F.unhex(F.regexp_replace(digest, "^sha256:", ""))
    twice = rows.groupBy(F.col(digest).alias("_d")).agg((F.count("*") > 1).alias("repeated"))
    return rows.join(twice, rows[digest] == twice["_d"], "left").drop("_d").orderBy(raw, digest)
