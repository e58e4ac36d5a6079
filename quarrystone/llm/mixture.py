"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hold, word_count

#: Weights of the sources in order, repeating; the mix's size as a share of all sizes; copies of a document at most.
WEIGHTS, SHARE, MAX_COPIES = (5.0, 2.0, 1.0), 1.5, 2
SEED = 20
#: Preferences count in steps of the STEPS-th part of a doubling, from 2^-LOWEST to 2^LOWEST.
STEPS, LOWEST = 8, 64

_UNIT = float(1 << 48)


def uniform(seed: int, *columns: str) -> Column:
    """A number strictly between 0 and 1, fixed by seed and the columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(_UNIT)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """sizes (source, source_size: a row a source) with each source's target.

    Sources in code point order, null last, take the weights in turn. A target stops at most times its
    source's size and the excess goes to the others by weight until none is above: sources in order of size by weight
    are full up to the first that the rest of the total, shared among it and those after it by weight, doesn't fill.
    One row a source goes through one task here.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = (F.lit(float(most)) * F.col("source_size")).alias("cap")
    rows = sizes.select("*", weight.alias("weight"), cap)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("left", F.lit(float(share)) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / F.sum("weight").over(after))
    open_ = F.col("cap") > F.col("level") * F.col("weight")
    rows = rows.withColumn("nth", F.row_number().over(filling))
    rows = rows.withColumn("level", F.min(F.when(open_, F.struct("nth", "level"))).over(everywhere)["level"])
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def by_length(text: Column) -> Column:
    """A preference that grows about with the root of a text's words: 2 to half the number of binary digits that their number has, rounded down."""
    return F.pow(F.lit(2.0), F.floor(F.length(F.bin(word_count(text))) / 2).cast("double"))


def _rates(cells: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """cells (source, level, words, rows) with source_size, target, rate, whole and inclusion: expected copies of each document of a cell.

    A source's rates are in proportion to its preferences and at most `most`: cells in order of preference stop there up to the first that
    the rest of the target, shared among it and those after it by words times preference, doesn't bring so far. A source has few cells.
    """
    liking = F.when(F.col("level").isNotNull(), F.pow(F.lit(2.0), F.col("level") / STEPS)).otherwise(F.lit(0.0))
    rows = cells.withColumn("liking", liking).join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("source")
    order = Window.partitionBy("of").orderBy(F.desc("liking"))
    full = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(most))
    after = F.sum(F.col("words") * F.col("liking")).over(Window.partitionBy("of").orderBy("liking"))
    rows = rows.withColumn("level_", F.when(after > 0, F.try_divide(F.col("target") - full, after)))
    stays = F.col("level_") * F.col("liking") <= most
    first = F.min(F.when(stays, F.struct(-F.col("liking"), F.col("level_").alias("line")))).over(Window.partitionBy("of"))["line"]
    rate = F.when((F.col("liking") > 0) & (F.col("source_size") > 0), F.least(F.coalesce(first * F.col("liking"), F.lit(float(most))), F.lit(float(most)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", F.greatest(rate, F.lit(0.0))).withColumn("whole", F.floor(F.col("rate") + F.lit(1e-12)))
    return rows.withColumn("inclusion", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))).drop("level_", "liking", "rate")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source", preference: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, inclusion, content (a hash), copies, taken (copies * size).

    A document's expected copies are in proportion to its preference (by default alike within a source), such that a source's words come to its
    target, and at most `most`: the whole part is certain; for the rest, documents are ranked by the odds of a random number over the odds of their inclusion, and the first of a
    source are taken, up to the words that the source still lacks; the one that crosses that line is taken if that comes nearer.
    So a source's words miss the target by half a document at most, unless preferences leave too few that may be taken. The order within a source is found without sorting it whole: ranks fall into
    about the root of the source's rows many buckets, whose sums lead to the bucket that crosses the line, and only that one is sorted.
    Preferences count in steps of the eighth part of a doubling, so that a source has few different ones and all sums are of whole numbers: reruns agree.
    A null text has size 0 and is taken 0 times its size; a null source is a source of its own; a preference that is null, 0 or less is 0; repeated rows are
    ranked apart in their order of content and may differ in copies only where they tie; null doc_ids draw by their content. An empty table gives no rows.
    """
    level = F.lit(0) if preference is None else F.when(preference.cast("double") > 0, F.greatest(F.lit(-LOWEST), F.least(F.lit(LOWEST), F.log2(preference.cast("double")))) * STEPS)
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("content"), F.round(level).cast("int").alias("level")
    )
    base = hold(base, "sizes")
    cells = hold(base.groupBy("source", "level").agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "cells")
    sums = cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows"))
    goals = targets(sums.select("source", "source_size"), weights, share, most)
    other = sums.select(F.col("source").alias("other"), F.ceil(F.sqrt("rows")).alias("buckets"))
    goals = goals.join(other, F.col("source").eqNullSafe(F.col("other"))).select(F.col("source").alias("of"), "source_size", "target", "buckets")
    rates = hold(_rates(cells, goals, most), "rates")
    everyone = Window.partitionBy("of")
    lack = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(everyone)
    mean = F.sum(F.col("inclusion") * F.col("rows")).over(everyone.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / F.sum("rows").over(everyone)
    odds = hold(rates.select("of", F.col("level").alias("at"), "source_size", "target", "buckets", "whole", "inclusion", lack.alias("lack"), mean.alias("mean")), "odds")
    rated = base.join(odds, F.col("source").eqNullSafe(F.col("of")) & F.col("level").eqNullSafe(F.col("at")))
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.col("content").cast("string")))
    ranked = rated.withColumn("of_row", drawn).withColumn("u", uniform(seed, "of_row"))
    ranked = ranked.withColumn("rank", F.when(F.col("inclusion") > 0, F.try_divide(F.col("u") / (1 - F.col("u")), F.col("inclusion") / (1 - F.col("inclusion")))))
    spread = F.col("rank") * F.try_divide(F.col("mean"), 1 - F.col("mean"))  # the same order, spread over the buckets about evenly whatever the inclusion
    ranked = ranked.withColumn("bucket", F.least(F.floor(spread / (1 + spread) * F.col("buckets")), F.col("buckets") - 1))
    sampled = F.expr("inclusion > 0")
    chosen = ranked.where(sampled)
    by_bucket = chosen.groupBy("of", "bucket").agg(F.sum("size").alias("words"), F.first("lack").alias("lack"))
    run = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lines = hold(by_bucket.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).where("before <= lack").groupBy("of").agg(F.max(F.struct("bucket", "before")).alias("line")), "lines")
    lined = ranked.join(lines.select(F.col("of").alias("lined"), "line"), F.col("of").eqNullSafe(F.col("lined")), "left")
    inside = Window.partitionBy("of", "bucket").orderBy("rank", "doc_id", "content", "size").rowsBetween(Window.unboundedPreceding, -1)
    crossing = lined.where(sampled & (F.col("bucket") == F.col("line.bucket")))
    crossing = crossing.withColumn("before", F.col("line.before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    crossing = crossing.withColumn("more", (F.col("before") + F.col("size") / 2 <= F.col("lack")).cast("int"))
    rest = lined.where(~F.coalesce(sampled & (F.col("bucket") == F.col("line.bucket")), F.lit(False)))
    rest = rest.withColumn("more", F.coalesce((sampled & (F.col("bucket") < F.col("line.bucket"))).cast("int"), F.lit(0)))
    names = ["doc_id", "source", "size", "source_size", "target", "inclusion", "content"]
    both = rest.select(*names, (F.col("whole") + F.col("more")).alias("copies")).unionByName(crossing.select(*names, (F.col("whole") + F.col("more")).alias("copies")))
    return both.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **params) -> DataFrame:
    """docs with each row as often as the mix takes it, in its own columns.

    Rows of the same doc_id, source and text are taken as often in all as the mix takes them in all; where it takes some of them once more
    than others, those whose columns have the least hash are taken more. Nulls are as in mix(). An empty table gives no rows.
    """
    named = docs.columns
    keyed = docs.withColumn("__content", F.xxhash64("text"))
    often = mix(docs, **params).groupBy("doc_id", "source", "content").agg(F.count("*").alias("__n"), F.sum("copies").cast("long").alias("__total"))
    often = often.where("__total > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("content").alias("__key"), "__n", "__total")
    often = hold(often, "often")
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & keyed["source"].eqNullSafe(F.col("__source")) & (keyed["__content"] == F.col("__key"))
    alike = F.col("__total") % F.col("__n") == 0
    plain = keyed.join(often.where(alike), same).withColumn("__turn", F.explode(F.sequence(F.lit(1), (F.col("__total") / F.col("__n")).cast("int")))).select(*named)
    uneven = often.where(~alike)
    if uneven.isEmpty():
        return plain
    whole = F.xxhash64(*[F.col(f"row.{c.name}") for c in docs.schema if not re.search("map<|variant", c.dataType.simpleString())])  # Spark doesn't hash maps
    rows = keyed.join(uneven, same).select("__id", "__source", "__key", "__n", "__total", F.struct(*named).alias("row")).withColumn("hash", whole)
    by = ["__id", "__source", "__key", "__n", "__total"]
    rows = rows.groupBy(*by, "hash").agg(F.first("row").alias("row"), F.count("*").alias("rows"))  # equal rows are summed before they meet
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(*by).orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.least(F.greatest(F.col("__total") % F.col("__n") - before, F.lit(0)), F.col("rows"))
    rows = rows.withColumn("times", (F.floor(F.col("__total") / F.col("__n")) * F.col("rows") + more).cast("int")).where("times > 0")
    return plain.unionByName(rows.withColumn("__turn", F.explode(F.sequence(F.lit(1), "times"))).select("row.*"))
