"""Scores of answers against sealed expectations: sets, graphs, tracks, gates, and a clustered bootstrap."""

from __future__ import annotations

import hmac
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import Stream, frame

GATE = 0.98


def confusion(predicted: DataFrame, gold: DataFrame, by: str, item: str) -> DataFrame:
    """(by, tp, fp, fn, exact) of two sets of (by, item)."""
    side = lambda df, bit: df.select(by, item).distinct().withColumn("bit", F.lit(bit))
    both = side(predicted, 1).unionByName(side(gold, 2)).groupBy(by, item).agg(F.sum("bit").alias("s"))
    n = lambda s: F.count_if(F.col("s") == s)
    return both.groupBy(by).agg(n(3).alias("tp"), n(1).alias("fp"), n(2).alias("fn"), (F.count_if(F.col("s") != 3) == 0).alias("exact"))


def ratios(counts: DataFrame) -> DataFrame:
    """tp, fp, fn summed over all rows, with precision, recall and f1; null over an empty denominator."""
    s = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return s.select("*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def tracks(results: DataFrame) -> DataFrame:
    """(track, n, score): the mean score of a track in per cent, to one decimal."""
    return results.groupBy("track").agg(F.count("*").alias("n"), F.round(F.avg("score") * 100, 1).alias("score"))


def composite(track_scores: DataFrame) -> DataFrame:
    return track_scores.agg(F.round(F.avg("score"), 1).alias("composite"))


def metrics(results: DataFrame) -> DataFrame:
    """One row: civ, zhr, pgem, vlp, fcaa, sf1, if1; each null where no result has it."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    f1 = lambda p: F.try_divide(2 * F.sum(f"{p}_tp"), 2 * F.sum(f"{p}_tp") + F.sum(f"{p}_fp") + F.sum(f"{p}_fn"))
    return results.agg(
        F.sum("civ_count").alias("civ"), rate("hallucinated").alias("zhr"), rate("graph_exact_match").alias("pgem"), rate("version_correct").alias("vlp"),
        rate("fail_closed_correct").alias("fcaa"), f1("stale").alias("sf1"), f1("impact").alias("if1"),
    )


def gate(values: DataFrame) -> DataFrame:
    """values with qualified: all metrics present, no violation, no hallucination, the other four at least 0.98."""
    high = [F.col(c) >= GATE for c in ("vlp", "sf1", "if1", "fcaa")]
    fine = (F.col("civ") == 0) & (F.col("zhr") == 0)
    for h in high:
        fine = fine & h
    return values.withColumn("qualified", F.coalesce(fine, F.lit(False)))


def coverage(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """(kind, key): expected ones that are missing, given ones that are unexpected or repeated."""
    miss = expected.select(key).distinct().join(given.select(key), key, "left_anti").select(F.lit("missing").alias("kind"), key)
    more = given.select(key).distinct().join(expected.select(key), key, "left_anti").select(F.lit("unexpected").alias("kind"), key)
    twice = given.groupBy(key).count().where("count > 1").select(F.lit("duplicate").alias("kind"), key)
    return miss.unionByName(more).unionByName(twice)


def multiset_score(a: DataFrame, b: DataFrame, by: str, item: str) -> DataFrame:
    """(by, shared, total): tokens of b that a has, counted as often as both have them, and all of b."""
    n = lambda df, name: df.groupBy(by, item).agg(F.count("*").alias(name))
    both = n(b, "nb").join(n(a, "na"), [by, item], "left")
    return both.groupBy(by).agg(F.sum(F.least("nb", F.coalesce("na", F.lit(0)))).alias("shared"), F.sum("nb").alias("total"))


def instance_scores(passes: DataFrame) -> DataFrame:
    """(participant, family, instance, score): share of repetitions passed; a failed repetition counts as 0."""
    return passes.groupBy("participant", "family", "instance").agg(F.avg(F.coalesce("passed", F.lit(0)).cast("double")).alias("score"))


def macro(scores: DataFrame) -> DataFrame:
    """(participant, macro, micro): mean of family means, and mean of instances."""
    fam = scores.groupBy("participant", "family").agg(F.avg("score").alias("f"), F.sum("score").alias("s"), F.count("*").alias("n"))
    return fam.groupBy("participant").agg(F.avg("f").alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"))


def rounds(passes: DataFrame) -> DataFrame:
    """(participant, sd, least, most) of the repetitions' macro means; the deviation divides by one less than their number."""
    fam = passes.groupBy("participant", "repetition", "family").agg(F.avg(F.coalesce("passed", F.lit(0)).cast("double")).alias("f"))
    each = fam.groupBy("participant", "repetition").agg(F.avg("f").alias("m"))
    return each.groupBy("participant").agg(F.stddev_samp("m").alias("sd"), F.min("m").alias("least"), F.max("m").alias("most"))


def variation(passes: DataFrame) -> DataFrame:
    """(participant, pass_rate, prediction_rate): share of instances whose repetitions differ in passing, or in digests that aren't null."""
    each = passes.groupBy("participant", "family", "instance").agg((F.count_distinct("passed") > 1).cast("double").alias("p"), (F.count_distinct("digest") > 1).cast("double").alias("d"))
    return each.groupBy("participant").agg(F.avg("p").alias("pass_rate"), F.avg("d").alias("prediction_rate"))


def bootstrap(scores: DataFrame, seed: str, order: list[str] | None = None, replicates: int = 10_000) -> DataFrame:
    """(participant, replicate, estimate): macro means of resampled instances.

    In each replicate and family as many instances are drawn, with replacement, as the family has; the draw is the same
    for all participants. A draw's index comes from a keyed stream of its own, made where it is used.
    """
    w = Window.partitionBy("participant", "family").orderBy("instance")
    ranked = scores.withColumn("k", F.row_number().over(w) - 1)
    sizes = ranked.select("family", "k").distinct().groupBy("family").agg(F.count("*").alias("size"))
    root = bytes.fromhex(seed)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u32 = lambda n: struct.pack(">I", n)
        keyed, first = (lambda key, message: hmac.digest(key, message, "sha256")), frame("counter", struct.pack(">Q", 0))
        for b in batches:
            rows = []
            for replicate, family, size in zip(b["replicate"].tolist(), b["family"].tolist(), b["size"].tolist(), strict=True):
                head, line = frame("replicate", u32(replicate)) + frame("family_id", family.encode("ascii")), (1 << 32) // size * size
                for d in range(size):
                    key = keyed(root, head + frame("draw_index", u32(d)))
                    word = int.from_bytes(keyed(key, first)[:4], "big")  # a stream's first word nearly always does
                    rows.append((replicate, family, size, 0 if size == 1 else word % size if word < line else Stream(key).uniform(size)))
            yield pd.DataFrame(rows, columns=["replicate", "family", "size", "k"])

    cells = sizes.select("family", F.col("size").cast("int").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    cells = cells.repartition("replicate").select("replicate", "family", "size")
    draws = cells.mapInPandas(draw, "replicate int, family string, size int, k int")
    fam = draws.join(ranked.select("participant", "family", "k", "score"), ["family", "k"]).groupBy("participant", "replicate", "family").agg(F.avg("score").alias("f"))
    return fam.groupBy("participant", "replicate").agg(F.avg("f").alias("estimate"))


def interval(estimates: DataFrame, value: str = "estimate", by: str = "participant") -> DataFrame:
    """(by, low, high): the 250th from either end of the sorted estimates, not interpolated (of 10,000; in proportion for other numbers)."""
    w = Window.partitionBy(by)
    r = estimates.withColumn("nth", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    cut = lambda share: F.floor(F.col("n") * share).cast("int") - 1
    pick = lambda at, name: F.max(F.when(F.col("nth") == at, F.col(value))).alias(name)
    return r.groupBy(by).agg(pick(cut(0.025), "low"), pick(cut(0.975), "high"))


def paired(estimates: DataFrame, focal: str, other: str) -> DataFrame:
    """(participant, replicate, estimate): differences within each replicate."""
    side = lambda p, name: estimates.where(F.col("participant") == p).select("replicate", F.col("estimate").alias(name))
    return side(focal, "a").join(side(other, "b"), "replicate").select(F.lit(f"{focal}-{other}").alias("participant"), "replicate", (F.col("a") - F.col("b")).alias("estimate"))


def decimal(value: Column) -> Column:
    """Twelve places, half to even."""
    return F.bround(value.cast("decimal(38,18)"), 12).cast("decimal(38,12)")
