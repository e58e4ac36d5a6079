"""Sums of doubles that are exact until they are rounded once, whatever the order of their rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a fixed-point sum after the binary point: in its upper half and in all.
UPPER, PLACES = 20, 80


def fixed(values: Column) -> Column:
    """A group's sum, exact and rounded once, as an aggregate of the JVM with partial sums.

    For values whose magnitude lies between 2**-28 and 2**43, or is zero: they are whole numbers of 2**-80 then. What smaller ones have below that is cut off. Up to 10**18 rows may be summed.
    """
    step = float(1 << UPPER)
    upper = F.floor(values * step)
    lower = F.floor((values - upper / step) * step * float(1 << (PLACES - UPPER)))
    low = F.sum(lower.cast("decimal(20,0)"))
    carry = F.floor(low / F.lit(1 << (PLACES - UPPER)).cast("decimal(20,0)")).cast("decimal(20,0)")
    high, rest = F.sum(upper.cast("decimal(20,0)")) + carry, (low - carry * F.lit(1 << (PLACES - UPPER)).cast("decimal(20,0)")).cast("decimal(20,0)")
    high = high.cast("decimal(37,0)")
    small = (F.when(F.abs(high) < 1 << 62, high).otherwise(0).cast("decimal(20,0)") * F.lit(1 << (PLACES - UPPER)).cast("decimal(20,0)") + rest).cast("decimal(38,0)").cast("double") / float(1 << PLACES)
    # beyond that, all that the rest decides is on which side of a half the sum lies: a digit more of the upper half tells
    large = (high * 2 + F.when(rest > 0, 1).otherwise(0)).cast("decimal(38,0)").cast("double") / float(2 << UPPER)
    return F.when(F.abs(high) < 1 << 62, small).otherwise(large)


def exact(df: DataFrame, by: list[str], value: str, out: str = "total") -> DataFrame:
    """by and the sum of a column of doubles of any size, exact and rounded once: what is left of the largest after others cancel it isn't lost.

    Each value is a whole number of a power of two, one for every 32 exponents, and whole numbers are summed group by group and power by power with
    partial sums; a group's powers, 68 at most, are put together in one row. Nulls don't count; a group of nulls has none. Infinities and NaN
    give what adding them gives.
    """
    v = F.col(value).cast("double")
    size = F.abs(v)
    usual = size.isNotNull() & ~F.isnan(v) & (size < float("inf")) & (size > 0)
    base = F.when(usual, (F.floor(F.log2(size) / 32) * 32 - 64).cast("int")).otherwise(0)
    half = F.floor(F.col("_base") / 2)
    scaled = F.when(F.col("_usual"), v * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - F.col("_base"))).otherwise(0.0)
    parts = df.where(v.isNotNull()).select(*by, v.alias(value), base.alias("_base"), usual.alias("_usual")).withColumn("_n", scaled)
    upper = F.floor(F.col("_n") / float(1 << 48))
    parts = parts.withColumn("_upper", upper).withColumn("_lower", (F.col("_n") - F.col("_upper") * float(1 << 48)).cast("long"))
    odd = F.when(~F.col("_usual") & (F.isnan(value) | (F.abs(value) == float("inf"))), F.col(value))
    sums = parts.groupBy(*by, "_base").agg(F.sum(F.col("_upper").cast("decimal(20,0)")).cast("string").alias("upper"), F.sum(F.col("_lower").cast("decimal(20,0)")).cast("string").alias("lower"), F.sum(odd).alias("odd"))
    held = sums.groupBy(*by).agg(F.collect_list(F.struct(F.col("_base").alias("base"), "upper", "lower")).alias("bins"), F.sum("odd").alias("odd"))

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals = [o if o is not None else _rounded(bins) for bins, o in zip(b.column("bins").to_pylist(), b.column("odd").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in by], pa.array(totals, pa.float64())], names=[*by, out])

    kinds = ", ".join(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in by)
    return held.mapInArrow(rounded, f"{kinds}{', ' if by else ''}`{out}` double")


def _rounded(bins: list[dict]) -> float:
    least = min(b["base"] for b in bins)
    whole = sum((int(b["upper"]) * (1 << 48) + int(b["lower"])) << (b["base"] - least) for b in bins)
    try:
        return float(whole << least) if least >= 0 else whole / (1 << -least)
    except OverflowError:
        return float("inf") if whole > 0 else float("-inf")
