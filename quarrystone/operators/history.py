"""Reports and objects as of a time. Dates as text compare as text only where a function says so."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written

RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$"

#: Spans of lifetimes are up to two to this many days long; they begin in 1600.
LEVELS = 19


def history_by_date_text(reports: DataFrame, as_of: str | None = None) -> DataFrame:
    """Reports in order of id; with a cutoff only frozen ones whose date as text is at or before its first ten characters (none: dropped)."""
    if as_of is not None:
        reports = reports.where((F.col("frozen_at") <= as_of[:10]) & (F.col("doc_type") != "report_current"))
    return reports


def history(reports: DataFrame, as_of: str | None = None) -> DataFrame:
    """Reports frozen at or before a cutoff, both read as instants."""
    return reports if as_of is None else reports.where(F.try_to_timestamp("frozen_at") <= F.to_timestamp(F.lit(as_of)))


def instants(rows: DataFrame, column: str) -> DataFrame:
    """rows with the column as an instant in UTC; what isn't a timestamp with date, time and zone is null."""
    return rows.withColumn(f"{column}_utc", F.when(F.col(column).rlike(RFC3339), F.try_to_timestamp(column)))


def research_state(reports: DataFrame, verified: DataFrame) -> DataFrame:
    """id, state: fresh for the current report, stale for one of whose sources has changed since its pin, else null."""
    moved = verified.groupBy("owner").agg(F.bool_or("drifted").alias("moved"))
    r = reports.join(moved, reports["id"] == moved["owner"], "left")
    return r.select("id", F.when(F.col("doc_type") == "report_current", "fresh").when(F.col("moved"), "stale").alias("state"))


def summary(text):
    """The first line of over ten characters that is no heading or quotation, after the front matter; at most 80 characters."""
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 10) & ~x.startswith("#") & ~x.startswith(">"))
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, 80)


def chain(reports: DataFrame, by: str, key: str = "id") -> DataFrame:
    """(source_ref, relation, target_ref): each report supersedes the one before it in its group."""
    before = F.lag(key).over(Window.partitionBy(by).orderBy(key))
    return reports.select(F.col(key).alias("source_ref"), F.lit("supersedes").alias("relation"), before.alias("target_ref")).where("target_ref is not null")


def snapshot(objects: DataFrame, facts: DataFrame, relations: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Objects that began by a time, facts up to it about them, relations between them; commit and status aren't known as of then."""
    seen = objects.where(F.col("lifecycle_start") <= as_of)
    refs = seen.select(F.col("ref").alias("seen"))
    ends = relations.join(refs, relations["source_ref"] == refs["seen"], "left_semi")
    return {
        "objects": seen.withColumns({"status": F.lit(None).cast("string")}),
        "facts": facts.where(F.col("occurred_at") <= F.lit(as_of).cast("timestamp_ntz")).join(refs, F.col("subject") == refs["seen"], "left_semi"),
        "relations": ends.join(refs, ends["target_ref"] == refs["seen"], "left_semi"),
    }


def alive(lifetimes: DataFrame, times: DataFrame, start: str = "starts", end: str = "ends", time: str = "as_of") -> DataFrame:
    """lifetimes joined with the times they hold at: start <= time < end, all dates; a null end never comes, a null start or time holds nowhere.

    A join by equality: a lifetime is cut into aligned spans of 1, 2, 4.. days, two of each length at most, and a time belongs to one span of
    each length. So a long lifetime has few rows, no row is looked at in vain, and each pair is met once. The times are written first, LEVELS rows a day at most,
    so that their files tell whether they are few enough to be sent to the spans, which are many.
    Dates lie from 1600 on, up to 2**LEVELS days later; times outside hold nowhere.
    """
    last = 1 << LEVELS
    day = lambda c: F.datediff(F.col(c), F.lit("1600-01-01")).cast("long")
    spans = lifetimes.withColumn("_s", F.greatest(day(start), F.lit(0))).withColumn("_e", F.least(F.coalesce(day(end), F.lit(last)), F.lit(last)))
    spans = spans.where(F.col(start).isNotNull() & (F.col("_s") < F.col("_e"))).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    size = F.pow(F.lit(2), F.col("_level")).cast("long")
    a, b = F.ceil(F.col("_s") / size).cast("long"), F.floor(F.col("_e") / size).cast("long")
    ends = F.array_compact(F.array(F.when((a < b) & (a % 2 == 1), a), F.when((a < b) & (b % 2 == 1), b - 1)))
    spans = spans.withColumn("_span", F.explode(ends)).drop("_s", "_e")
    asked = times.select(time).distinct().withColumn("_d", day(time)).where(F.col("_d").between(0, last - 1)).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    asked = asked.withColumn("_span", F.floor(F.col("_d") / F.pow(F.lit(2), F.col("_level"))).cast("long")).drop("_d")
    return spans.join(written(asked), ["_level", "_span"]).drop("_level", "_span")


def as_of_versions(facts: DataFrame, times: DataFrame) -> DataFrame:
    """(subject, predicate, as_of, value, occurred_at): the latest fact of each subject and predicate at or before each of its times.

    Facts and times (subject, as_of) are merged in one sort by subject and time; no range join.
    """
    f = facts.select("subject", "predicate", F.col("occurred_at").alias("t"), F.struct("occurred_at", "fact_id", "value").alias("fact"), F.lit(None).cast("timestamp_ntz").alias("as_of"))
    kinds = facts.select("subject", "predicate").distinct()
    q = times.join(kinds, "subject").select("subject", "predicate", F.col("as_of").alias("t"), F.lit(None).cast(f.schema["fact"].dataType).alias("fact"), "as_of")
    w = Window.partitionBy("subject", "predicate").orderBy("t", F.col("as_of").isNotNull(), F.col("fact.fact_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = f.unionByName(q).withColumn("last", F.last("fact", ignorenulls=True).over(w))
    return merged.where("as_of is not null and last is not null").select("subject", "predicate", "as_of", F.col("last.value").alias("value"), F.col("last.occurred_at").alias("occurred_at"))
