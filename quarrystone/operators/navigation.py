"""Indexes for readers: by hypothesis, by time, by topic and by status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Buckets of the status index (fixed values); other states have none.
BUCKETS = {"active": ("active", "fresh"), "completed": ("completed", "valid"), "failed": ("failed", "corrupted"), "invalid": ("invalid",), "superseded": ("frozen", "superseded", "stale")}


def bucket(status):
    out = F.lit(None).cast("string")
    for name, states in BUCKETS.items():
        out = F.when(F.lower(status).isin(*states), name).otherwise(out)
    return out


def status_index(documents: DataFrame) -> DataFrame:
    """(bucket, n, first, last): documents of each bucket; their lists stay rows, by status_entries()."""
    return documents.withColumn("bucket", bucket(F.col("status"))).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def status_entries(documents: DataFrame) -> DataFrame:
    entry = F.format_string("`%s` (%s: `%s`)", "id", "doc_type", "path")
    return documents.select(bucket(F.col("status")).alias("bucket"), entry.alias("entry")).where("bucket is not null").orderBy("bucket", "entry")


def time_index(items: DataFrame, when: str, item: str) -> DataFrame:
    """(day, n, first, last), newest day first."""
    return items.groupBy(F.to_date(when).alias("day")).agg(F.count("*").alias("n"), F.min(item).alias("first"), F.max(item).alias("last")).orderBy(F.desc("day"))


def grouped(rows: DataFrame, by: str, item: str) -> DataFrame:
    """(by, items): each group's distinct items as a sorted list, for groups of a size that a reader can read."""
    return rows.groupBy(by).agg(F.sort_array(F.collect_set(item)).alias("items"))


def experiments(runs: DataFrame) -> DataFrame:
    """(experiment, n, runs): runs by the text before the @ of what they refer to."""
    return runs.groupBy(F.split("experiment_ref", "@")[0].alias("experiment")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("run_id")).alias("runs"))


def index_page(sections: dict[str, DataFrame]) -> DataFrame:
    """line: the index as one text, a heading and sorted entries (column entry) for each section."""
    out = None
    for k, (title, df) in enumerate(sections.items()):
        spark = df.sparkSession
        head = spark.createDataFrame([(k, 0, f"## {k + 1}. {title}"), (k, 2, "")], "section int, part int, line string")
        part = head.unionByName(df.select(F.lit(k).alias("section"), F.lit(1).alias("part"), F.concat(F.lit("- "), "entry").alias("line")))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("section", "part", "line").select("line")


#: The heading of experiments whose spec names no hypothesis (a fixed value of the page).
UNASSIGNED = "未分配假设"


def hypothesis_index(specs: DataFrame, runs: DataFrame) -> DataFrame:
    """(hypothesis, experiment, status, n_runs): experiments under their spec's hypothesis, with how many runs refer to them; those without one, or without a spec, are unassigned."""
    r = runs.groupBy(F.split("experiment_ref", "@")[0].alias("of")).agg(F.count("*").alias("n_runs"))
    j = specs.join(r, specs["experiment"] == r["of"], "full")
    hypothesis = F.coalesce(F.nullif(F.col("hypothesis"), F.lit("")), F.lit(UNASSIGNED))
    return j.select(hypothesis.alias("hypothesis"), F.coalesce("experiment", "of").alias("experiment"), F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("n_runs", F.lit(0).cast("long")).alias("n_runs"))


def write_page(page: DataFrame, path: str) -> None:
    """The page as one text file in a folder; a page is of a size that a reader can read."""
    page.coalesce(1).write.mode("overwrite").text(path)
