"""A directory of research files as tables: scan, parse, derive documents, runs, references and relations; write and read versions of the index."""

from __future__ import annotations

import json
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import file_digest, manifest_digest
from ..functions.storage import kept
from . import yaml

#: Relative paths that begin so are no part of a tree; a tool's own folder is added by the caller.
SKIPPED = (".index", ".git")
#: Suffixes of files that the semantic corpus holds (fixed values).
CORPUS = (".md", ".yaml", ".yml", ".txt", ".csv", ".json", ".log")

REF = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "source_type", "content_hash", "reference_scope", "git_commit", "section")])
_META = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "version", "experiment_ref", "status", "model", "context_length", "raw_path")]
    + [T.StructField("raw_ref", REF), T.StructField("sources", T.ArrayType(REF)), T.StructField("names", T.ArrayType(T.StringType()))]
)


def _text(v) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v)


def _ref(v) -> dict | None:
    return {n: _text(v.get(n)) for n in REF.names} if isinstance(v, dict) else None


@F.pandas_udf(_META)
def parsed(text: pd.Series) -> pd.DataFrame:
    """Fields of YAML texts; one that can't be read, or is no map, has none."""

    def one(t):
        try:
            d = yaml.loads(t) if t else {}
        except (ValueError, IndexError):
            d = {}
        d = d if isinstance(d, dict) else {}
        raw, sources = d.get("raw_ref"), d.get("sources")
        sources = sources if isinstance(sources, list) else []
        row = {n: _text(d.get(n)) for n in ("id", "version", "experiment_ref", "status", "model", "context_length")}
        row |= {"raw_path": raw if isinstance(raw, str) else None, "raw_ref": _ref(raw), "sources": [r for r in map(_ref, sources) if r]}
        return row | {"names": [s if isinstance(s, str) else s.get("path") or "" for s in sources if isinstance(s, (str, dict))]}

    return pd.DataFrame([one(t) for t in text], columns=_META.names)


# a filter on the fields, as explode() brings one, would else go below them with a parse of its own, so that each text is read twice
parsed = parsed.asNondeterministic()


def scan(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, content, content_hash, size) of the files under root, by Spark's reader; path is relative."""
    base = re.sub(r"/+$", "", root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    head = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    head = head.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(head).toString()
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[a-z]+:/+", "/"), "%20", " ")
    rel = F.substring(plain(F.col("path")), len(re.sub(r"^[a-z]+:/+", "/", head)) + 2, 1 << 20)
    out = files.select(rel.alias("path"), "content", file_digest(F.col("content")).alias("content_hash"), F.col("length").alias("size"))
    for s in skipped:
        out = out.where(~F.col("path").startswith(s))
    return out


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """(n, digest): of all files in the byte order of their paths; directories first, so that no task holds all lines."""
    by_dir = manifest_digest(files.withColumn("dir", F.regexp_replace("path", r"[^/]*$", "")), "dir", "path", "content_hash")
    return manifest_digest(by_dir.withColumn("all", F.lit(1)), "all", "dir", "digest").select("digest")


def front_matter(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)


def file_name(path: Column | str) -> Column:
    """What follows a path's last slash. A pattern for it tries each folder before."""
    return F.substring_index(path, "/", -1)


def corpus(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(id, text): documents whose file has a text suffix and is strict UTF-8."""
    j = documents.join(files.select("path", "content"), "path").where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*CORPUS))
    return j.where(F.is_valid_utf8(F.col("content").cast("string"))).select("id", F.col("content").cast("string").alias("text"))


def preceding(rows: DataFrame, key: str) -> DataFrame:
    """rows with before: the key that comes just before in the order of all keys. Ranges of keys are ordered apart, and each range's first follows the last of the range before."""
    ranged = kept(rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    lasts = ranged.groupBy("_range").agg(F.max(key).alias("_last"))  # a row a range
    follows = lasts.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_follows"))
    out = ranged.withColumn("before", F.lag(key).over(Window.partitionBy("_range").orderBy(key))).join(F.broadcast(follows), "_range")
    return out.withColumn("before", F.coalesce("before", "_follows")).drop("_range", "_follows")


@F.pandas_udf(T.StringType())
def yaml_json(text: pd.Series) -> pd.Series:
    """YAML maps as JSON; null for what can't be read, repeats a key or is no map."""

    def one(t):
        try:
            d = yaml.loads(t or "", strict=True)
        except (ValueError, IndexError):
            return None
        return json.dumps(d, ensure_ascii=False) if isinstance(d, dict) else None

    return text.map(one)


class Index:
    """Tables of a tree. Each is a projection of one scan; nothing is read twice by hand."""

    def __init__(self, files: DataFrame, git_commit: str = "HEAD"):
        self.files, self.commit = files, git_commit
        self.texts = files.withColumn("text", F.col("content").cast("string"))

    def _at(self, pattern: str) -> DataFrame:
        return self.texts.where(F.col("path").rlike(pattern))

    def _read(self, df: DataFrame, key: str) -> DataFrame:
        """df with the fields of its texts. A file of few megabytes may stand for a million of them, so they are dealt to a number of tasks that Spark doesn't reduce by their bytes."""
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(tasks, key).withColumn("meta", parsed(F.col("text")))

    def _row(self, df: DataFrame, id_: Column, doc_type: str, status: Column | str, version: Column | None = None) -> DataFrame:
        status = F.lit(status) if isinstance(status, str) else status
        version = F.lit(None).cast("string") if version is None else version
        return df.select(id_.alias("id"), F.lit(doc_type).alias("doc_type"), "path", version.alias("version"), "content_hash", F.lit(self.commit).alias("git_commit"), status.alias("status"))

    @property
    def organized(self) -> DataFrame:
        o = self._at(r"^organized/.*\.md$").withColumn("meta", parsed(front_matter(F.col("text"))))
        return o.withColumn("id", F.coalesce("meta.id", F.regexp_replace(file_name("path"), r"\.md$", "")))

    @property
    def manifests(self) -> DataFrame:
        m = self._read(self._at(r"^runs/[^/]+/manifest\.yaml$"), "path")
        return m.withColumn("id", F.split("path", "/")[1])

    @property
    def sidecars(self) -> DataFrame:
        report = F.regexp_replace("path", r"\.sources\.yaml$", ".md")
        s = self._at(r"^reports/(CURRENT|history/[^/]+)\.sources\.yaml$").select(report.alias("owner_path"), "text")
        reports = self.files.where(F.col("path").rlike(r"^reports/(CURRENT|history/[^/]+)\.md$")).select(F.col("path").alias("report"))  # no other file can be an owner
        return self._read(s, "owner_path").select(F.regexp_replace(file_name("owner_path"), r"\.md$", "").alias("owner"), "owner_path", F.explode("meta.sources").alias("s")).join(reports, F.col("owner_path") == F.col("report"), "left_semi")

    @property
    def raw(self) -> DataFrame:
        r = self.files.where(F.col("path").rlike(r"^raw/[^/]+/[^/]+/.+")).withColumn("run", F.regexp_extract("path", r"^(raw/[^/]+/[^/]+)/", 1))
        r = r.withColumn("rel", F.substring("path", F.length("run") + 2, F.lit(1 << 20)))
        bad = r.groupBy("run").agg(F.bool_or(F.col("rel") == "STATUS.yaml").alias("bad"))
        return manifest_digest(r, "run", "rel", "content_hash", "content_hash").join(bad, "run").withColumn("path", F.col("run"))

    @property
    def documents(self) -> DataFrame:
        """id, doc_type, path, version, content_hash, git_commit, status. A run's status is its manifest's."""
        name = F.regexp_replace(file_name("path"), r"\.md$", "")
        return (
            self._row(self._at(r"^reports/CURRENT\.md$"), F.lit("CURRENT"), "report_current", "fresh")
            .unionByName(self._row(self._at(r"^reports/history/[^/]+\.md$"), name, "report_historical", "frozen"))
            .unionByName(self._row(self.organized, F.col("id"), "organized", "valid", F.concat(F.lit("v"), F.coalesce("meta.version", F.lit("1")))))
            .unionByName(self._row(self.raw, F.col("path"), "raw", F.when(F.col("bad"), "invalid").otherwise("valid")))
            .unionByName(self._row(self.manifests, F.col("id"), "run_manifest", F.coalesce("meta.status", F.lit("completed"))))
            .unionByName(self._row(self._at(r"^experiments/[^/]+/spec\.yaml$"), F.split("path", "/")[1], "experiment_spec", "frozen"))
        )

    @property
    def runs(self) -> DataFrame:
        m = self.manifests
        return m.select(F.col("id").alias("run_id"), "meta.experiment_ref", "meta.status", "meta.model", "meta.context_length", F.coalesce("meta.raw_ref.path", "meta.raw_path").alias("raw_ref_path"), F.col("meta.raw_ref.content_hash").alias("raw_ref_hash"), F.col("meta.raw_ref.git_commit").alias("raw_ref_commit"))

    @property
    def source_refs(self) -> DataFrame:
        def rows(df: DataFrame, type_: str, scope: str) -> DataFrame:
            f = lambda n, default: F.coalesce(F.col(f"s.{n}"), F.lit(default)).alias(n)
            return df.select("owner", "owner_path", f("path", ""), f("source_type", type_), f("reference_scope", scope), f("content_hash", ""), F.nullif(F.coalesce("s.git_commit", F.lit("")), F.lit("")).alias("git_commit"), f("section", "")).withColumnRenamed("path", "ref_path")

        runs = self.manifests.where("meta.raw_ref.path is not null").select(F.col("id").alias("owner"), F.col("path").alias("owner_path"), F.col("meta.raw_ref").alias("s"))
        organized = self.organized.select(F.col("id").alias("owner"), F.col("path").alias("owner_path"), F.explode("meta.sources").alias("s"))
        return rows(runs, "directory", "historical").unionByName(rows(self.sidecars, "file", "current")).unionByName(rows(organized, "directory", "historical"))

    @property
    def relations(self) -> DataFrame:
        edge = lambda df, s, r, t, v=None: df.select(F.col(s).alias("source"), F.lit(r).alias("relation"), t.alias("target"), (F.lit(None).cast("string") if v is None else v).alias("target_version"))
        reports = self.documents.where("doc_type = 'report_historical'").select("id")
        before = preceding(reports, "id").where("before is not null")
        return (
            edge(self.organized.select("id", F.explode("meta.names").alias("n")), "id", "organized_from", F.col("n"))
            .unionByName(edge(self.runs.where("raw_ref_path <> ''"), "run_id", "uses", F.col("raw_ref_path")))
            .unionByName(edge(self.sidecars, "owner", "based_on", F.coalesce("s.path", F.lit("")), F.substring(F.coalesce("s.git_commit", F.lit("")), 1, 8)))
            .unionByName(edge(before, "id", "supersedes", F.col("before")))
        )

    @property
    def impact_entities(self) -> DataFrame:
        """entity_id, version_ref, kind, path, body (JSON), condition: what a changed definition may affect: versions of definitions, runs, and files directly under organized.

        A document says who it is; else its place does. One that can't be read is IMPACT_INVALID, and an answer over such a table has to be refused.
        """
        part = lambda pattern, kind, own: self._at(pattern).select("path", F.lit(kind).alias("kind"), own.alias("own"), yaml_json(F.col("text")).alias("body"))
        stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.(?:md|yaml)$", "")
        rows = part(r"^definitions/[^/]+/(?!APPROVED|BOOTSTRAP)[^/]+\.yaml$", "definition", stem).unionByName(part(r"^runs/[^/]+/manifest\.yaml$", "run", F.split("path", "/")[1])).unionByName(part(r"^organized/[^/]+\.(?:md|yaml)$", "organized", stem))
        said = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("body", f"$.{n}"), F.lit("")) for n in names])
        entity = F.when(F.col("kind") == "definition", F.coalesce(said("entity_id"), F.split("path", "/")[1])).otherwise(F.coalesce(said("run_id", "entity_id"), F.col("own")))
        rows = rows.withColumn("entity_id", entity).withColumn("version_ref", F.coalesce(said("version_ref"), F.when(F.col("kind") == "definition", F.col("own")).otherwise(F.col("entity_id"))))
        return rows.select("entity_id", "version_ref", "kind", "path", "body", F.when(F.col("body").isNull(), "IMPACT_INVALID").alias("condition"))

    @property
    def live(self) -> DataFrame:
        """(path, content_hash) of files and of raw directories."""
        return self.files.select("path", "content_hash").unionByName(self.raw.select("path", "content_hash"))

    def write(self, target: str, events: DataFrame | None = None) -> dict:
        """Writes the tables as a new version under target and points to it last, so that a reader sees a whole index or the one before."""
        spark = self.files.sparkSession
        version = f"{target}/version-{uuid.uuid4().hex}"
        for name in ("documents", "runs", "source_refs", "relations"):
            getattr(self, name).write.parquet(f"{version}/{name}")
        if events is not None:
            events.write.parquet(f"{version}/events")
        last = events.agg(F.max("event_id")).first()[0] if events is not None else None
        mark = {"version": version, "fingerprint": tree_fingerprint(self.files).first()["digest"], "complete": True, "drift": False, "last_event": last}
        spark.createDataFrame([(json.dumps(mark),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/current")
        return mark


def watermark(spark: SparkSession, target: str) -> dict:
    """What the current version of an index stands for; {} where there is none."""
    try:
        return json.loads(spark.read.text(f"{target}/current").first()[0])
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
