"""The semantic index as tables: built from an index that is fresh, written whole or not at all, and opened only if it is sound and stands for its tree."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import pruned, semantic

#: What an index says of itself, and the form of each (fixed values).
METADATA = {
    "algorithm_version": "semantic-tfidf/v1",
    "source_scan_fingerprint": "sha256:[0-9a-f]{64}",
    "source_last_event_id": "EV-[0-9]{6}|none",
    "source_index_built_at": r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})",
    "document_count": "0|[1-9][0-9]*",
    "build_complete": "1",
}
#: Tables and their columns: those of the index proper, and the frequencies, norms, blocks of postings and texts that a ranking takes from it (fixed values).
#: ngrams holds a document's set of n-grams in a row.
TABLES = {
    "terms": ["term", "id", "tf", "n"],
    "ngrams": ["id", "grams"],
    "frequencies": ["term", "df"],
    "norms": ["id", "norm"],
    "postings": ["term", "slice", "block", "top", "n", "docs"],
    "documents": ["id", "norm"],
}
NOT_BUILT, CORRUPT, STALE = "SEMANTIC_INDEX_NOT_BUILT", "SEMANTIC_INDEX_CORRUPT", "SEMANTIC_INDEX_STALE"


class SemanticError(Exception):
    """Why an index can't answer; code is one of the closed vocabulary."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def is_fresh(base: dict) -> bool:
    """Whether an index of a tree is whole and hasn't drifted from it."""
    return bool(base) and base.get("complete") is True and not base.get("drift")


def write(docs: DataFrame, target: str, base: dict, built_at: str) -> dict:
    """Builds the index of docs (id, norm: a normalised text) as a new version under target and points to it last; returns its metadata.

    base is the watermark of the tree's own index; one that isn't fresh is refused before anything is written. A version whose rows break a rule is
    never pointed to. Terms are counted once; frequencies and norms come from the written terms.
    """
    if not is_fresh(base):
        raise SemanticError(STALE, "the index that this one is built from isn't fresh")
    spark = docs.sparkSession
    version = f"{target}/version-{uuid.uuid4().hex}"
    texts = docs.select("id", "norm")
    if texts.rdd.getNumPartitions() < 2 * spark.sparkContext.defaultParallelism:  # few files hold them
        texts = texts.repartition("id")
    texts.write.parquet(f"{version}/documents")
    docs = spark.read.parquet(f"{version}/documents")
    semantic.terms(docs).select("term", "id", (F.log("n") + 1).alias("tf"), "n").write.parquet(f"{version}/terms")
    docs.select("id", X.grams(F.col("norm")).alias("grams")).write.parquet(f"{version}/ngrams")
    terms = spark.read.parquet(f"{version}/terms")
    semantic.frequencies(terms).write.parquet(f"{version}/frequencies")
    many = docs.count()
    df = spark.read.parquet(f"{version}/frequencies")
    semantic.norms(terms, df, F.lit(many)).write.parquet(f"{version}/norms")
    pruned.postings(terms, df, spark.read.parquet(f"{version}/norms"), spark.read.parquet(f"{version}/ngrams"), F.lit(many)).write.parquet(f"{version}/postings")
    values = ("semantic-tfidf/v1", base["fingerprint"], base.get("last_event") or "none", built_at, str(many), "1")
    metadata = dict(zip(METADATA, values, strict=True))
    spark.createDataFrame(list(metadata.items()), "key string, value string").coalesce(1).write.parquet(f"{version}/semantic_metadata")
    index = _read(spark, version)
    broken = index.broken(invariants=True)
    if broken:
        raise SemanticError(CORRUPT, broken)
    spark.createDataFrame([(json.dumps({"version": version}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/current")
    return metadata


@dataclass
class SemanticIndex:
    tables: dict[str, DataFrame]
    metadata: dict[str, str]

    def broken(self, invariants: bool) -> str | None:
        """The first thing wrong with the metadata, the columns, and the rows by themselves (or, after those, with what holds them against the documents)."""
        if self.metadata.keys() != METADATA.keys():
            return f"metadata: {sorted(self.metadata.keys() ^ METADATA.keys())}"
        odd = next((k for k, form in METADATA.items() if not re.fullmatch(form, self.metadata[k] or "")), None)
        if odd:
            return f"{odd}: {self.metadata[odd]!r}"
        lacking = next((f"{n}: {sorted(set(columns) ^ set(self.tables[n].columns))}" for n, columns in TABLES.items() if n not in self.tables or set(columns) != set(self.tables[n].columns)), None)
        if lacking:
            return lacking
        t = self.tables
        rules = semantic.structure_rules(t["terms"], t["ngrams"]) | (semantic.invariant_rules(t["terms"], t["ngrams"], t["documents"], self.metadata) if invariants else {})
        row = semantic.failed(rules).orderBy("rule").first()
        return f"{row['rule']}: {row['n']} rows" if row else None

    def rank(self, queries: DataFrame, k: int = 50) -> DataFrame:
        """The k best documents of each query (query_id and a normalised text), as semantic.rank() gives them; only blocks of postings that can hold one are read."""
        return pruned.Search(self.tables, queries, k).rank()


def _read(spark: SparkSession, version: str) -> SemanticIndex:
    pairs = {r["key"]: r["value"] for r in spark.read.parquet(f"{version}/semantic_metadata").collect()}
    return SemanticIndex({n: spark.read.parquet(f"{version}/{n}") for n in TABLES}, pairs)


def open_index(spark: SparkSession, target: str, base: dict) -> SemanticIndex:
    """The index that target points to. In this order: none or an unfinished one is NOT_BUILT, one whose tables break a rule of their own CORRUPT, one that doesn't
    stand for the tree's index as it is (base), or whose own index isn't fresh, STALE, and one that doesn't fit its documents CORRUPT."""
    try:
        version = json.loads(spark.read.text(f"{target}/current").first()[0])["version"]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SemanticError(NOT_BUILT, target) from None
        raise
    try:
        index = _read(spark, version)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise SemanticError(CORRUPT, "a table is missing") from None
        raise
    if broken := index.broken(invariants=False):
        raise SemanticError(CORRUPT, broken)
    m = index.metadata
    if not is_fresh(base) or m["source_scan_fingerprint"] != base.get("fingerprint") or m["source_last_event_id"] != (base.get("last_event") or "none"):
        raise SemanticError(STALE, "the tree's index is another one or isn't fresh")
    t = index.tables
    row = semantic.failed(semantic.invariant_rules(t["terms"], t["ngrams"], t["documents"], m)).first()
    if row:
        raise SemanticError(CORRUPT, f"{row['rule']}: {row['n']} rows")
    return index
