"""A kept tree of digests: one changed file costs its own content and its folders, however large the tree is.

A folder's digest is taken over sums of hashes of its entries (name, kind and digest), so entries may come and go in any order and a
change is a subtraction and an addition: no entry that stays is read again, and a folder with very many entries is no hot group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept

#: Sums of a folder: four of 60 bits of an entry's hash each.
SUMS = ("s0", "s1", "s2", "s3")
COLUMNS = ["path", "kind", "size", "mtime", "digest", "n", *SUMS]
ROOT = ""


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _parts(name: Column, kind: Column, digest: Column) -> list[Column]:
    h = F.sha2(F.concat_ws("\x00", kind, digest, name), 256)
    return [F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]


def _digest() -> Column:
    return F.sha2(F.concat_ws(",", "n", *SUMS), 256)


def _deltas(entries: DataFrame) -> DataFrame:
    """(path of the folder, n and sums to add) from entries path, kind, was and now: digests before and after, null where there is none."""
    was, now = (_parts(_name(F.col("path")), F.col("kind"), F.col(c)) for c in ("was", "now"))
    zero = F.lit(0).cast("decimal(38,0)")
    sums = [(F.when(F.col("now").isNotNull(), b).otherwise(zero) - F.when(F.col("was").isNotNull(), a).otherwise(zero)).alias(s) for s, a, b in zip(SUMS, was, now, strict=True)]
    change = entries.select(_parent(F.col("path")).alias("path"), (F.col("now").isNotNull().cast("long") - F.col("was").isNotNull().cast("long")).alias("n"), *sums)
    return change.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("n", *SUMS)])


def build(files: DataFrame) -> DataFrame:
    """Nodes (path, kind, size, mtime, digest, n, sums) of files (path, size, mtime, digest) and of all folders above them; the root is the empty path and always there."""
    empty = files.sparkSession.createDataFrame([(ROOT, "folder")], "path string, kind string")
    empty = empty.select("path", "kind", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("n"), *[F.lit(0).cast("decimal(38,0)").alias(s) for s in SUMS])
    return _applied(empty.withColumn("digest", _digest()), files.select("path", "size", "mtime", F.lit(None).cast("string").alias("was"), F.col("digest").alias("now")))


def touched(nodes: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, size, mtime, was, gone): files of a listing (path, size, mtime) that are new or whose size or time differs, and files that are gone."""
    old = nodes.where("kind = 'file'").select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("digest").alias("was"))
    both = listing.select("path", "size", "mtime").join(old, F.col("path") == F.col("_p"), "full")
    differs = F.col("path").isNull() | F.col("_p").isNull() | ~F.col("size").eqNullSafe(F.col("_s")) | ~F.col("mtime").eqNullSafe(F.col("_m"))
    return both.where(differs).select(F.coalesce("path", "_p").alias("path"), "size", "mtime", "was", F.col("path").isNull().alias("gone"))


def update(nodes: DataFrame, listing: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes after what a listing says has changed. read gives (path, digest) of the files that it gets (path), which are those touched and no others."""
    seen = kept(touched(nodes, listing))
    digests = read(seen.where("not gone").select("path")).select(F.col("path").alias("_p"), F.col("digest").alias("now"))
    changes = seen.join(digests, F.col("path") == F.col("_p"), "left").select("path", "size", "mtime", "was", F.when(~F.col("gone"), F.col("now")).alias("now"))
    return _applied(nodes, changes)


def _applied(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes after changes of files (path, size, mtime, was, now), folders from the deepest up; only ancestors of changed files are looked at."""
    changes = kept(changes)
    nodes = kept(nodes)
    files = changes.where("now is not null").select("path", F.lit("file").alias("kind"), "size", "mtime", F.col("now").alias("digest"), F.lit(None).cast("long").alias("n"), *[F.lit(None).cast("decimal(38,0)").alias(s) for s in SUMS])
    depth = F.size(F.split("path", "/"))
    deepest = changes.agg(F.max(depth)).first()[0] or 0
    rising = changes.where("was is distinct from now").select("path", F.lit("file").alias("kind"), "was", "now")
    folders = nodes.where("kind = 'folder'")
    done, gone = [files], [changes.select("path")]
    for level in range(deepest - 1, -1, -1):  # folders with so many names in their path
        here = depth == level if level else F.col("path") == ROOT
        delta = _deltas(rising.where(_level(F.col("path")) == level + 1))
        old = folders.where(here & (F.col("path") != ROOT) if level else here).select("path", F.col("digest").alias("was"), F.col("n").alias("_n"), *[F.col(s).alias(f"_{s}") for s in SUMS])
        new = delta.join(old, "path", "left")
        added = [(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).cast("long" if c == "n" else "decimal(38,0)").alias(c) for c in ("n", *SUMS)]
        new = kept(new.select("path", F.lit("folder").alias("kind"), "was", *added).withColumn("now", F.when((F.col("n") > 0) | (F.col("path") == ROOT), _digest())))
        done.append(new.where("now is not null").select("path", "kind", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime"), F.col("now").alias("digest"), "n", *SUMS))
        gone.append(new.select("path"))
        rising = rising.where(_level(F.col("path")) <= level).unionByName(new.where("path <> ''").select("path", "kind", "was", "now")) if level else rising
    rest = nodes.select(*COLUMNS).join(reduce(DataFrame.unionByName, gone).distinct(), "path", "left_anti")
    return kept(reduce(DataFrame.unionByName, [rest, *[d.select(*COLUMNS) for d in done]]))


def _level(path: Column) -> Column:
    """How many names a path has."""
    return F.size(F.split(path, "/"))


def root(nodes: DataFrame) -> str:
    """The digest of the whole tree."""
    return nodes.where((F.col("path") == ROOT) & (F.col("kind") == "folder")).first()["digest"]


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind, state): added, removed or changed nodes."""
    a = before.select("path", "kind", F.col("digest").alias("a"))
    b = after.select("path", "kind", F.col("digest").alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, ["path", "kind"], "full").select("path", "kind", state.alias("state")).where("state is not null")


def gate(nodes: DataFrame, listing: DataFrame, read: Callable[[DataFrame], DataFrame]) -> dict:
    """What an answer's freshness rests on: whether the tree is still the kept one. Only files whose size or time differs are read; if none does, nothing is."""
    if touched(nodes, listing).isEmpty():
        return {"complete": True, "drift": False, "fingerprint": f"sha256:{root(nodes)}"}
    now = update(nodes, listing, read)
    return {"complete": True, "drift": root(now) != root(nodes), "fingerprint": f"sha256:{root(now)}"}
