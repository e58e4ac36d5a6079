"""A kept tree of digests against trees built anew, and what is read for a change."""

import random

from pyspark.sql import functions as F

from quarrystone.sources import merkle

KIND = "path string, size long, mtime long, digest string"


def rows(df):
    return {(r["path"], r["kind"]): (r["size"], r["mtime"], r["digest"], r["n"]) for r in df.collect()}


def test_updates_equal_trees_built_anew(spark):
    rng = random.Random(1)
    files = {f"{rng.choice(['a', 'b', 'a/x', 'a/x/y/z', 'é'])}/f{k}": [10, 1, f"h{k}"] for k in range(80)} | {"top": [1, 1, "t"], "only/one/file": [1, 1, "o"]}
    table = lambda: spark.createDataFrame([(p, *v) for p, v in files.items()], KIND)
    nodes = merkle.build(table())
    assert merkle.root(merkle.build(table().limit(0))) != merkle.root(nodes)
    for turn in range(2):
        names = sorted(files)
        del files[names[turn]]
        files.pop("only/one/file", None)
        files[names[10 + turn]] = [11, 2 + turn, "new"]
        files[names[20]][1] += 1  # touched, its content the same
        files[f"fresh/{turn}/deep/er"] = [5, 5, f"n{turn}"]
        read = []

        def reader(paths, read=read):
            read += [r["path"] for r in paths.collect()]
            return table().join(paths, "path", "left_semi").select("path", "digest")

        before = nodes
        nodes = merkle.update(nodes, table().select("path", "size", "mtime"), reader)
        assert rows(nodes) == rows(merkle.build(table()))
        assert sorted(read) == sorted({names[10 + turn], names[20], f"fresh/{turn}/deep/er"})
        state = {(r["path"], r["kind"]): r["state"] for r in merkle.compare(before, nodes).collect()}
        assert state["", "folder"] == "changed" and state[names[10 + turn], "file"] == "changed" and (names[20], "file") not in state
        if turn == 0:
            assert state["only", "folder"] == state["only/one", "folder"] == state["only/one/file", "file"] == "removed"


def test_gate_reads_only_what_may_have_changed(spark):
    files = spark.range(3000).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/e"), F.col("id") % 50, F.lit("/"), "id").alias("path"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    nodes = merkle.build(files)
    read = []

    def reader(paths):
        read.extend(r["path"] for r in paths.collect())
        return files.join(paths, "path").select("path", F.when(F.col("path").endswith("/8"), "other").otherwise(F.col("digest")).alias("digest"))

    assert merkle.gate(nodes, files, reader)["drift"] is False and read == []
    touch = lambda name: files.withColumn("mtime", F.when(F.col("path").endswith(name), 2).otherwise(F.col("mtime")).cast("long"))
    same = merkle.gate(nodes, touch("/7"), reader)
    assert same["drift"] is False and same["fingerprint"] == "sha256:" + merkle.root(nodes) and read == ["d0/e7/7"]
    now = merkle.gate(nodes, touch("/8"), reader)
    assert now["drift"] is True and read == ["d0/e7/7", "d1/e8/8"]
    changed = merkle.compare(nodes, merkle.update(nodes, touch("/8"), reader)).collect()
    assert sorted(r["path"] for r in changed) == ["", "d1", "d1/e8", "d1/e8/8"]
