"""Linked lists of any length: shortened by splicing nodes out, no two of them neighbours, until few are left; what was spliced out is then answered by a neighbour.

Doubling moves every node in each of its rounds, as many as the logarithm of the longest list. Here a round takes away about a third of the nodes, so all rounds
together move a few times the nodes that there are, however long a list is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import written

#: So few nodes are left as they are: doubling takes them in fewer jobs.
FEW = 200_000


def shorten(rows: DataFrame, by: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """(what is left, tables of what was spliced out, a round each) of rows (by, node, up, down, up_in, down_in, w), each node once in its lists (by).

    up_in and down_in tell whether up and down are nodes of the list themselves; w is the distance from up. A node goes if its hash of the round is less
    than those of its neighbours, which thus stay and take over its own neighbours; a ring ends as a node that is its own, and that goes at last.
    """
    gone, c = [], F.col
    while rows.count() > FEW:
        h = lambda name, k=len(gone): F.xxhash64(F.lit(k), c(name))
        own = c("up_in") & (c("up") == c("node"))
        low = (~c("up_in") | (h("node") < h("up"))) & (~c("down_in") | (h("node") < h("down")))
        rows = rows.withColumn("_own", own).withColumn("_gone", own | low)
        gone.append(rows.where("_gone").drop("_own", "_gone"))
        end = lambda side, rank, name: F.struct(F.lit(rank).alias("rank"), c(name).alias("at"), c(f"{name}_in").alias("within")).alias(side)
        none = lambda side: F.lit(None).cast(f"struct<rank:int,at:{rows.schema['node'].dataType.simpleString()},within:boolean>").alias(side)
        stays = F.when(~c("_gone"), F.struct("node", end("u", 0, "up"), end("d", 0, "down"), "w"))
        above = F.when(c("_gone") & ~c("_own") & c("up_in"), F.struct(c("up").alias("node"), none("u"), end("d", 1, "down"), F.lit(0).cast("long").alias("w")))
        below = F.when(c("_gone") & ~c("_own") & c("down_in"), F.struct(c("down").alias("node"), end("u", 1, "up"), none("d"), "w"))
        sent = rows.select(*by, F.inline(F.array_compact(F.array(stays, above, below))))
        met = sent.repartition(*by, "node").groupBy(*by, "node").agg(F.max("u").alias("u"), F.max("d").alias("d"), F.sum("w").alias("w"))
        rows = written(met.select(*by, "node", c("u.at").alias("up"), c("d.at").alias("down"), c("u.within").alias("up_in"), c("d.within").alias("down_in"), "w"))
    return rows, gone


def answer(left: DataFrame, gone: list[DataFrame], by: list[str], first: Callable[[DataFrame], DataFrame], beside: Callable[[DataFrame], DataFrame], down: bool = False) -> DataFrame:
    """(by, node, ...) of all nodes whose list has an answer, from those of what is left.

    beside gives the answers of spliced rows joined with the answer of their neighbour: the upper one, or with down the lower one where just that is within.
    first gives those of the others: what had no such neighbour any longer, and rings. Rows whose neighbour has no answer have none.
    """
    held = F.col("up_in") | F.col("down_in") if down else F.col("up_in")
    asks = held & ~(F.col("up_in") & (F.col("up") == F.col("node")))
    for rows in reversed(gone):
        known = left.withColumnRenamed("node", "_at")
        joined = rows.where(asks).withColumn("_at", F.when(F.col("up_in"), F.col("up")).otherwise(F.col("down"))).join(known, [*by, "_at"])
        left = left.unionByName(written(first(rows.where(~asks)).unionByName(beside(joined))))
    return left
