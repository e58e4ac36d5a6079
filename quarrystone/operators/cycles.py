"""Strongly connected components of large sparse graphs: what lies on no cycle is raked off, chains are compressed to an edge, and only the core that is left is coloured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import written
from . import lists

#: Rounds of raking between compressions, and the share of edges that a round of both must take away, else the core is coloured.
RAKES, SHRINK = 2, 0.1


def _rake(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both an edge in and an edge out."""
    for _ in range(RAKES):
        edges = edges.join(edges.select(F.col("s").alias("k")).distinct(), F.col("t") == F.col("k"), "left_semi")
        edges = edges.join(edges.select(F.col("t").alias("k")).distinct(), F.col("s") == F.col("k"), "left_semi")
    return written(edges)


def _compress(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges with each chain as one edge, chain members: node, p, e, rings: node, component) of edges without loops, repeated or not.

    A node with at most one neighbour before and one behind is a link. Links are spliced out until few are left, and those are ranked by doubling. A chain that
    begins or ends nowhere lies on no cycle and is left out. Links that lead to no end go round: a ring is a component, named by its least node.
    """
    c, none = F.col, F.lit(None).cast("string")
    sides = edges.select(F.inline(F.array(F.struct(c("s").alias("node"), none.alias("i"), c("t").alias("o")), F.struct(c("t").alias("node"), c("s").alias("i"), none.alias("o")))))
    ends = sides.repartition("node").groupBy("node").agg(F.min("i").alias("p"), F.max("i").alias("p2"), F.min("o").alias("next"), F.max("o").alias("next2"))
    nodes = written(ends.select("node", "p", "next", (F.coalesce(c("p") != c("p2"), F.lit(False)) | F.coalesce(c("next") != c("next2"), F.lit(False))).alias("crossing")))
    crossing = written(nodes.where("crossing").select(c("node").alias("k")))  # its own files tell how few they are
    links = nodes.where("not crossing").join(crossing.withColumnRenamed("k", "kp"), c("p") == c("kp"), "left").join(crossing.withColumnRenamed("k", "kn"), c("next") == c("kn"), "left")
    within = lambda x, k: c(x).isNotNull() & c(k).isNull()
    links = written(links.select("node", c("p").alias("up"), c("next").alias("down"), within("p", "kp").alias("up_in"), within("next", "kn").alias("down_in"), F.lit(0).cast("long").alias("w")))
    left, gone = lists.shorten(links, [])
    both = left.select("node", F.inline(F.array(F.struct(F.lit(False).alias("back"), c("down").alias("at"), (~c("down_in")).alias("done")), F.struct(F.lit(True).alias("back"), c("up").alias("at"), (~c("up_in")).alias("done")))))
    pointers = written(both.withColumns({"least": c("node"), "moved": F.lit(True)}))
    while not pointers.where("moved").isEmpty():  # a round that ends no pointer and finds no ring a lesser node is the last
        far = pointers.select(F.col("node").alias("k"), F.col("back").alias("b"), F.col("at").alias("at2"), F.col("done").alias("done2"), F.col("least").alias("least2"))
        leapt = pointers.join(far, ~F.col("done") & (F.col("at") == F.col("k")) & (F.col("back") == F.col("b")), "left")
        end, least = F.coalesce("done2", "done"), F.least("least", "least2")
        at = F.when(F.col("k").isNull(), F.col("at")).otherwise(F.col("at2"))
        pointers = written(leapt.select("node", "back", at.alias("at"), end.alias("done"), least.alias("least"), ((end != F.col("done")) | (~end & (least != F.col("least")))).alias("moved")))
    round_ = pointers.where("not done and not back").select("node", none.alias("p"), none.alias("e"), F.col("least").alias("ring"))
    ended = pointers.where("done").groupBy("node").agg(F.max(F.when(F.col("back"), F.col("at"))).alias("p"), F.max(F.when(~F.col("back"), F.col("at"))).alias("e"))
    known = written(round_.unionByName(ended.where("p is not null and e is not null").withColumn("ring", none)))
    own = F.when(F.col("up_in"), F.col("node"))
    first = lambda rows: rows.where("up is not null and down is not null").select("node", F.when(own.isNull(), F.col("up")).alias("p"), F.when(own.isNull(), F.col("down")).alias("e"), own.alias("ring"))
    known = lists.answer(known, gone, [], first, lambda rows: rows.select("node", "p", "e", "ring"), down=True)
    chains, rings = known.where("ring is null").select("node", "p", "e"), known.where("ring is not null").select("node", "ring")
    names = rings.groupBy("ring").agg(F.min("node").alias("component"))
    rest = edges.join(crossing, F.col("s") == F.col("k"), "left_semi").join(crossing, F.col("t") == F.col("k"), "left_semi")
    return written(rest.unionByName(chains.select(F.col("p").alias("s"), F.col("e").alias("t"))).distinct()), chains, rings.join(names, "ring").select("node", "component")


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, component) of a core: each node takes the greatest node that leads to it; those of a colour that lead back to that one are its component, and the rest is coloured again."""
    out = []
    while not edges.isEmpty():
        nodes = edges.select(F.col("s").alias("node")).union(edges.select(F.col("t"))).distinct()
        colour = written(nodes.withColumn("c", F.col("node")))
        while True:
            came = edges.join(colour, F.col("s") == F.col("node")).groupBy(F.col("t").alias("node")).agg(F.max("c").alias("more"))
            new = written(colour.join(came, "node", "left").select("node", F.greatest("c", "more").alias("c"), (F.col("more") > F.col("c")).alias("moved")))
            colour, moved = new.select("node", "c"), not new.where("moved").isEmpty()
            if not moved:
                break
        a, b = colour.select(F.col("node").alias("s"), F.col("c").alias("cs")), colour.select(F.col("node").alias("t"), F.col("c").alias("ct"))
        within = written(edges.join(a, "s").join(b, "t").where("cs = ct").select("s", "t", F.col("cs").alias("c")))
        found = frontier = written(colour.where("node = c").select("node", "c"))
        while True:
            back = within.join(frontier.select(F.col("node").alias("t")), "t").select(F.col("s").alias("node"), "c").distinct()
            frontier = written(back.join(found, "node", "left_anti"))
            if frontier.isEmpty():
                break
            found = written(found.unionByName(frontier))
        out.append(found)
        gone = found.select(F.col("node").alias("k"))
        edges = _rake(edges.join(gone, F.col("s") == F.col("k"), "left_anti").join(gone, F.col("t") == F.col("k"), "left_anti"))
    if not out:
        return edges.select(F.col("s").alias("node"), F.col("t").alias("component"))
    every = reduce(DataFrame.unionByName, out)
    names = every.groupBy("c").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")  # a node alone lies between cycles, on none
    return written(every.join(names, "c").select("node", "component"))


def components(edges: DataFrame, source: str = "source_ref", target: str = "target_ref") -> DataFrame:
    """(ref, component): just the nodes that lie on a cycle, with the least node of their strongly connected component. Nulls are no nodes; repeated edges count once.

    Rounds: chains and trees take the logarithm of their length, as they are compressed and raked in turn, and a chain's rounds shrink by a third; what is left, where cycles cross, takes as many as its own diameter.
    """
    edges = written(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null"))
    loops, rings, chains = [], [], []
    many = edges.count()
    while True:
        loops.append(edges.where("s = t").select(F.col("s").alias("node")))
        edges, chain, ring = _compress(edges.where("s <> t"))
        loops.append(edges.where("s = t").select(F.col("s").alias("node")))
        edges = _rake(edges.where("s <> t"))
        chains.append(chain)
        rings.append(ring)
        before, many = many, edges.count()
        if not many or many > (1 - SHRINK) * before:
            break
    found = _coloured(edges).select("node", "component")
    looped = written(reduce(DataFrame.unionByName, loops).distinct())
    known = written(found.unionByName(reduce(DataFrame.unionByName, rings)))

    def alone() -> DataFrame:
        met = known.join(looped.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_semi").select("node")
        return looped.join(met, "node", "left_anti").select("node", F.col("node").alias("component"))

    for chain in reversed(chains):  # a link is of its ends' component, if they are of one
        pairs = written(chain.select("p", "e").distinct())
        full = known.unionByName(alone())
        of = full.select(F.col("node").alias("p"), F.col("component").alias("cp")).join(pairs, "p")
        of = written(full.select(F.col("node").alias("e"), F.col("component").alias("ce")).join(of, "e").where("cp = ce").select("p", "e", F.col("cp").alias("component")))
        known = known.unionByName(written(chain.join(of, ["p", "e"]).select("node", "component")))
    every = known.unionByName(alone())
    names = every.groupBy("component").agg(F.min("node").alias("least"))
    return every.join(names, "component").select(F.col("node").alias("ref"), F.col("least").alias("component"))
