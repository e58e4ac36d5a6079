"""Strongly connected components against reachability by brute force."""

import random

from quarrystone.operators import cycles


def brute(edges):
    out = {}
    for s, t in edges:
        if s is not None and t is not None:
            out.setdefault(s, set()).add(t)
    reach = {}
    for n in out:
        seen, stack = set(), list(out[n])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += out.get(x, ())
        reach[n] = seen
    return {n: min(m for m in reach[n] if n in reach.get(m, ())) for n in reach if n in reach[n]}


def found(spark, edges):
    rows = cycles.components(spark.createDataFrame(edges, "source_ref string, target_ref string")).collect()
    got = {r["ref"]: r["component"] for r in rows}
    assert len(rows) == len(got)
    return got


def test_random_graphs(spark):
    rng = random.Random(5)
    edges = []
    for g in range(40):  # many graphs at once, each of its own nodes
        n = rng.randrange(2, 14)
        edges += [(f"g{g}n{rng.randrange(n):02d}", f"g{g}n{rng.randrange(n):02d}") for _ in range(rng.randrange(1, 2 * n))]
    edges += [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "x"), ("y", "x"), ("x", "z"), (None, "a"), ("a", None), ("p", "q"), ("p", "q")]
    assert found(spark, edges) == brute(edges)


def test_chains_meet_their_ends(spark):
    ring = [(f"r{k:02d}", f"r{(k + 1) % 20:02d}") for k in range(20)]
    chord = [("r03", "c1"), ("c1", "c2"), ("c2", "r09"), ("r05", "d1"), ("d1", "d2"), ("r07", "e1"), ("e1", "e2"), ("e2", "r07")]
    edges = ring + chord + [("t1", "t2"), ("t2", "r00"), ("d2", "u1")]
    assert found(spark, edges) == brute(edges)
    assert cycles.components(spark.createDataFrame([], "source_ref string, target_ref string")).count() == 0


def test_a_long_path_and_a_long_ring(spark):
    n = 100_000
    path = spark.range(n).selectExpr("format_string('n%06d', id) as source_ref", "format_string('n%06d', id + 1) as target_ref")
    ring = spark.range(n // 2).selectExpr("format_string('r%06d', id) as source_ref", f"format_string('r%06d', (id + 1) % {n // 2}) as target_ref")
    got = cycles.components(path.unionByName(ring).unionByName(spark.createDataFrame([("up", "r000000"), ("r000007", "n000000")], path.schema)))
    assert got.count() == n // 2 and {tuple(r) for r in got.select("component").distinct().collect()} == {("r000000",)}
