"""Long lists are spliced, so rounds move fewer and fewer rows; answers are the same as by doubling."""

import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import graph, lists

from .test_cycles import brute, found


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(lists, "FEW", 5)


def test_rounds_shrink(spark, few):
    n = 20_000
    rows = spark.range(n).select(*[F.format_string("%05d", k).alias(a) for k, a in ((F.col("id"), "node"), (F.col("id") - 1, "up"), (F.col("id") + 1, "down"))], (F.col("id") > 0).alias("up_in"), (F.col("id") < n - 1).alias("down_in"), F.lit(1).cast("long").alias("w"))
    left, gone = lists.shorten(rows, [])
    sizes = [g.count() for g in gone]
    assert left.count() <= 5 and sum(sizes) + left.count() == n
    assert all(sum(sizes[k + 6 :]) < n / 4 for k in range(1)) and sum(sum(sizes[k:]) for k in range(len(sizes))) < 4 * n  # before, each round moved all


def test_spliced_graphs(spark, few):
    rng = random.Random(7)
    edges = []
    for g in range(12):
        n = rng.randrange(2, 12)
        edges += [(f"g{g}n{rng.randrange(n):02d}", f"g{g}n{rng.randrange(n):02d}") for _ in range(rng.randrange(1, 2 * n))]
    edges += [(f"r{k:02d}", f"r{(k + 1) % 20:02d}") for k in range(20)] + [("r03", "c1"), ("c1", "c2"), ("c2", "r09"), ("t1", "t2"), ("t2", "r00"), ("r05", "u1"), ("u1", "u2")]
    edges += [(f"s{k:02d}", f"s{(k + 1) % 30:02d}") for k in range(30)] + [(f"q{k:02d}", f"q{k + 1:02d}") for k in range(30)] + [("q00", "q01"), ("o", "o"), ("o", "o1"), ("o1", "o"), ("w1", "w2"), ("w2", "w1")]
    assert found(spark, edges) == brute(edges)


def test_a_node_between_cycles_is_on_none(spark):
    four = [(f"{g}{a}", f"{g}{b}") for g in "ac" for a in range(4) for b in range(4) if a != b]
    edges = four + [("a0", "z"), ("a1", "z"), ("z", "c0"), ("z", "c1")]
    assert found(spark, edges) == brute(edges)


def test_spliced_lineage(spark, few, monkeypatch):
    spliced, real = [], lists.shorten
    monkeypatch.setattr(lists, "shorten", lambda rows, by: spliced.append(real(rows, by)) or spliced[-1])
    order = list(range(300))
    random.Random(3).shuffle(order)
    rows = [("long", f"x{order[k]}", f"x{order[k - 1]}" if k else None) for k in range(300)]
    rows += [("both", "r", None), ("both", "s", "r"), ("two", "a", None), ("two", "b", None)] + [("both", f"x{k}", f"x{(k + 1) % 9}") for k in range(9)]
    got = graph.lineage_by_pointers(spark.createDataFrame(rows, "entity_id string, version_ref string, previous string")).collect()
    place = {(r["entity_id"], r["version_ref"]): (r["place"], r["condition"]) for r in got}
    assert len(got) == len(rows) and all(place["long", f"x{order[k]}"] == (k, None) for k in range(300))
    assert all(v == (None, "AMBIGUOUS_VERSION") for (e, _), v in place.items() if e != "long")
    assert len(spliced[0][1]) > 3  # before, all were doubled
