"""Questions for many keys in one job, on small tables by brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import sums
from quarrystone.operators import graph, history, substring


def test_lineage_follows_pointers(spark):
    rows = []
    n = 100_000
    order = list(range(n))
    random.Random(1).shuffle(order)
    rows += [("long", f"x{order[k]}", f"x{order[k - 1]}" if k else None) for k in range(n)]
    rows += [("gap", "v9", None), ("gap", "v2", "v9"), ("gap", "v40", "v2"), ("one", "a", "elsewhere"), ("fork", "a", None), ("fork", "b", "a"), ("fork", "c", "a")]
    rows += [("two", "a", None), ("two", "b", None), ("ring", "a", "c"), ("ring", "b", "a"), ("ring", "c", "b"), ("both", "r", None), ("both", "s", "r"), ("both", "x", "y"), ("both", "y", "x")]
    rows += [("self", "a", "a"), ("twice", "a", None), ("twice", "b", "a"), ("twice", "b", "a")]
    got = graph.lineage_by_pointers(spark.createDataFrame(rows, "entity_id string, version_ref string, previous string")).collect()
    place = {(r["entity_id"], r["version_ref"]): (r["place"], r["condition"]) for r in got}
    assert len(got) == len(rows)
    assert all(place["long", f"x{order[k]}"] == (k, None) for k in range(n))
    assert [place["gap", v][0] for v in ("v9", "v2", "v40")] == [0, 1, 2] and place["one", "a"] == (0, None)
    assert {e for (e, _), (p, c) in place.items() if c} == {"fork", "two", "ring", "both", "self", "twice"} and all((p is None) == (c is not None) for p, c in place.values())
    assert graph.lineage_by_pointers(spark.createDataFrame([], "entity_id string, version_ref string, previous string")).count() == 0


def test_lifetimes_at_times(spark):
    rng = random.Random(2)
    day = lambda k: f"{1600 + k // 336:04d}-{k // 28 % 12 + 1:02d}-{k % 28 + 1:02d}"
    spans = []
    for k in range(300):
        a = rng.randrange(140_000)
        spans.append((k, day(a), rng.choice([None, day(a), day(a + 1), day(a + rng.randrange(1, 400)), day(a + rng.randrange(1, 100_000))])))
    spans += [(900, None, day(5)), (901, day(9), day(3)), (902, "1500-01-01", None), (903, day(0), day(1))]
    times = [day(rng.randrange(250_000)) for _ in range(200)] + [day(0), None]
    s = spark.createDataFrame(spans, "k long, a string, b string").select("k", F.to_date("a").alias("starts"), F.to_date("b").alias("ends"))
    t = spark.createDataFrame([(x,) for x in times], "t string").select(F.to_date("t").alias("as_of"))
    got = sorted((r["k"], str(r["as_of"])) for r in history.alive(s, t).collect())
    want = sorted((k, x) for k, a, b in spans for x in {t for t in times if t} if a is not None and a <= x and (b is None or x < b))
    assert got == want and want


def test_graphs_are_compared_at_once(spark):
    a = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, "y", "z"), (3, "a", "b"), (3, "a", "b"), (4, "p", "q")], "g int, s string, t string")
    b = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "z", "z"), (3, "b", "a"), (5, "n", "m")], "g int, t string, s string")
    got = {tuple(r) for r in graph.same_graphs(a, b, ["g"]).collect()}
    assert got == {(1, True, 0, 0), (2, False, 1, 1), (3, False, 0, 1), (4, False, 0, 1), (5, False, 1, 0)}
    one, other = (graph.fingerprints(spark.createDataFrame(r, "g int, s string, t string"), ["g"]).first()["fingerprint"] for r in ([(1, "ab", "c")], [(1, "a", "bc")]))
    assert one != other


def test_sums_are_exact(spark):
    rng = random.Random(3)
    groups = {
        "mixed": [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(400)], "cancel": [1e308, 1.0, -1e308, 1e-320, 5e-324], "tiny": [5e-324] * 3, "large": [1.7e308, 1.7e308],
        "same": [0.1] * 1000, "none": [None, None], "zero": [0.0, -0.0], "inf": [math.inf, 1.0], "nan": [math.inf, -math.inf], "powers": [2.0**k for k in range(-1074, 1023, 7)] + [-(2.0**k) for k in range(-1070, 1020, 11)],
    }
    groups |= {f"r{k}": [rng.gauss(0, 1) * 2.0 ** rng.randrange(-60, 60) for _ in range(50)] for k in range(50)}
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    rng.shuffle(rows)
    got = {r["g"]: r["total"] for r in sums.exact(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x").collect()}
    for g, xs in groups.items():
        if g == "none":
            assert g not in got or got[g] is None
        elif g == "large":
            assert got[g] == math.inf
        elif g == "nan":
            assert math.isnan(got[g])
        else:
            assert got[g] == math.fsum(xs), g
    steady = [(k % 20, rng.choice([1, -1]) * rng.uniform(1, 2) * 2.0 ** rng.randrange(-28, 39)) for k in range(4000)]
    fixed = {r["g"]: r["t"] for r in spark.createDataFrame(steady, "g int, x double").repartition(3).groupBy("g").agg(sums.fixed(F.col("x")).alias("t")).collect()}
    assert fixed == {g: math.fsum(x for k, x in steady if k == g) for g in range(20)}


def test_needles_are_found_by_their_triples(spark):
    texts = ["The Cat sat", "cat", "ca", "c", "", None, "äöü ÄÖÜ", "a.c", "abc\nabd", "😀😀x", "aaa", "xx\x00yy"]
    docs = spark.createDataFrame([(f"d{k}", f"p/{k}", t) for k, t in enumerate(texts)], "id string, path string, text string")
    needles = ["cat", "CAT", "a", "at", "", "zzz", "öü ", "a.c", "c\na", "😀😀", "D1", "p/1", "aaaa", "aaa", "%", "ca", "\x00", None]
    index = substring.build(docs, ["id", "path", "text"])
    got = substring.search(docs, spark.createDataFrame([(n,) for n in needles], "needle string"), index, {"id": "id", "path": "path", "text": "content"})
    want = set()
    for n in needles:
        for k, t in enumerate(texts):
            for where, value in (("id", f"d{k}"), ("path", f"p/{k}"), ("content", t)):
                if n is not None and value is not None and n.lower() in value.lower():
                    want.add((n, f"d{k}", where))
                    break
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("n", [0])
def test_no_documents(spark, n):
    docs = spark.createDataFrame([], "id string, path string, text string")
    index = substring.build(docs, ["id", "text"])
    assert substring.search(docs, spark.createDataFrame([("a",), ("",), ("abc",)], "needle string"), index, {"id": "id", "text": "content"}).count() == 0


def test_fixed_sums_of_any_number_of_rows(spark):
    rng = random.Random(4)
    half = [2.0**39] * 64 + [2.0**-20, 2.0**-28]  # the last bits lie beside a half
    groups = {"much": [2.0**39 + rng.randrange(1 << 20) for _ in range(3000)], "less": [-(2.0**39) - rng.random() for _ in range(3000)], "half": half, "under": [-x for x in half], "ties": [2.0**39] * 65 + [2.0**-28] * 3}
    groups |= {f"r{k}": [rng.choice([1, -1]) * rng.uniform(1, 2) * 2.0 ** rng.randrange(20, 39) for _ in range(200)] for k in range(20)}
    groups |= {f"s{k}": [2.0**39] * 128 + [2.0 ** -(8 + k), 2.0**-28, -(2.0**-27)] for k in range(10)}
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    got = {r["g"]: r["t"] for r in spark.createDataFrame(rows, "g string, x double").repartition(3).groupBy("g").agg(sums.fixed(F.col("x")).alias("t")).collect()}
    assert got == {g: math.fsum(xs) for g, xs in groups.items()}


def test_lifetimes_are_not_shuffled_for_few_times(spark):
    spans = spark.range(3_000_000).where("id < 1000").selectExpr("id as k", "date_add(date'2000-01-01', cast(id as int)) as starts", "date_add(date'2000-01-01', cast(id * 2 as int)) as ends")
    times = spark.range(3_000_000).selectExpr("date_add(date'2000-02-01', cast(id % 40 as int)) as as_of")
    out = history.alive(spans, times)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # before, times had the estimate of the table they came from, and so many spans as a lifetime has were shuffled
    assert out.count() == sum(k <= d + 31 < 2 * k for k in range(1000) for d in range(40))


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_needles_are_found_in_one_pass_without_a_shuffle(spark, monkeypatch, size):
    monkeypatch.setattr(substring, "PASS", size)  # a needle or so a pass, or all in one
    texts = ["The Cat sat", "cat", "ca", "", None, "äöü ÄÖÜ", "a.c", "abc\nabd", "😀😀x", "xx\x00yy", "İstanbul ΣΑΣ"]
    docs = spark.createDataFrame([(f"d{k}", f"p/{k}", t) for k, t in enumerate(texts)], "id string, path string, text string")
    needles = ["cat", "CAT", "cAt", "a", "", "zzz", "öü ", "a.c", "c\na", "😀😀", "D1", "p/1", "%", "ca", "\x00", "İST", "σας", None, "cat"]
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    columns = {"id": "id", "path": "path", "text": "content"}
    got = substring.passes(docs, asked, columns)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # search() shuffles every triple, and the texts to verify them
    want = substring.search(docs, asked.distinct(), substring.build(docs, list(columns)), columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
