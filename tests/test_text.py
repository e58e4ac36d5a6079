from pyspark.sql import functions as F

from quarrystone.functions import text as X
from quarrystone.operators import semantic


def _tokens(spark, *texts):
    df = X.normalised(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string"))
    return {r["id"]: r for r in df.select("id", X.tokens(F.col("norm")).alias("t"), X.grams(F.col("norm")).alias("g")).collect()}


def test_tokens(spark):
    got = _tokens(spark, "The cat_1 a Café x", "长上下文abc", "中", "", None, "Ｆｕｌｌ wide ﬁne ½", "我们的 a1")
    assert got[0]["t"] == ["cat_1", "caf"]  # an accented letter separates
    assert got[1]["t"] == ["长上", "上下", "下文", "abc"]
    assert got[2]["t"] == [] and got[2]["g"] == []
    assert got[3]["t"] == [] and (got[4]["t"] or []) == []
    assert got[5]["t"] == ["full", "wide", "fine"]  # the parts of 1/2 are too short
    assert got[6]["t"] == ["我们", "们的", "a1"]
    assert sorted(got[0]["g"]) == sorted({"th", "he", "the", "ca", "at", "t_", "_1", "cat", "at_", "t_1", "af", "caf"})


def test_casefold_is_not_lower(spark):
    df = spark.createDataFrame([("Straße",)], "t string")
    row = df.select(X.runs(F.col("t")).alias("r"), X.casefold("t").alias("c")).first()
    assert row["r"] == ["straße"] and row["c"] == "strasse"


def test_rank_orders_ties_by_id_and_drops_zeros(spark):
    docs = spark.createDataFrame([("b", "alpha beta"), ("a", "alpha beta"), ("c", "zzz qqq"), ("d", "")], "id string, norm string")
    asks = spark.createDataFrame([(1, "alpha"), (2, "the of"), (3, "")], "query_id int, text string")
    got = semantic.rank(docs, asks).collect()
    assert [(r["rank"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "a"), (2, "b")]
    assert {r["query_id"] for r in got} == {1}


def test_gram_ratios_equal_sets(spark):
    docs = spark.createDataFrame([("a", "alpha_1 béta 长上下文x"), ("b", ""), ("c", "上下 lph"), ("d", None)], "id string, norm string")
    q = spark.createDataFrame([(1, "alpha 上下文"), (2, "zz")], "query_id int, text string").select("query_id", X.grams(F.col("text")).alias("q_grams"))
    far = spark.createDataFrame([], "query_id int, id string, cosine double")  # no cosines: the score is the ratio's part
    got = {(r["query_id"], r["id"]): r["score_q"] for r in semantic.scored(docs, q, far, 9, "id", "norm").collect()}
    sets = {r["id"]: set(r["g"] or []) for r in docs.select("id", X.grams(F.col("norm")).alias("g")).collect()}
    want = {(r["query_id"], i): round(0.3 * (len(s & set(r["q_grams"])) / len(r["q_grams"])) * 1e9) for r in q.collect() for i, s in sets.items() if s & set(r["q_grams"])}
    assert got == want


def test_structure_faults(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "id string")
    terms = spark.createDataFrame([("a", "x1", 1.0), ("a", "x1", 1.0), ("z", "", -1.0)], "id string, term string, tf double")
    grams = spark.createDataFrame([("a", "abcd")], "id string, gram string")
    got = {r["rule"] for r in semantic.structure_faults(terms, grams, docs, {"corpus_size": 3}).collect()}
    assert got == {"term_empty", "tf_illegal", "term_repeated", "gram_length", "dangling", "count"}


def test_best_of_many_rows_with_ties():
    import numpy as np

    from quarrystone.operators.semantic import Best

    rng = np.random.default_rng(3)
    scores, keys = rng.integers(0, 6, (500, 7)), [f"k{n:03d}" for n in rng.permutation(500)]
    best = Best(20, 7)
    for k in range(0, 500, 64):
        best.add(keys[k : k + 64], scores[k : k + 64])
    for c in range(7):
        want = sorted(((-int(s), k) for s, k in zip(scores[:, c], keys, strict=True)))[:20]
        assert [(-int(best.scores[r, c]), best.keys[best.at[r, c]]) for r in range(20)] == want


def test_counts_are_those_of_tokens(spark):
    import random
    from collections import Counter

    from quarrystone.operators import semantic

    rng = random.Random(5)
    signs = "aAbz09_ .-\n\tÄßİK中文上一个了一é😀\x00"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", "the The a", "上一个 一个 了", "x" * 70_000, " ".join(f"w{k}" for k in range(90_000))]
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)] + [("none", None)], "id string, norm string")
    want = sorted((r["id"], w, n) for r in docs.where("norm is not null").select("id", X.tokens(F.col("norm")).alias("t")).collect() for w, n in Counter(r["t"]).items())
    found = semantic.terms(docs)
    assert sorted(map(tuple, found.collect())) == want and "Exchange" not in found._jdf.queryExecution().toString()  # before, all tokens were shuffled
    twice = docs.unionByName(docs.limit(10)).unionByName(spark.createDataFrame([(None, "ab cd"), (None, "ab")], "id string, norm string"))
    got = {(r["id"], r["term"]): r["n"] for r in semantic.terms(twice).collect()}
    assert got[None, "ab"] == 2 and got[None, "cd"] == 1 and len(got) == len(want) + 2
    assert semantic.rank(docs, spark.createDataFrame([(1, "the a - x")], "query_id long, text string")).collect() == []


def test_normalising_leaves_no_pattern_over_whole_texts(spark):
    import unicodedata

    texts = ["é" * 200_000, "straße ﬁ Ｈｉ", "Kelvin K ①", "plain", "", "中文" * 50_000, "ŉ ĳ ŀ ſ “ ”"] * 8
    df = X.normalised(spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "id int, text string"))
    assert {r["id"]: r["norm"] for r in df.select("id", "norm").collect()} == {-1: None} | {k: unicodedata.normalize("NFKC", t) for k, t in enumerate(texts)}
    assert "RLIKE" not in df._jdf.queryExecution().toString()  # before, a pattern went over every sign of every text, at seconds a MB
