"""Places in an order, against a sort in Python."""

from pyspark.sql import functions as F

from quarrystone.operators import orders


def test_places_with_ties_nulls_and_none(spark):
    rows = [(k % 3, f"e{k % 2}", None if k % 4 else f"v{k % 5}", f"p{k % 7}") for k in range(200)]
    df = spark.createDataFrame(rows, "score_q long, entity_id string, versioned_ref string, path string")
    got = orders.placed(df, orders.SEMANTIC()).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 201))
    key = lambda r: (-r[0], r[1], r[2] or "", r[3])
    assert [key(tuple(r)) for r in got] == sorted(map(key, rows))
    assert orders.placed(df.limit(0), orders.SEMANTIC()).count() == 0
    same = spark.createDataFrame([(None,)] * 50, "x string")
    assert sorted(r["place"] for r in orders.placed(same, [F.col("x")]).collect()) == list(range(1, 51))
