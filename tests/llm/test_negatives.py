"""Hard negatives and whole-number vectors by brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import negatives, vectors

ROWS = "vec_id long, embedding array<double>, label int, score long, rank int"


def whole(v, scale=256):
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [math.floor(scale * c) if abs(c) < 2**52 else int(c) * scale for c in v]


def brute(rows, clamp=True):
    held = [(i, lab, whole(v)) for i, v, lab, *_ in rows if i is not None and lab is not None and whole(v) is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    cut = lambda s: min(max(s, vectors.LEAST), vectors.MOST)
    for i in sorted({r[0] for r in held if r[0] % 100 == 0}):
        own = min((r for r in held if r[0] == i), key=lambda r: (r[1], next(v for j, v, lab, *_ in rows if j == i and lab == r[1] and whole(v) == r[2])))
        others = [(r[0], r[1], dot(own[2], r[2])) for r in held if r[0] != i]
        for p, _, s in sorted((r for r in others if r[1] == own[1]), key=lambda r: (-r[2], r[0]))[:5]:
            fit = sorted((r for r in others if r[1] != own[1] and 30 * s <= 100 * r[2] <= 90 * s), key=lambda r: (-r[2], r[0]))[:10]
            out += [(i, p, k + 1, n, cut(s), cut(t)) for k, (n, _, t) in enumerate(fit)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PACK", 64), ("GROUP", 2), ("AT_ONCE", 2), ("BLOCK", 2), ("TASKS", 6)):
        monkeypatch.setattr(negatives, name, value)


def sample(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    power = spread ** np.arange(dim)
    x = rng.normal(size=(n, dim)) * power @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    return [(k, x[k].tolist(), int(rng.integers(4)), 0, 0) for k in range(n)]


@pytest.mark.parametrize("spread", [1.0, 0.5])
def test_negatives(spark, small, spread):
    rows = sample(700, 12, 1, spread)
    rows += [(1000 + k, rows[k][1], rows[k + 1][2], 0, 0) for k in range(40)]  # ties and copies of other labels
    rows += [(5000, None, 1, 0, 0), (5100, [1.0, None], 1, 0, 0), (5200, [math.nan], 1, 0, 0), (5300, [math.inf] * 12, 2, 0, 0), (None, [1.0], 1, 0, 0), (5400, [1.0] * 12, None, 0, 0)]
    rows += [(6000, [0.0] * 12, 1, 0, 0), (6100, [], 1, 0, 0), (6200, [3.0, 1.0], 2, 0, 0), (6300, [1.0] * 15, 3, 0, 0)]
    df = spark.createDataFrame(rows, ROWS)
    got = negatives.mine(df, F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_ids_and_hot_labels(spark, small):
    rows = sample(300, 6, 2)
    rows = [(i, v, 0 if k % 3 else lab, 0, 0) for k, (i, v, lab, *_) in enumerate(rows)]
    rows += [rows[100], (100, [9.0] * 6, rows[100][2] + 1, 0, 0), (7, rows[8][1], 3, 0, 0), rows[9]]
    got = negatives.mine(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_scores_of_any_size(spark, small):
    rows = sample(120, 4, 3)
    rows = [(i, [c * (1e10 if k % 5 == 0 else 1.0) for c in v] if k % 7 else [c * 1e300 for c in v], lab, 0, 0) for k, (i, v, lab, *_) in enumerate(rows)]
    rows += [(200, [1e10] * 4, 1, 0, 0), (300, [1.7e308, 1.0, 1.0, 1.0], 2, 0, 0)]
    got = negatives.mine(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bounds_drop_pairs_and_lose_none():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(2000, 32)) * 0.6 ** np.arange(32) @ np.linalg.qr(rng.normal(size=(32, 32)))[0]).astype(np.int64)
    turn = negatives.rotation(list(x[:500]))
    assert np.allclose(turn @ turn.T, np.eye(32))
    q, other = negatives.Turned(x[:50], turn, 32), negatives.Turned(x, turn, 32)
    exact = x[:50] @ x.T
    line = np.sort(exact, axis=1)[:, -10].astype(float)
    i, j, steps = negatives.survivors(q, other, np.full(exact.shape, True), line[:, None], np.full((50, 1), np.inf), 10, negatives.slack_of(turn, 32))
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    assert {(a, b) for a, b in zip(*np.nonzero(exact >= line[:, None]), strict=True)} <= kept and len(kept) < 0.02 * exact.size and steps < len(q.cuts) + 1


def test_keys_order_scores():
    big = [-(10**40), -(10**39), vectors.LEAST - 1, vectors.LEAST, -5, 0, vectors.MOST, vectors.MOST + 1, 10**30, 10**31]
    low, keys = vectors.clamped(np.array(big, object))
    pairs = [(int(a), k or vectors.INSIDE) for a, k in zip(low, keys, strict=True)]
    assert pairs == sorted(pairs) and [vectors.from_key(a, k) for a, k in pairs] == big
    got = vectors.to_integers(pa.array([[1e300], [0.5, -0.5], None, [None], []]), 1024)
    assert got[0].tolist() == [int(1e300) * 1024] and got[1].tolist() == [512, -512] and got[2] is got[3] is None and len(got[4]) == 0


def test_top_k_of_repeated_ids_and_of_scores_of_any_size(spark):
    from quarrystone.llm import voronoi

    rows = [(100, None), (100, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = voronoi.top_k(df, df.where("vec_id = 100")).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 5 << 20), (2, 3 << 20)]
    twice = spark.createDataFrame([(100, [5.0, 0.0]), (100, [1.0, 9.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>").repartition(3)
    got = voronoi.top_k(twice, twice.where("vec_id = 100")).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 12 << 20), (2, 10 << 20)]  # the least vector asks
    rng = np.random.default_rng(6)
    held = [(k, (rng.normal(size=4) * rng.choice([1.0, 1e10, 1e300])).tolist()) for k in range(150)] + [(200, [1e300] * 4), (201, [1e300] * 4), (300, [-1e10] * 4), (301, [1.0] * 4)]
    got = voronoi.top_k(spark.createDataFrame(held, "vec_id long, embedding array<double>"), spark.createDataFrame([r for r in held if r[0] % 100 == 0], "vec_id long, embedding array<double>"), k=12, pivots=8)
    want = []
    for q, v in held:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole(v, 1024), whole(w, 1024), strict=True)), i) for i, w in held if i != q)[:12]
            want += [(q, n + 1, i, min(max(-s, vectors.LEAST), vectors.MOST)) for n, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
