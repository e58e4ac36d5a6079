import pytest

from quarrystone.functions.hashing import Stream, canonical, strict
from quarrystone.operators import scoring

SEED = "f25bf832810e022df4c1a9ff893497c3e4fc83f844efeb0bee3221f7c03a96cf"


def _passes(spark):
    bits = {"A": ("11111", "01010"), "B": ("00000", "01010")}
    rows = [(p, f"F0{f}", f"I{i}", r, int(b), f"{p}{b}") for p, both in bits.items() for f in range(1, 9) for i, s in enumerate(both) for r, b in enumerate(s)]
    return spark.createDataFrame(rows, "participant string, family string, instance string, repetition int, passed int, digest string")


def test_known_answers(spark):
    p = _passes(spark)
    scores = scoring.instance_scores(p)
    points = {r["participant"]: (r["macro"], r["micro"]) for r in scoring.macro(scores).collect()}
    assert points["A"] == pytest.approx((0.7, 0.7)) and points["B"] == pytest.approx((0.2, 0.2))
    for r in scoring.rounds(p).collect():
        assert f"{r['sd']:.12f}" == "0.273861278753"
    assert {r["participant"]: r["pass_rate"] for r in scoring.variation(p).collect()} == {"A": 0.5, "B": 0.5}


def test_known_intervals(spark):
    scores = scoring.instance_scores(_passes(spark))
    estimates = scoring.bootstrap(scores, SEED).cache()
    both = scoring.interval(estimates.unionByName(scoring.paired(estimates, "A", "B")))
    got = {r["participant"]: (round(r["low"], 12), round(r["high"], 12)) for r in both.collect()}
    assert got == {"A": (0.55, 0.85), "B": (0.10, 0.30), "A-B": (0.25, 0.75)}


def test_stream_is_unbiased_by_rejection():
    s = Stream(b"\0" * 32)
    drawn = [s.uniform(7) for _ in range(700)]
    assert set(drawn) == set(range(7)) and Stream(b"\0" * 32).uniform(1) == 0
    assert Stream(b"\1" * 32).choice([1, 0, 3]) in (0, 2)


def test_canonical_forms():
    assert canonical({"b": None, "a": [1, None, {"c": None}]}) == '{"a":[1,null,{}]}'
    assert strict({"é": "a\n", "a": True}) == '{"a":true,"é":"a\\u000a"}'.encode()
    with pytest.raises(ValueError):
        strict({"a": 1.5})
    with pytest.raises(ValueError):
        strict(2**63)


def test_empty_metrics_are_null_and_never_qualify(spark):
    empty = spark.createDataFrame([], "civ_count int, hallucinated boolean, graph_exact_match boolean, version_correct boolean, fail_closed_correct boolean, stale_tp int, stale_fp int, stale_fn int, impact_tp int, impact_fp int, impact_fn int")
    row = scoring.gate(scoring.metrics(empty)).first()
    assert row["vlp"] is None and row["sf1"] is None and row["qualified"] is False
