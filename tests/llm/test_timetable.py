from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import pytest

from tallymart.llm import mixing


def test_slots_are_chosen_by_deadline_then_source(spark):
    quotas = spark.createDataFrame([(f"s{n:03}", 1 + n % 3) for n in range(40)], "source string, quota long")
    period = sum(1 + n % 3 for n in range(40))
    used, want = [0] * 40, []
    for t in range(period):
        due = [(-(-(used[n] + 1) * period // (1 + n % 3)), n) for n in range(40)
               if used[n] * period // (1 + n % 3) <= t]
        used[min(due)[1]] += 1
        want.append(f"s{min(due)[1]:03}")
    got = {r["phase"]: r["source"] for r in mixing.timetable(quotas).collect()}
    assert [got[t] for t in range(period)] == want


def test_real_weights_are_met_within_a_block_over_ten_thousand_slots(spark):
    given = [("a", 0.9871), ("b", 0.0001), ("c", 0.0), ("d", 0.0128), (None, -1.0)]
    weights = spark.createDataFrame(given, "source string, weight double")
    docs = spark.createDataFrame([(s,) for s, _ in given] + [("e",)], "source string")
    quotas = mixing.target_quotas(docs, weights)
    assert {r["source"]: r["quota"] for r in quotas.collect()} == {
        "a": 9871, "b": 1, "c": 0, "d": 128, None: 0, "e": 0}
    slots = [r["source"] for r in mixing.timetable(quotas).orderBy("phase").collect()]
    assert len(slots) == 10_000
    had = dict.fromkeys("abd", 0)
    for t, source in enumerate(slots, 1):
        had[source] += 1
        for name, weight in (("a", "0.9871"), ("b", "0.0001"), ("d", "0.0128")):
            assert abs(had[name] - t * Fraction(weight)) < 1


def test_weights_that_cannot_be_met_are_refused(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "source string")
    for weight in (0.123456789, 1e-30):
        weights = spark.createDataFrame([("a", weight), ("b", 1.0)], "source string, weight double")
        with pytest.raises(ValueError, match="weight"):
            mixing.target_quotas(docs, weights)
    exact = spark.createDataFrame([("a", Decimal("1.50")), ("b", Decimal("0.25"))],
                                  "source string, weight decimal(9,2)")
    assert {r["source"]: r["quota"] for r in mixing.target_quotas(docs, exact).collect()} == {"a": 150, "b": 25}


def test_zero_weight_follows_the_mixture_and_own_columns_are_safe(spark):
    rows = [(i, "abz"[i % 3], f"t{i}", i, -i, "own") for i in range(90)] + [(None, None, "x", 1, 2, "own")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, nth int, quota int, own string")
    weights = spark.createDataFrame([("a", 3), ("b", 1)], "source string, weight int")
    mixed = mixing.mix_sources(docs, weights, block_docs=4)
    assert mixed.columns == [*docs.columns, "block", "slot", "target_weight", "mix_order"]
    got = mixed.orderBy("mix_order").collect()
    assert len(got) == 93 and len({r["mix_order"] for r in got}) == 93
    assert {r["source"]: r["target_weight"] for r in got} == {"a": 0.75, "b": 0.25, "z": 0.0, None: 0.0}
    assert all(r["nth"] == r["doc_id"] and r["quota"] == -r["doc_id"] for r in got if r["doc_id"] is not None)
    last = max(r["mix_order"] for r in got if r["target_weight"])
    assert all(r["mix_order"] > last for r in got if not r["target_weight"])
    assert mixing.mix_sources(docs, weights.where("false")).count() == 93
