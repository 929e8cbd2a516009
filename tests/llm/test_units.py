from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from tallymart.llm import scoring, units  # noqa: E402


def test_rows_without_an_id_and_repeated_rows_do_not_share_a_unit(spark):
    rows = [(None, f"text {n}") for n in range(1000)] + [(5, "the same row")] * 1000
    dealt = units.Units(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = [r[1] for r in dealt.table.groupBy("unit").agg(F.count(F.lit(1))).collect()]
    assert sum(sizes) == 2000 and max(sizes) < 100


def test_all_rows_of_a_target_are_targets(spark):
    rows = [(5, f"good word {n % 3}") for n in range(40)] + [(n, f"bad noise {n}") for n in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = scoring.score_documents(docs, spark.createDataFrame([(5,)], "doc_id long")).collect()
    good = [r["score"] for r in scores if r["doc_id"] == 5]
    assert len(good) == 40 and max(good) - min(good) < 0.1
    assert max(good) < min(r["score"] for r in scores if r["doc_id"] != 5)


def test_messages_grow_in_proportion_to_the_text():
    def messages(size):
        return (size / units.unit_size(size)) ** 2
    for size in (10 ** 11, 10 ** 12, 10 ** 13):
        assert 9 < messages(10 * size) / messages(size) < 11
    assert units.unit_size(10 ** 14) < 10 ** 9 and units.unit_size(10 ** 9) == units.UNIT_BYTES


def test_no_more_messages_than_units_times_ranges(spark, monkeypatch):
    monkeypatch.setattr(units, "MESSAGE_BYTES", 0)
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} common words here") for i in range(3000)],
                                 "doc_id long, text string")
    for unit_bytes, count in ((2000, 64), (150, 640)):
        dealt = units.Units(docs, unit_bytes=unit_bytes)
        assert dealt.count >= count * 0.6 and dealt.ranges == 64
        asked = dealt.run(scoring._ask(dealt.ranges), units.MESSAGE, [])
        kinds = asked.groupBy("step").count().collect()
        assert all(r["count"] <= dealt.count * dealt.ranges for r in kinds)


def test_scores_equal_a_model_of_dictionaries(spark):
    rows = [(1, "a b"), (2, "a c"), (3, "a d"), (3, "a d"), (4, None), (5, ""), (None, "b b a"), (6, "x"),
            (7, "a b a b c d " * 50), (1, "a b")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, unit int, step string")
    targets = spark.createDataFrame([(1,), (1,), (7,), (None,), (99,)], "doc_id long")
    got = sorted((tuple(r) for r in scoring.score_documents(docs, targets).collect()), key=repr)
    want = []
    for (i, _), (n, target, background) in zip(rows, brute.language_model(rows, {1, 7, 99})):
        want.append((i, n, target, background, None if target is None else target - background))
    want.sort(key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:]) if w[2] is not None else g[2:] == w[2:]


def test_vocabulary_counts_words_that_only_end_a_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a d")], "doc_id long, text string")
    got = scoring.score_documents(docs, spark.createDataFrame([(1,)], "doc_id long")).where("doc_id = 1").first()
    assert got["target_loss"] == pytest.approx(0.2412, abs=1e-4)
